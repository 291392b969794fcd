"""What the corpus operators share: table access, the shared folder, and written intermediate tables."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_FOLDER = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/tallyrank-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Workspace:
    """Intermediate tables of one run in the shared folder, deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, shared_folder(spark), 0
        self.paths: dict[str, list[str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows from a Parquet table: cuts the lineage, and lost executors cost nothing."""
        path = f"{self.folder}/{self.made}-{name}"
        self.made += 1
        self.paths.setdefault(name, []).append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name):
                removed(self.spark, path)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*[name for name in self.paths if name not in names])


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table of its own in the shared folder."""
    return Workspace(df.sparkSession).written(df, name)


#: A key of more than one row in so many is dealt over several partitions. There are at most as many such keys.
HEAVY = 1_000


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], count: str, deal: str, total: int | None = None) -> DataFrame:
    """`big` joined with `small`, which has each key once and in `count` the number of its rows in `big`. The rows of
    frequent keys are dealt by a hash of `deal` over as many partitions as they are worth; their rows of `small` go to
    all of these. The list of frequent keys is broadcast: it has HEAVY rows at most, as the counts add up to the rows (`total`, if that is known)."""
    spark = big.sparkSession
    if total is None:
        total = small.agg(F.sum(count)).first()[0] or 0
    parts = F.ceil(F.col(count) * (4 * partitions(spark)) / F.lit(max(total, 1))).cast("int")
    heavy = F.col(count) * HEAVY > total
    frequent = small.where(heavy).select(*[F.col(k).alias(f"__{k}") for k in keys], parts.alias("__parts"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    dealt = big.join(F.broadcast(frequent), same, "left").withColumn("__salt", F.pmod(F.xxhash64(deal), F.coalesce("__parts", F.lit(1))).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(heavy, parts).otherwise(1) - 1)))
    return dealt.drop("__parts", *[f"__{k}" for k in keys]).join(copies, [*keys, "__salt"]).drop("__salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the DataFrame does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo: true for the fold kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))
