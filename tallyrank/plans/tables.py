"""The engine's tables from the warehouse's ones, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators.interactions import canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' parts: label 1 to 5 from the quantity, time from the order's date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.ceil(F.col("l_quantity") / 10).alias("rating"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", epoch_seconds("o_orderdate").alias("timestamp"))
    return canonical(lines.join(orders, lines.l_orderkey == orders.o_orderkey), {"user": "o_custkey", "item": "l_partkey"})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, tag, weight: the brand with weight 1, the type with a weight from the size."""
    rows = table(spark, sf_dir, "part")
    pairs = F.array(F.struct(F.col("p_brand").alias("tag"), F.lit(1.0).alias("weight")), F.struct(F.col("p_type").alias("tag"), (F.col("p_size") / 50.0).alias("weight")))
    return rows.select(F.col("p_partkey").alias("item"), F.explode(pairs).alias("t")).select("item", "t.tag", "t.weight")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


# The same in SQL, as common table expressions.
INTERACTIONS = """i AS (SELECT o_custkey AS "user", l_partkey AS item, ceil(l_quantity / 10)::DOUBLE AS label, epoch(o_orderdate)::BIGINT AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PLACED = """placed AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY time, item, label) - 1 AS place, count(*) OVER (PARTITION BY "user") AS size FROM i)"""
PART_DOCS = "pd AS (SELECT p_partkey AS item, concat_ws(' ', p_name, p_type, p_brand) AS text FROM part)"
PART_TAGS = "pt AS (SELECT p_partkey AS item, p_brand AS tag, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT p_partkey, p_type, p_size / 50.0::DOUBLE FROM part)"


def q(x: str, digits: int = 6) -> str:
    """Half-up rounding on doubles, as functions.scalars.quantised."""
    return f"(floor(({x})::DOUBLE * 1e{digits} + 0.5e0) / 1e{digits})"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def draw(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in keys)}))"


def draw_int(seed: int, *keys: str) -> str:
    return f"('0x' || substr({draw(seed, *keys)}, 1, 8))::BIGINT"
