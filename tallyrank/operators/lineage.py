"""Cutting the lineage of iterations with tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one on this machine only where all of Spark runs here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_FOLDER


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, which survives lost executors.

    A table rather than a checkpoint, as it has the size that its files have: a checkpoint keeps the estimate of the plan that
    made it, which joins multiply, round after round."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes the tables of what `cut` gave. Nothing may read them any more."""
    for frame in frames:
        path = getattr(frame, "cut_path", None)
        if path:
            place = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
