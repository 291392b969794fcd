"""Reports and tables written out. Reports are a few rows: cut-offs by metrics."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import decimals


def append_metrics(df: DataFrame, folder: str) -> None:
    """Metric rows added to a Parquet table, and values as text with 12 decimals to CSV files beside it."""
    df.write.mode("append").parquet(f"{folder}/metrics")
    df.withColumn("Value", decimals("Value")).coalesce(1).write.mode("append").option("header", True).csv(f"{folder}/metrics_csv")


def wide(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each K, one column for each metric."""
    return df.groupBy("K").pivot("Metric", names).agg(F.avg("Value")) if names else df.groupBy("K").pivot("Metric").agg(F.avg("Value"))


def by_run(df: DataFrame) -> DataFrame:
    """One row for each run and model, one column for each metric and cut-off."""
    return df.withColumn("Col", F.concat("Metric", F.lit("@"), F.col("K").cast("string"))).groupBy("RunId", "Model").pivot("Col").agg(F.avg("Value"))


def summary(df: DataFrame) -> DataFrame:
    """Model, K, Metric, the mean over runs, and whether it is the best one of all models (within 1e-12)."""
    means = df.groupBy("Model", "K", "Metric").agg(F.avg("Value").alias("mean"))
    best = means.groupBy("K", "Metric").agg(F.max("mean").alias("most"))
    return means.join(best, ["K", "Metric"]).select("Model", "K", "Metric", "mean", (F.col("mean") >= F.col("most") - 1e-12).alias("best"))


def escape_latex(text: str) -> str:
    return "".join({"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}.get(c, "\\" + c if c in "&%$#_{}" else c) for c in text)


def slug(text: str) -> str:
    return "-".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def latex(df: DataFrame, title: str, bold: dict[tuple[int, str], bool] | None = None, digits: int = 4) -> str:
    """A table of a report of a few rows."""
    rows, names = few(df), df.columns
    cell = lambda i, n, v: "" if v is None else (rf"\textbf{{{v:.{digits}f}}}" if bold and bold.get((i, n)) else f"{v:.{digits}f}") if isinstance(v, float) else escape_latex(str(v))
    lines = [" & ".join(escape_latex(n) for n in names) + r" \\ \hline", *[" & ".join(cell(i, n, r[n]) for n in names) + r" \\" for i, r in enumerate(rows)]]
    body = "\n".join(lines)
    return f"\\begin{{table}}\n\\caption{{{escape_latex(title)}}}\n\\label{{tab:{slug(title)}}}\n\\begin{{tabular}}{{{'l' * len(names)}}}\n{body}\n\\end{{tabular}}\n\\end{{table}}\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file on any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_report(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A report of a few rows (an error beyond `most`) as CSV with 12 decimals; a missing value is empty."""
    held = io.StringIO()
    out = csv.writer(held, lineterminator="\n")
    out.writerow(df.columns)
    out.writerows([["" if v is None else f"{v:.12f}" if isinstance(v, float) else v for v in row] for row in few(df, most)])
    write_text(df.sparkSession, held.getvalue(), path)


def few(df: DataFrame, most: int = 100_000) -> list:
    """The rows of a report; an error if there are more than a report has."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def write_json(spark: SparkSession, value: object, path: str) -> None:
    write_text(spark, json.dumps(value, indent=1, sort_keys=True, default=str), path)
