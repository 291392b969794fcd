"""Ranking metrics over scored rows (group, item, y_true, y_pred), ranked by score and then by item."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite
from .lineage import cut, release

NAMES = ("PRECISION", "RECALL", "MRR", "MAP", "NDCG")


def ranked(scored: DataFrame, group: str = "gid") -> DataFrame:
    """Adds rank (from 1) and hit; a NaN score comes last and a NaN label counts as 0."""
    rows = scored.withColumn("y_true", finite("y_true", 0.0)).withColumn("y_pred", finite("y_pred", -1e30))
    order = Window.partitionBy(group).orderBy(F.desc("y_pred"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("hit", (F.col("y_true") > 0).cast("int"))


def _discount(rank: str) -> Column:
    return F.log2(F.col(rank) + 1.0)


def precision(scored: DataFrame, k: int, group: str = "gid") -> DataFrame:
    top = F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    return ranked(scored, group).groupBy(group).agg((top / F.least(F.lit(k), F.count("*"))).alias("value"))


def recall(scored: DataFrame, k: int, group: str = "gid") -> DataFrame:
    top, every = F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)), F.sum("hit")
    return ranked(scored, group).groupBy(group).agg(F.when(every > 0, top / every).otherwise(0.0).alias("value"))


def average_precision(scored: DataFrame, k: int, group: str = "gid") -> DataFrame:
    """Mean of the precisions at the hits among the first k; 0 without hits."""
    order = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked(scored, group).withColumn("upto", F.sum("hit").over(order))
    inside = (F.col("rank") <= k) & (F.col("hit") == 1)
    found, hits = F.sum(F.when(inside, F.col("upto") / F.col("rank")).otherwise(0.0)), F.sum(inside.cast("int"))
    return rows.groupBy(group).agg(F.when(hits > 0, found / hits).otherwise(0.0).alias("value"))


def reciprocal_rank(scored: DataFrame, group: str = "gid") -> DataFrame:
    """One over the rank of the first hit in the whole list."""
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    return ranked(scored, group).groupBy(group).agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("value"))


def ndcg(scored: DataFrame, k: int, group: str = "gid", exponential: bool = False) -> DataFrame:
    gain = F.pow(F.lit(2.0), F.col("y_true")) - 1 if exponential else F.col("y_true")
    best = Window.partitionBy(group).orderBy(F.desc("y_true"), "item")
    rows = ranked(scored, group).withColumn("ideal", F.row_number().over(best)).withColumn("gain", gain)
    got, most = (F.sum(F.when(F.col(r) <= k, F.col("gain") / _discount(r)).otherwise(0.0)) for r in ("rank", "ideal"))
    return rows.groupBy(group).agg(F.when(most > 0, got / most).otherwise(0.0).alias("value"))


def per_group(scored: DataFrame, ks: list[int], group: str = "gid") -> DataFrame:
    """All metrics at all cut-offs: one row for each group, from one ranking pass."""
    by = Window.partitionBy(group)
    upto = by.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked(scored, group).withColumn("ideal", F.row_number().over(by.orderBy(F.desc("y_true"), "item"))).withColumn("upto", F.sum("hit").over(upto))
    out: list[Column] = [F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("MRR"), F.sum("hit").alias("relevant")]
    for k in ks:
        inside = F.col("rank") <= k
        hits = F.sum(F.when(inside, F.col("hit")).otherwise(0))
        gains, ideal = (F.sum(F.when(F.col(r) <= k, F.col("y_true") / _discount(r)).otherwise(0.0)) for r in ("rank", "ideal"))
        precise = F.sum(F.when(inside & (F.col("hit") == 1), F.col("upto") / F.col("rank")).otherwise(0.0))
        out += [
            (hits / F.least(F.lit(k), F.count("*"))).alias(f"PRECISION@{k}"), F.when(F.sum("hit") > 0, hits / F.sum("hit")).otherwise(0.0).alias(f"RECALL@{k}"),
            F.when(hits > 0, precise / hits).otherwise(0.0).alias(f"MAP@{k}"), F.when(ideal > 0, gains / ideal).otherwise(0.0).alias(f"NDCG@{k}"),
        ]
    return rows.groupBy(group).agg(*out)


def evaluate(scored: DataFrame, ks: list[int], names: list[str] | None = None, group: str = "gid", skip_empty: bool = False) -> DataFrame:
    """K, Metric, Value: means over the groups; `skip_empty` leaves out groups without a relevant row."""
    wanted = [n for n in (x.upper() for x in (names or NAMES)) if n in NAMES]
    rows = per_group(scored, ks, group)
    if skip_empty:
        rows = rows.where("relevant > 0")
    entries = [F.struct(F.lit(k).alias("K"), F.lit(n).alias("Metric"), F.col("MRR" if n == "MRR" else f"`{n}@{k}`").alias("v")) for k in ks for n in wanted]
    return rows.select(F.explode(F.array(*entries)).alias("e")).groupBy("e.K", "e.Metric").agg(F.avg("e.v").alias("Value"))


def pooled(scored: DataFrame, ks: list[int], names: list[str] | None = None) -> DataFrame:
    """K and a column for each metric, of the one list that all rows form, by score, then item, then group.

    No window goes over all rows: the first max(ks) by score and by label are taken by partial sorts, and the rank of the first
    hit is one more than the number of rows before it."""
    wanted = [n for n in (x.upper() for x in (names or NAMES)) if n in NAMES]
    tail = ["item", "gid"] if "gid" in scored.columns else ["item"]
    rows = scored.withColumn("y_true", finite("y_true", 0.0)).withColumn("y_pred", finite("y_pred", -1e30)).withColumn("hit", (F.col("y_true") > 0).cast("int")).select("y_true", "y_pred", "hit", *tail)
    rows = cut(rows)  # read five times
    n, every = rows.agg(F.count("*"), F.sum("hit")).first()
    most = max(ks)
    top = [(r["y_true"], r["hit"]) for r in rows.orderBy(F.desc("y_pred"), *tail).limit(most).collect()]  # max(ks) rows
    ideal = [r["y_true"] for r in rows.orderBy(F.desc("y_true"), *tail).limit(most).collect()]
    first = rows.where("hit = 1").orderBy(F.desc("y_pred"), *tail).limit(1).collect()
    place = 0
    if first:
        before, same = F.col("y_pred") > F.lit(first[0]["y_pred"]), F.col("y_pred") == F.lit(first[0]["y_pred"])
        for c in tail:
            before, same = before | (same & (F.col(c) < F.lit(first[0][c]))), same & (F.col(c) == F.lit(first[0][c]))
        place = rows.where(before).count() + 1
    release(rows)
    out = []
    for k in ks:
        hits = [h for _, h in top[:k]]
        precise = [sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h]
        gained = lambda labels: sum(y / math.log2(i + 2) for i, y in enumerate(labels[:k]))  # noqa: B023, E731
        best = gained(ideal)
        found = {
            "PRECISION": sum(hits) / min(k, n) if n else 0.0, "RECALL": sum(hits) / every if every else 0.0, "MRR": 1.0 / place if place else 0.0,
            "MAP": sum(precise) / len(precise) if precise else 0.0, "NDCG": gained([y for y, _ in top]) / best if best > 0 else 0.0,
        }
        out.append((k, *[float(found[name]) for name in wanted]))
    return scored.sparkSession.createDataFrame(out, ", ".join(["K int", *[f"{name} double" for name in wanted]]))
