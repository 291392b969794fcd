"""Bounded labelled samples for fitting. Which rows are taken depends on their ids' and texts' hashes alone."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Different labels that a sample can have, unless told: the bound of what a fit may hold. With more of them, those beyond, the
#: rarest ones, are an error, so that none is left out without a word.
LABELS = 5_000


def chosen(labels: DataFrame, limit: int, most: int = LABELS) -> tuple[DataFrame, dict]:
    """doc_id and label of at most `limit` documents of each label, those with the least md5 of their id, and the labels' counts.

    `labels` has doc_id and label. Only ids are ranked, and a coarse cut on the hash comes first. More than `most`
    different labels are an error.
    """
    known = labels.where("label is not null and doc_id is not null").select("doc_id", "label").distinct()
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"there are more than {most} different labels")
    keyed = known.withColumn("order", F.md5(F.col("doc_id").cast("string")))
    shares = [F.lit(x) for value, n in counts.items() for x in (value, int(min(1.0, 2.0 * limit / max(n, 1) + 20.0 / max(n, 1)) * 2**32))]
    near = F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint") <= F.element_at(F.create_map(*shares), F.col("label")) if shares else F.lit(False)
    order = Window.partitionBy("label").orderBy("order", "doc_id")
    taken = keyed.where(near).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return taken.select("doc_id", "label"), counts


def labelled(docs: DataFrame, labels: DataFrame, limit: int, most: int = LABELS) -> tuple[dict, dict]:
    """Whole texts of the chosen documents by label, at most `limit` different (doc_id, text) for each, and the labels' counts."""
    taken, counts = chosen(labels, limit, most)
    # at most `limit` ids for each label
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    # an id may be that of many rows: they count as rows of the sample too
    ranked = found.select("label", "doc_id", "text", F.md5(F.col("doc_id").cast("string")).alias("order"), F.xxhash64("text").alias("hash"))
    place = F.dense_rank().over(Window.partitionBy("label").orderBy("order", "doc_id", "hash"))
    few = ranked.withColumn("place", place).where(F.col("place") <= limit).dropDuplicates(["label", "doc_id", "hash"])
    out = defaultdict(list)
    for row in sorted(few.collect(), key=lambda r: (r["doc_id"], r["hash"], r["text"])):
        out[row["label"]].append(row["text"])
    return dict(out), counts
