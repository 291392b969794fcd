"""Interactions (user, item, label, time): canonical columns and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import draw, not_blank, sorted_tags
from .lineage import cut, release

# Names under which sources call the four columns, in the order in which they are looked for.
ALIASES: dict[str, list[str]] = {
    "user": ["user", "userId", "uid", "user_id"],
    "item": ["item", "itemId", "movieId", "iid", "item_id"],
    "label": ["label", "rating", "stars", "score"],
    "time": ["time", "timestamp", "ts", "datetime"],
}


def canonical(df: DataFrame, mapping: dict[str, str | list[str]] | None = None, keep_extras: bool = False) -> DataFrame:
    """user, item, label, time by given names (one, or several to choose from) or known aliases. A missing time is 0; any other missing column is an error."""
    there = {c.lower(): c for c in df.columns}
    picked: dict[str, str | None] = {}
    for name, aliases in ALIASES.items():
        wanted = mapping[name] if mapping and name in mapping else aliases
        wanted = [wanted] if isinstance(wanted, str) else wanted
        picked[name] = next((there[a.lower()] for a in wanted if a.lower() in there), None)
    if missing := [n for n in ("user", "item", "label") if picked[n] is None]:
        raise ValueError(f"no column for {', '.join(missing)} among {df.columns}")
    time = F.col(picked["time"]).try_cast("bigint") if picked["time"] else F.lit(0).cast("bigint")
    out = [F.col(picked["user"]).alias("user"), F.col(picked["item"]).alias("item"), F.col(picked["label"]).try_cast("double").alias("label"), F.coalesce(time, F.lit(0)).cast("bigint").alias("time")]
    extras = [c for c in df.columns if c not in picked.values()] if keep_extras else []
    return df.select(*out, *extras)


def min_label(df: DataFrame, least: float) -> DataFrame:
    """Rows whose label is a number of at least `least`."""
    return df.where(F.col("label").isNotNull() & ~F.isnan("label") & (F.col("label") >= least))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The same rows; an error if there are none."""
    if not df.limit(1).count():
        raise ValueError(f"no rows left: {what}")
    return df


def positives(df: DataFrame, threshold: float = 0.0, fallback: bool = False) -> DataFrame:
    """Rows above the threshold; if there are none and `fallback`, rows above 0."""
    above = df.where(F.col("label") > threshold)
    return above if not fallback or above.limit(1).count() else df.where(F.col("label") > 0)


def relevant(df: DataFrame, column: str, threshold: float, strict: bool) -> DataFrame:
    return df.where(F.col(column) > threshold if strict else F.col(column) >= threshold)


def quantile_at(values: DataFrame, column: str, q: float):
    """The value at 0-based rank round((n - 1) q) of the sorted column, as a one-row DataFrame without collecting it."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))  # few distinct values: counts of counts
    ranked = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("every", F.sum("c").over(Window.partitionBy()))
    return ranked.where(F.col("upto") > F.floor((F.col("every") - 1) * F.lit(q) + 0.5)).agg(F.min("v").alias("v"))


def activity_between(df: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Interactions of users whose number of rows is strictly between the two quantiles of all users' numbers."""
    users = df.groupBy("user").agg(F.count("*").alias("n"))
    a, b = (quantile_at(users, "n", q).first()["v"] for q in (low, high))  # two numbers
    return df.join(users.where((F.col("n") > F.lit(a)) & (F.col("n") < F.lit(b))).select("user"), "user", "left_semi")


def k_core(df: DataFrame, k: int = 10, rounds: int = 5) -> DataFrame:
    """Up to `rounds` rounds of dropping items and then users with fewer than k rows, until nothing goes."""
    df = cut(df.select("user", "item", *[c for c in df.columns if c not in ("user", "item")]))  # no round reads the source again
    for _ in range(rounds):
        gone = 0
        for key in ("item", "user"):
            # the few keys that go rather than the many that stay: in a table, whose size is known, they are broadcast as long as they are few
            few = cut(df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") < k) | F.col(key).isNull()).select(key))
            n = few.count()
            if n:
                left = cut(df.where(F.col(key).isNotNull()).join(few, key, "left_anti").select(*df.columns))
                release(df)
                df = left
            release(few)
            gone += n
        if not gone:
            break
    return df


def min_count(df: DataFrame, key: str, least: int, distinct: str | None = None) -> DataFrame:
    """Rows whose key has at least so many rows (or distinct values of another column)."""
    size = F.countDistinct(distinct) if distinct else F.count("*")
    return df.join(df.groupBy(key).agg(size.alias("n")).where(F.col("n") >= least).select(key), key, "left_semi")


def popular(df: DataFrame, limit: int) -> DataFrame:
    """Rows of the `limit` most frequent items, ties to the lesser item."""
    top = df.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(limit).select("item")
    return df.join(top, "item", "left_semi")


def pseudo_time(df: DataFrame, ascending: bool = True) -> DataFrame:
    """Time as the place of a row among its user's rows by label, from 1; ties by item."""
    order = [F.asc("label") if ascending else F.desc("label"), F.asc("item")]
    return df.withColumn("time", F.row_number().over(Window.partitionBy("user").orderBy(*order)).cast("bigint"))


def relative_weight(df: DataFrame, group: str, weight: str) -> DataFrame:
    """Weight over the greatest weight of its group."""
    most = df.groupBy(group).agg(F.max(weight).alias("__most"))
    return df.join(most, group).withColumn("relevance", F.when(F.col("__most") > 0, F.col(weight) / F.col("__most")).otherwise(0.0)).drop("__most")


def top_per(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def sampled(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """A share of the rows by their hashes: the same rows on any partitioning."""
    return df if fraction >= 1 else df.where(F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("bigint") < F.lit(int(fraction * 2**32)))


def categories(df: DataFrame, column: str = "category", least: int = 2, stop: str | None = None, nested: bool = False) -> DataFrame:
    """One row for each cleaned category of a row: trimmed, long enough, not the stop category, each once."""
    found = F.flatten(column) if nested else F.col(column)
    found = F.filter(F.transform(found, lambda x: F.trim(x)), lambda c: c.isNotNull() & (F.length(c) >= least) & (F.lower(c) != (stop or "").lower()))
    return df.withColumn("category", F.explode(sorted_tags(found))).where(not_blank("category"))


def popularity(df: DataFrame) -> DataFrame:
    """item, n and popularity: the number of rows over the greatest one."""
    counts = df.groupBy("item").agg(F.count("*").alias("n"))
    return counts.withColumn("popularity", F.col("n") / F.lit(counts.agg(F.max("n")).first()[0] or 1))


def universe(*frames: DataFrame) -> DataFrame:
    """All items of the frames, each once."""
    out = frames[0].select("item")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("item"))
    return out.distinct()


def encoded(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dense 0-based codes in the order of the key, counted by ranges of it rather than in one task."""
    keys = df.select(key).distinct()
    parts = keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id())
    parts = cut(parts)  # partition ids must not change between the two uses
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n")).collect()  # one row for each partition
    base, before = {}, 0
    for row in sorted(sizes, key=lambda r: r["__part"]):
        base[row["__part"]], before = before, before + row["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for p in (base or {0: 0}).items() for x in p]), F.col("__part"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return df.join(parts.select(key, (offset + place).cast("bigint").alias(name)), key)


def feedback_mode(df: DataFrame) -> DataFrame:
    """One row: the kind of feedback, from the positive labels' greatest value and number of distinct values."""
    row = df.where("label > 0").agg(F.count("*").alias("n"), F.max("label").alias("most"), F.countDistinct("label").alias("kinds"))
    kind = F.when(F.col("n") == 0, "implicit_binary").when((F.col("most") <= 1) & (F.col("kinds") <= 2), "implicit_binary")
    return row.select(kind.when((F.col("most") <= 10) & (F.col("kinds") >= 5), "explicit").otherwise("implicit_count").alias("mode"), "n", "most", "kinds")


def resolve_auto(mode: str, centre: bool = True) -> dict[str, bool]:
    """What "auto" settings mean for a kind of feedback."""
    explicit = mode == "explicit"
    return {"binary": not explicit, "weighted": explicit, "normalise": explicit, "adjusted_cosine": explicit and centre}
