"""Splits and samples. Every draw is a hash of a seed and the row's keys, so results do not depend on partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..functions.scalars import draw, draw_int
from .lineage import cut


@dataclass(frozen=True)
class SplitConfig:
    """Shares of a random split; each within (0, 1) and together below 1."""

    test: float = 0.3
    validation: float = 0.1
    seed: int = 0

    def __post_init__(self) -> None:
        if not (0 < self.test < 1 and 0 < self.validation < 1 and self.test + self.validation < 1):
            raise ValueError("shares must be within (0, 1) and sum to less than 1")


def placed(df: DataFrame, group: str = "user", *order: Column | str) -> DataFrame:
    """The row's 0-based place in its group by time, and the group's size."""
    by = Window.partitionBy(group)
    return df.withColumn("place", F.row_number().over(by.orderBy(*(order or ("time", "item", "label")))) - 1).withColumn("size", F.count("*").over(by))


def fold_ratio(fold: int, folds: int = 5, test: float = 0.2, half_width: float = 0.05) -> float:
    """The train share of a fold: `folds` evenly spaced values around 1 - test."""
    if half_width > test:
        raise ValueError("the window is wider than the test share")
    if not 0 <= fold < folds:
        raise ValueError(f"fold {fold} of {folds}")
    low, high = 1 - test - half_width, 1 - test + half_width
    return low if folds == 1 else low + (high - low) * fold / (folds - 1)


def temporal(df: DataFrame, fold: int, folds: int = 5, test: float = 0.2, half_width: float = 0.05, max_test: int | None = None, seed: int = 42) -> DataFrame:
    """Adds `part`: a user's first rows by time are train, the rest test; perhaps a capped draw of the test rows."""
    ratio = fold_ratio(fold, folds, test, half_width)
    out = placed(df).withColumn("part", F.when(F.col("place") < F.floor(F.col("size") * F.lit(ratio)), "train").otherwise("test"))
    if max_test is not None:
        order = Window.partitionBy("user", "part").orderBy(draw(seed, "user", "item", "place"), "item", "place")
        out = out.withColumn("__draw", F.row_number().over(order)).where((F.col("part") == "train") | (F.col("__draw") <= max_test)).drop("__draw")
    return out


def by_ratio(df: DataFrame, *shares: tuple[str, float]) -> DataFrame:
    """Adds `part` by place: the first int(size * share) rows, then the next, and so on; the last takes the rest."""
    out, upto, when = placed(df), 0.0, None
    for name, share in shares[:-1]:
        upto += share
        edge = F.col("place") < F.floor(F.col("size") * F.lit(upto))
        when = F.when(edge, name) if when is None else when.when(edge, name)
    return out.withColumn("part", when.otherwise(shares[-1][0]))


def leave_last(df: DataFrame, n: int) -> DataFrame:
    """Adds `part`: each user's last n rows are test."""
    return placed(df).withColumn("part", F.when(F.col("place") >= F.col("size") - n, "test").otherwise("train"))


def random_by_user(df: DataFrame, cap: int, share: float, least: int, seed: int) -> DataFrame:
    """A draw of at most `cap` rows of each user with `least` rows or more; the first share of the draw is train."""
    order = Window.partitionBy("user").orderBy(draw(seed, "user", "item"), "item")
    out = df.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < cap).withColumn("size", F.count("*").over(Window.partitionBy("user"))).where(F.col("size") >= least)
    return out.withColumn("part", F.when(F.col("place") < F.floor(F.col("size") * F.lit(share)), "train").otherwise("test"))


def random_pairs(df: DataFrame, config: SplitConfig, *keys: str) -> DataFrame:
    """Adds `part` by the row's hash: exact thresholds on a 32-bit draw, so no task ranks all rows."""
    at = draw_int(config.seed, *keys)
    test, validation = int(config.test * 2**32), int((config.test + config.validation) * 2**32)
    return df.withColumn("part", F.when(at < test, "test").when(at < validation, "validation").otherwise("train"))


def capped(df: DataFrame, n: int, seed: int, group: str, *keys: str) -> DataFrame:
    """At most n rows of each group, by hashed order."""
    order = Window.partitionBy(group).orderBy(draw(seed, group, *keys), *keys)
    return df.withColumn("__draw", F.row_number().over(order)).where(F.col("__draw") <= n).drop("__draw")


def negatives(seen: DataFrame, items: DataFrame, n: int | None, seed: int, tries: int = 3, exclude: bool = True) -> DataFrame:
    """n items for each user that the user has no row with, or all such items where there are fewer or n is None.

    Items are coded 0 .. m - 1; for each user tries * n hashed codes are drawn, repeats and seen items dropped, and
    the first n kept in the order of drawing. A draw is shuffled twice, to its item and back to its user's list. Users who are then short of n have seen most items, or there are few:
    theirs are filled up from all their unseen items in hashed order. So the cost is users * n, and for those users a
    multiple of the rows they have or of n. Only n = None makes the product of users and items. Without `exclude` all items
    count as such, also those that the user has.
    """
    m = items.count()
    users = seen.select("user").distinct()
    hashed = [draw(seed, "user", "item"), F.col("item")]

    def unseen(of: DataFrame) -> DataFrame:
        """All items without a row of the user, by codes in runs of bounded length."""
        known = seen.select("user", "item").distinct()
        runs = of.select("user", F.explode(F.sequence(F.lit(0), F.lit(max(m - 1, 0)), F.lit(4096))).alias("low"))
        coded = runs.select("user", F.explode(F.sequence("low", F.least(F.col("low") + 4095, F.lit(max(m - 1, 0))))).alias("code"))
        every = coded.join(items.select("code", "item"), "code")
        return (every.join(known, ["user", "item"], "left_anti") if exclude else every).select("user", "item")

    if n is None:
        return unseen(users).withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(*hashed)))
    own = seen.groupBy("user").agg(F.collect_set("item").alias("own")) if exclude else users.withColumn("own", F.array().cast(ArrayType(items.schema["item"].dataType)))
    codes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(tries * n - 1)), lambda t: draw_int(seed, "user", t) % max(m, 1)))
    drawn = users.select("user", F.posexplode(codes).alias("turn", "code")).join(items.select("code", "item"), "code")
    listed = drawn.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("turn", "item"))).alias("drawn"))
    fresh = F.array_except(F.transform(F.coalesce("drawn", F.array()), lambda d: d["item"]), "own")  # distinct, in the order of drawing
    lists = cut(own.join(listed, "user", "left").select("user", F.slice(fresh, 1, n).alias("items")))
    full, short = lists.where(F.size("items") == n), lists.where(F.size("items") < n)
    filled = full.select("user", F.posexplode("items").alias("place", "item")).select("user", "item", (F.col("place") + 1).alias("place"))
    if short.limit(1).count() == 0:
        return filled
    rest = unseen(short.select("user"))
    pool = short.select("user", F.posexplode("items").alias("turn", "item")).unionByName(rest.withColumn("turn", F.lit(n))).groupBy("user", "item").agg(F.min("turn").alias("turn"))
    place = F.row_number().over(Window.partitionBy("user").orderBy("turn", *hashed))
    return filled.unionByName(pool.withColumn("place", place).where(F.col("place") <= n).select("user", "item", "place"))


def unseen_totals(seen: DataFrame, items: DataFrame) -> DataFrame:
    """user, n, items: how many items each user has no row with, and the sum of their ids.

    What `negatives` gives without n, counted and summed, but by what all items sum up to less the user's own: no row for
    each user and item. Users who have all items have no row here, as there."""
    every = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("item"), F.lit(0)).alias("s")).first()
    times = items.groupBy("item").agg(F.count("*").alias("c"))
    known = seen.select("user", "item").distinct().join(times, "item", "left").groupBy("user").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("item") * F.col("c")), F.lit(0)).alias("s"))
    left = F.lit(every["n"]) - F.col("n")
    return known.select("user", left.alias("n"), (F.lit(every["s"]) - F.col("s")).alias("items")).where("n > 0")


def evaluation_rows(test: DataFrame, sampled: DataFrame) -> DataFrame:
    """Positives with their labels and sampled negatives with label 0."""
    return test.select("user", "item", F.col("label").alias("y_true")).unionByName(sampled.select("user", "item", F.lit(0.0).alias("y_true")))
