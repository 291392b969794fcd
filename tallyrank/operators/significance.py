"""Paired tests of models over repeated runs. Metric rows: RunId, Model, K, Metric, Value."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scalars import quantised, scientific

MARK = "▲"


def paired(metrics: DataFrame) -> DataFrame:
    """Metric, K, RunId, Model_A, Model_B, a, b for each pair of models (A before B) in runs that have all models."""
    cells = metrics.groupBy("Metric", "K", "RunId", "Model").agg(F.avg("Value").alias("v")).where("v is not null")
    models = cells.groupBy("Metric", "K").agg(F.countDistinct("Model").alias("m"))
    whole = cells.groupBy("Metric", "K", "RunId").agg(F.count("*").alias("have")).join(models, ["Metric", "K"]).where("have = m").select("Metric", "K", "RunId")
    kept = cells.join(whole, ["Metric", "K", "RunId"], "left_semi")
    a = kept.select("Metric", "K", "RunId", F.col("Model").alias("Model_A"), F.col("v").alias("a"))
    b = kept.select("Metric", "K", "RunId", F.col("Model").alias("Model_B"), F.col("v").alias("b"))
    return a.join(b, ["Metric", "K", "RunId"]).where("Model_A < Model_B")


KEYS = ["Metric", "K", "Model_A", "Model_B"]


def t_statistic(pairs: DataFrame, min_runs: int = 2) -> DataFrame:
    """Means, mean difference and the paired t statistic (null where differences do not vary)."""
    d = F.col("a") - F.col("b")
    rows = pairs.groupBy(*KEYS).agg(F.count("*").alias("N_runs"), F.avg("a").alias("mean_A"), F.avg("b").alias("mean_B"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    out = rows.where(F.col("N_runs") >= max(2, min_runs))
    t = F.when(F.col("sd") > 1e-15, F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("N_runs").cast("double"))))
    t = F.when(t.isNotNull(), t).when(F.abs("mean_diff") <= 1e-12, F.lit(0.0))
    return out.select(*KEYS, "N_runs", quantised("mean_A", 9).alias("mean_A"), quantised("mean_B", 9).alias("mean_B"), quantised("mean_diff", 9).alias("mean_diff"), quantised(t).alias("statistic"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """W+ and W- of the non-zero differences, ties with their mean rank; the lesser one is the statistic."""
    rows = pairs.withColumn("d", quantised(F.col("a") - F.col("b"), 12)).where("d != 0").withColumn("size", F.abs("d"))
    by = Window.partitionBy(*KEYS)
    first = F.rank().over(by.orderBy("size"))
    same = F.count("*").over(Window.partitionBy(*KEYS, "size"))
    ranked = rows.withColumn("rank", first + (same - 1) / 2.0).withColumn("same", same)
    plus, minus = (F.sum(F.when(c, F.col("rank")).otherwise(0.0)) for c in (F.col("d") > 0, F.col("d") < 0))
    # a tie group of t ranks adds t^3 - t, that is t^2 - 1 for each of its rows
    out = ranked.groupBy(*KEYS).agg(F.count("*").alias("N_effective"), plus.alias("W_plus"), minus.alias("W_minus"), F.sum(F.pow("same", 2) - 1).alias("ties"))
    return out.withColumn("statistic", F.least("W_plus", "W_minus"))


def wilcoxon_p(w: float, n: int, ties: float) -> float:
    """Two-sided: the exact null distribution up to 50 differences without ties, else the normal approximation."""
    if n == 0:
        return 1.0
    if not ties and n <= 50:
        ways = [1] + [0] * (n * (n + 1) // 2)  # ways to reach each sum of ranks
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


def student_p(t: float, df: int) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function by its continued fraction."""
    if not math.isfinite(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    # modified Lentz evaluation
    tiny = 1e-300
    c, d, h = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny), 0.0
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def _diagnostics(pairs: DataFrame, stats: DataFrame, p_of: Callable, name: str, alpha: float) -> DataFrame:
    """The p-values of a handful of rows (model pairs x metrics x cut-offs), worked out on the driver."""
    spark = pairs.sparkSession
    rows = [(*[r[k] for k in KEYS], float(p_of(r))) for r in stats.collect() if r["statistic"] is not None]
    schema = StructType([pairs.schema[k] for k in KEYS] + [StructField("p_value", DoubleType())])
    p = spark.createDataFrame(rows, schema)
    means = pairs.groupBy(*KEYS).agg(F.count("*").alias("N_runs"), F.avg("a").alias("mean_A"), F.avg("b").alias("mean_B"))
    out = means.join(stats.select(*KEYS, *[c for c in ("N_effective", "statistic") if c in stats.columns]), KEYS).join(p, KEYS)
    if "N_effective" not in out.columns:
        out = out.withColumn("N_effective", F.col("N_runs"))
    winner = F.when(F.col("mean_A") > F.col("mean_B"), F.col("Model_A")).when(F.col("mean_B") > F.col("mean_A"), F.col("Model_B"))
    return out.select(
        F.lit(name).alias("Test"), "Metric", "K", "Model_A", "Model_B", "N_runs", "N_effective", "statistic", "p_value", "mean_A", "mean_B",
        (F.col("mean_A") - F.col("mean_B")).alias("mean_diff"), winner.alias("Winner"), (F.col("p_value") < alpha).alias("Significant"), F.lit(alpha).alias("alpha"),
    )


def wilcoxon(metrics: DataFrame, alpha: float = 0.05, min_runs: int = 6) -> DataFrame:
    pairs = paired(metrics)
    enough = pairs.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= min_runs).select(*KEYS)
    pairs = pairs.join(enough, KEYS, "left_semi")
    return _diagnostics(pairs, signed_ranks(pairs), lambda r: wilcoxon_p(r["statistic"], r["N_effective"], r["ties"]), "wilcoxon", alpha)


def t_test(metrics: DataFrame, alpha: float = 0.05, min_runs: int = 2) -> DataFrame:
    pairs = paired(metrics)
    return _diagnostics(pairs, t_statistic(pairs, min_runs), lambda r: 1.0 if not r["statistic"] else student_p(r["statistic"], r["N_runs"] - 1), "ttest", alpha)


#: Tests by name; all names of one test are alike.
TESTS: dict[str, Callable[..., DataFrame]] = {"wilcoxon": wilcoxon} | dict.fromkeys(("ttest", "t_test", "t-test", "paired_ttest", "ttest_rel"), t_test)
MIN_RUNS = {"wilcoxon": 6, "ttest": 2}


def register(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TESTS[name] = f
        return f

    return add


def marked(metrics: DataFrame, diagnostics: DataFrame, symbol: str = MARK) -> DataFrame:
    """Metric, K, Model and the mean as text, with a mark on models that won a significant comparison."""
    means = metrics.groupBy("Metric", "K", "Model").agg(F.avg("Value").alias("mean"))
    won = diagnostics.where("Significant and Winner is not null").select("Metric", "K", F.col("Winner").alias("Model")).distinct().withColumn("won", F.lit(symbol))
    return means.join(won, ["Metric", "K", "Model"], "left").select("Metric", "K", "Model", F.concat(scientific("mean"), F.coalesce("won", F.lit(""))).alias("shown"))
