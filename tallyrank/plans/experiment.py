"""Experiments: a nested dict of data set, models, execution and evaluation, run stage by stage.

Stages: preprocess, features, train, index, eval. What a stage gives is kept as Parquet under a folder named by the
hash of the settings that matter (execution and seeds are left out), so a later run finds what an earlier one made:
`features` keeps the split and the evaluation rows, `index` the documents that a search scorer indexes. The folder may
be on any file system that Spark knows.

Bridging strategies (`hybrid` and `hybridStrategie`) turn one task's data into the other's: query-as-user and
retrieval-as-user give interactions from search data, centroid-vector and tag-query give queries from histories.
"""

from __future__ import annotations

import copy
import hashlib
import inspect
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, dense, history, interactions, metrics, significance, splits
from ..sources import sinks
from ..sources.readers import LOADERS, exists, get_loader, plain_name
from . import (
    builders,
    loaders,  # noqa: F401  (registers its loaders)
)
from .configs import resolved, strategy
from .models import MODELS, Model, register_model
from .scorers import SCORERS, register_scorer

__all__ = ["MODELS", "SCORERS", "Model", "register_model", "register_scorer", "run"]

STAGES = ("preprocess", "features", "train", "index", "eval")
TASKS = ("recs", "search")
#: Positives and negatives of an evaluation that does not say.
SAMPLES = {"recs": (20, 200), "search": (50, 1000)}
# Words for "no limit".
NO_LIMIT = ["", "none", "null", "inf", "infinite", "infinity", "all", "unlimited", "no_limit", "nolimit"]


def unlimited(value: object) -> int | None:
    """A number of rows; words for no limit, what is no number, and what is not above 0 mean no limit."""
    if isinstance(value, str):
        value = None if value.strip().lower() in NO_LIMIT else value.strip()
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return None if number != number or number == float("inf") or number <= 0 else int(number)


def merged(*configs: dict) -> dict:
    """Later settings over earlier ones, all the way down."""
    out: dict = {}
    for config in configs:
        for key, value in config.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def fingerprint(config: dict) -> str:
    """Ten hexadecimal digits for what a run is, without how it is carried out."""
    bare = {k: v for k, v in config.items() if k not in ("execution", "seed")}
    return hashlib.sha1(json.dumps(bare, sort_keys=True, default=str).encode()).hexdigest()[:10]


@dataclass
class Control:
    """Which stages to skip, to force, and whether to keep results."""

    skip: set[str] = field(default_factory=set)
    force: set[str] = field(default_factory=set)
    save: bool = True
    runs: int = 1

    @classmethod
    def of(cls, config: dict, tests: list[str]) -> Control:
        execution = config.get("execution", {})
        unknown = [t for t in tests if t.lower() not in significance.TESTS]
        if unknown:
            raise ValueError(f"unknown tests {unknown}")
        least = max([1, *(significance.MIN_RUNS["wilcoxon" if t.lower() == "wilcoxon" else "ttest"] for t in tests)])
        return cls(set(execution.get("skip", [])), set(execution.get("force", [])), not execution.get("no_save", False), max(least, int(execution.get("n_runs", 1))))

    def active(self, stage: str) -> bool:
        return stage not in self.skip or stage in self.force


class Store:
    """Parquet tables and JSON of one run, and the newest earlier run with the same settings."""

    def __init__(self, spark: SparkSession, root: str, name: str, digest: str, run: int):
        self.spark, self.top = spark, f"{root.rstrip('/')}/{name}/{digest}"
        self.path = f"{self.top}/run_{run}"

    def write(self, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{key}")
        return self.spark.read.parquet(f"{self.path}/{key}")

    def _earlier(self) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [(s.getModificationTime(), s.getPath().toString()) for s in system.listStatus(place) if s.isDirectory()] if system.exists(place) else []
        return [path for _, path in sorted(found, reverse=True)]

    def find(self, key: str) -> DataFrame | None:
        for path in [self.path, *self._earlier()]:
            if exists(self.spark, f"{path}/{key}/_SUCCESS"):
                return self.spark.read.parquet(f"{path}/{key}")
        return None

    def kept(self, key: str, make: Callable[[], DataFrame], control: Control, stage: str) -> DataFrame:
        """What an earlier run kept, if the stage is skipped; else what is made, and kept."""
        found = None if control.active(stage) else self.find(key)
        if found is not None:
            return found
        return self.write(key, make()) if control.save else make()

    def json(self, key: str, value: object) -> None:
        sinks.write_text(self.spark, json.dumps(value, indent=1, sort_keys=True, default=str), f"{self.path}/{key}.json")


def validate(config: dict) -> None:
    if config.get("task_type") not in TASKS:
        raise ValueError(f"task_type is one of {TASKS}")
    if not config.get("model"):
        raise ValueError("no model")
    known = MODELS if config["task_type"] == "recs" else SCORERS
    if unknown := [m["name"] for m in config["model"] if plain_name(m["name"] or "") not in known]:
        raise ValueError(f"no such models: {unknown}; there are {sorted(known)}")
    strategy(config)


def run(spark: SparkSession, config: dict, root: str | None = None, say: Callable[[str], None] = print, base: str | None = None) -> DataFrame:
    """All runs and models of an experiment: metric rows RunId, Model, K, Metric, Value; reports go to the folder `root`
    (or the settings' output_dir). `base` has the JSON files that names in the settings lead to."""
    if isinstance(config.get("model"), list) and not all(isinstance(m, (str, dict)) and m for m in config["model"]):
        validate(config)
    config = resolved(config, base)
    validate(config)
    root = root or config.get("output_dir", "artifacts")
    evaluation = config.get("evaluation", {})
    tests = evaluation.get("tests", [])
    control = Control.of(config, tests)
    name, out, began = config.get("experiment_name", "experiment"), None, time.perf_counter()
    work = _recs if config["task_type"] == "recs" else _search
    data: dict[str, DataFrame] | None = None
    for number in range(1, control.runs + 1):
        for setting in config["model"]:
            own = merged({k: v for k, v in config.items() if k != "model"}, {"model": setting, "fold": number - 1})
            store = Store(spark, root, name, fingerprint(own), number)
            kept = None if control.active("eval") else store.find("metrics")
            if kept is None:
                if data is None:
                    data = _timed("preprocess", say, lambda: _data(spark, config))
                kept = work(own, data, number, store, control, say)
            if control.save:
                store.json("config", own)
                sinks.write_report(sinks.wide(kept).orderBy("K"), f"{store.path}/metrics.csv")
            rows = kept.select(F.lit(str(number)).alias("RunId"), F.lit(setting["name"]).alias("Model"), "K", "Metric", "Value")
            out = rows if out is None else out.unionByName(rows)
    if control.save:
        folder = f"{root.rstrip('/')}/{name}"
        out = Store(spark, root, name, "all", 0).write("metrics", out)
        _reports(spark, out, folder, tests, evaluation)
    say(f"total: {time.perf_counter() - began:.2f} s")
    return out


def _reports(spark: SparkSession, out: DataFrame, folder: str, tests: list[str], evaluation: dict) -> None:
    """Reports of a few rows: CSV and LaTeX of the summary (the best in bold), each model and each run, and the tests."""
    summary = sinks.summary(out).orderBy("Model", "K", "Metric")
    sinks.write_report(summary, f"{folder}/summary.csv")
    sinks.write_report(sinks.by_run(out).orderBy("RunId", "Model"), f"{folder}/runs.csv")
    rows = summary.collect()
    for metric in sorted({r["Metric"] for r in rows}):
        wide = summary.where(F.col("Metric") == metric).groupBy("Model").pivot("K").agg(F.first("mean")).orderBy("Model")
        models = sorted({r["Model"] for r in rows if r["Metric"] == metric})
        best = {(models.index(r["Model"]), str(r["K"])): r["best"] for r in rows if r["Metric"] == metric}
        sinks.write_text(spark, sinks.latex(wide, f"{metric} of all models", best), f"{folder}/{slugged(metric)}.tex")
    for model in sorted({r["Model"] for r in rows}):
        sinks.write_report(sinks.wide(out.where(F.col("Model") == model)).orderBy("K"), f"{folder}/{slugged(model)}_means.csv")
    for test in tests:
        found = significance.TESTS[test.lower()](out, alpha=evaluation.get("alpha", 0.05))
        sinks.write_report(found, f"{folder}/{slugged(test)}_diagnostics.csv")
        marked = significance.marked(out, found, evaluation["symbol"]) if "symbol" in evaluation else significance.marked(out, found)
        sinks.write_report(marked, f"{folder}/{slugged(test)}_marked.csv")


def slugged(name: str) -> str:
    return sinks.slug(name)


def _timed(stage: str, say: Callable[[str], None], work: Callable):
    began = time.perf_counter()
    out = work()
    say(f"{stage}: {time.perf_counter() - began:.2f} s")
    return out


def _data(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """What the loader gives: one table of rows, or several by name (rows, docs, tags, vectors)."""
    name, params = config["dataset"]["name"], config["dataset"].get("params", {})
    own = f"{name}_search"  # a data set may be read in another way for search
    load = get_loader(own if config.get("task_type") == "search" and not strategy(config) and plain_name(own) in LOADERS else name)
    taken = inspect.signature(load).parameters
    if not any(p.kind is inspect.Parameter.VAR_KEYWORD for p in taken.values()):
        params = {k: v for k, v in params.items() if k in taken}  # the others are the runner's
    found = load(spark, **params)
    return found if isinstance(found, dict) else {"rows": found}


def _counts(config: dict) -> tuple[int | None, int | None]:
    evaluation, (positives, negatives) = config.get("evaluation", {}), SAMPLES[config["task_type"]]
    return unlimited(evaluation.get("positives", positives)), unlimited(evaluation.get("negatives", negatives))


def bridged(config: dict, data: dict[str, DataFrame]) -> DataFrame:
    """Interactions from search data: each query a user of its documents, or of the documents that BM25 finds for it."""
    rows = data["rows"]
    if strategy(config) == "query-as-user":
        return rows.select(F.col("search_query").alias("user"), F.col("document_id").alias("item"), *[F.col(c) if c in rows.columns else F.lit(v).alias(c) for c, v in (("label", 1.0), ("time", 0))])
    params = config["dataset"].get("params", {})
    k, limit, seed = int(params.get("top_k", 100)), unlimited(params.get("query_limit")), int(params.get("seed", 42))
    if "tags" in data:
        return builders.retrieval_by_tag(data["docs"], data["tags"], k, query_limit=limit, max_docs=unlimited(params.get("max_docs")), seed=seed)
    docs = data["docs"] if "docs" in data else rows.select(F.col("document_id").alias("item"), F.col("document").alias("text")).distinct()
    if "search_query" not in rows.columns:
        return builders.retrieval_by_profile(interactions.canonical(rows), docs, k, query_limit=limit, seed=seed)
    asked = builders.limited(rows.select(F.col("search_query").alias("query")).distinct(), limit, seed)
    index = bm25.build(bm25.corpus(docs.select(F.col("item").alias("doc_id"), "text")))
    return bm25.retrieval_as_user(bm25.scores(index, asked, "query", "query"), k, "query")


def _recs(config: dict, data: dict[str, DataFrame], number: int, store: Store, control: Control, say) -> DataFrame:
    split, evaluation = config.get("split", {}), config.get("evaluation", {})
    raw = bridged(config, data) if strategy(config) else data["rows"]
    rows = interactions.canonical(raw)
    if (least := config.get("min_rating", config["dataset"].get("params", {}).get("min_rating"))) is not None:
        rows = interactions.require_rows(interactions.min_label(rows, float(least)), f"labels of {least} or more")
    positives, negatives = _counts(config)
    folds = max(int(split.get("num_folds", 3)), control.runs)

    def parted() -> DataFrame:
        return splits.temporal(rows, number - 1, folds, split.get("test", 0.2), split.get("window", 0.05), positives, number)

    parts = _timed("features", say, lambda: store.kept("parts", parted, control, "features"))
    train = parts.where("part = 'train'").select("user", "item", "label", "time")
    test = parts.where("part = 'test'").groupBy("user", "item").agg(F.max("label").alias("label"))

    def sampled() -> DataFrame:
        items = interactions.encoded(interactions.universe(train, test), "item", "code")
        return splits.evaluation_rows(test, splits.negatives(parts, items, negatives, number))

    pairs = store.kept("pairs", sampled, control, "features")
    model = MODELS[plain_name(config["model"]["name"])](**config["model"].get("params", {}))

    def fitted() -> dict[str, DataFrame]:
        found = {} if control.active("train") else {n: t for n in model.tables if (t := store.find(f"model/{n}")) is not None}
        if found and len(found) == len(model.tables):
            return found
        tables = model.fit(train)
        return {k: store.write(f"model/{k}", v) for k, v in tables.items()} if control.save else tables

    tables = _timed("train", say, fitted)
    scored = model.score(pairs, tables, train).select(F.col("user").alias("gid"), "item", "y_true", F.col("score").alias("y_pred"))
    out = metrics.evaluate(scored, evaluation.get("top_ks", [10]), evaluation.get("metrics"), skip_empty=True)
    out = _timed("eval", say, lambda: store.write("metrics", out) if control.save else out)
    if not out.limit(1).count():
        raise ValueError("no user with a relevant row is left to evaluate")
    return out


def _search(config: dict, data: dict[str, DataFrame], number: int, store: Store, control: Control, say) -> DataFrame:
    """Full-corpus evaluation: a test query's relevant documents are those of its pairs. With `candidates`, or a strategy,
    each query's sampled candidates are scored instead."""
    evaluation, params = config.get("evaluation", {}), dict(config["model"].get("params", {}))
    if "vectors" in data:
        params.setdefault("vectors", data["vectors"])
    scorer = SCORERS[plain_name(config["model"]["name"])](**params)
    way = strategy(config)
    positives, negatives = _counts(config)
    depth = int(evaluation.get("depth", 50))
    if way:
        docs, asked, rows = _histories(config, data, way, positives, negatives, number)
    else:
        docs, asked, rows = _pairs(config, data["rows"], positives, negatives, number, bool(evaluation.get("candidates")))
    docs = _timed("index", say, lambda: store.kept("docs", lambda: bm25.corpus(docs), control, "index"))
    index = scorer.index(docs)
    if way == "centroid-vector":
        # a history's query is the mean of its documents' vectors
        vectors = index.select(F.col("doc_id").alias("item"), "vector")
        dim = vectors.select(F.size("vector").alias("n")).limit(1).collect()
        asked = dense.centroid(asked, vectors, "qid", dim[0]["n"] if dim else 1)
    if way or evaluation.get("candidates"):
        scored = scorer.candidates(index, asked, rows).select(F.col("qid").alias("gid"), F.col("doc_id").alias("item"), "y_true", F.col("score").alias("y_pred"))
    else:
        hits = scorer.full(index, asked, depth).select("qid", "doc_id", "score")
        scored = bm25.full_rows(hits, rows, depth).withColumnRenamed("qid", "gid")
    out = metrics.evaluate(scored, evaluation.get("top_ks", [10]), evaluation.get("metrics"))
    return _timed("eval", say, lambda: store.write("metrics", out) if control.save else out)


def _pairs(config: dict, pairs: DataFrame, positives: int | None, negatives: int | None, number: int, sampled: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, test queries (qid, text), and their relevant documents or candidate rows."""
    split = config.get("split", {})
    shares = splits.SplitConfig(split.get("test", 0.3), split.get("validation", 0.1), number)
    parts = splits.random_pairs(pairs, shares, "search_query", "document_id")
    docs = parts.select(F.col("document_id").alias("doc_id"), F.col("document").alias("text"))
    test = parts.where("part = 'test'")
    rows = test.select(F.col("search_query").alias("qid"), F.col("document_id").alias("doc_id")).distinct()
    asked = rows.select("qid", F.col("qid").alias("text")).distinct()
    if sampled:
        drawn = builders.sampled_search(test, pairs, positives or 2**31 - 1, negatives, number)
        rows = _candidates(drawn.withColumnRenamed("user", "qid"))
    return docs, asked, rows


def _candidates(rows: DataFrame) -> DataFrame:
    one = rows.select("qid", "ground_truth_ids", F.explode("candidate_ids").alias("doc_id"))
    return one.select("qid", "doc_id", F.array_contains("ground_truth_ids", F.col("doc_id")).cast("double").alias("y_true"))


def _histories(config: dict, data: dict[str, DataFrame], way: str, positives: int | None, negatives: int | None, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (item texts), queries from the first half of each user's last rows, and candidates for the other half."""
    rows = interactions.canonical(data["rows"]).withColumn("item", F.col("item").cast("string"))
    docs = data["docs"].select(F.col("item").cast("string").alias("item"), "text")
    halves = history.half_query_truth(rows, int(config.get("split", {}).get("last", 40)))
    halves = halves.where("size(query_ids) > 0 and size(ground_truth_ids) > 0")
    if positives is not None:
        halves = halves.withColumn("ground_truth_ids", F.slice("ground_truth_ids", 1, positives))
    items = interactions.encoded(interactions.universe(rows, docs), "item", "code")
    found = history.candidate_rows(halves, splits.negatives(rows, items, negatives, number)).withColumnRenamed("user", "qid")
    own = halves.select(F.col("user").alias("qid"), F.explode("query_ids").alias("item")).distinct()
    if way == "tag-query":
        own = bm25.tag_query(own, data.get("tags"), 15, "qid").select("qid", F.col("search_query").alias("text"))
    return docs.withColumnRenamed("item", "doc_id"), own, _candidates(found)
