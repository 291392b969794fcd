"""The inverted file against exact search, its recall, and indexes kept by signature."""

import numpy as np
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from tallyrank.operators import ann, dense
from tallyrank.plans import registry
from tallyrank.plans.tables import vectors


def made(spark, n=900, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (30, dim))
    x = centres[rng.integers(30, size=n)] + rng.normal(0, 0.35, (n, dim))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(10_000, None), (10_001, []), (10_002, [0.0] * 11 + [None]), (10_003, [float("nan")] * 12)]
    return spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(4)


def asked(docs):
    return docs.where("doc_id % 9 = 0").select(F.col("doc_id").alias("qid"), "vector")


def test_all_cells_are_exact_and_few_are_near(spark, monkeypatch):
    monkeypatch.setattr(ann, "DOC_BLOCK", 40)
    docs = made(spark)
    whole = docs.where("doc_id < 10000")
    index = ann.build(docs, 30)
    assert index.cells.shape == (30, 12) and sum(len(r["dids"]) for r in index.lists.collect()) == 900
    exact = dense.search(asked(whole), whole, 10)
    every = ann.search(asked(whole), index, 10, 30)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    probes = ann.tuned_probes(asked(whole), index, whole, 10, 0.95)
    found = ann.search(asked(whole), index, 10, probes)
    shares = [r["recall"] for r in ann.recall(found, exact).collect()]
    assert len(shares) == 100 and np.mean(shares) >= 0.9 and probes <= 10  # of 30: these vectors have neighbourhoods
    same = {(r["qid"], r["doc_id"]): r["score"] for r in exact.collect()}
    assert all(same.get((r["qid"], r["doc_id"]), r["score"]) == r["score"] for r in found.collect())


def test_recall_of_the_registered_query(spark):
    rows = registry.queries()["dense_approximate"](spark, SMALL).collect()
    shares = {r["qid"]: r["recall"] for r in rows}
    assert len(shares) == vectors(spark, SMALL).where("doc_id % 20 = 0").count() and np.mean(list(shares.values())) >= 0.9


def test_signatures_and_shelf(spark, tmp_path):
    docs = made(spark, 200)
    name = ann.signature(docs, "doc_id", "vector", settings="a")
    assert name == ann.signature(docs.orderBy(F.desc("doc_id")).repartition(7), "doc_id", "vector", settings="a")
    assert len({name, ann.signature(docs, "doc_id", "vector", settings="b"), ann.signature(docs.where("doc_id > 0"), "doc_id", "vector", settings="a"), ann.signature(docs.unionByName(docs.limit(1)).unionByName(docs.limit(1)), "doc_id", "vector", settings="a")}) == 4
    shelf = ann.Shelf(spark, f"file://{tmp_path}/shelf")
    first = ann.kept_index(shelf, docs, cells=8)
    again = ann.kept_index(shelf, docs.repartition(3), cells=8)
    assert shelf.made == 1 and (first.cells == again.cells).all()
    assert sorted(map(tuple, ann.search(asked(docs), again, 5, 8).collect())) == sorted(map(tuple, ann.search(asked(docs), ann.build(docs, 8), 5, 8).collect()))
    ann.kept_index(shelf, docs.where("doc_id <> 5"), cells=8)
    assert shelf.made == 2
    # by a name, what is there is used without reading a document
    ann.kept_index(shelf, docs, "v1", cells=8)
    broken = docs.withColumn("vector", F.raise_error(F.lit("read")).cast("array<double>"))
    assert ann.search(asked(docs), ann.kept_index(shelf, broken, "v1", cells=8), 5, 8).count() > 0 and shelf.made == 3
    with pytest.raises(Exception, match="read"):
        ann.kept_index(shelf, broken, "v2", cells=8)
    old = ann.Shelf(spark, f"file://{tmp_path}/shelf", days=0)
    ann.kept_index(old, docs, "v1", cells=8)
    assert old.made == 1
