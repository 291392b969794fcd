"""Blocks of queries and documents: how they meet, and late interaction in parts."""

import numpy as np
from pyspark.sql import functions as F

from tallyrank.operators import dense


def test_few_queries_are_spread(spark):
    """One block of queries does not bring all blocks of documents under one key, and nothing is broadcast."""
    d = spark.range(200).select(F.col("id").cast("int").alias("db"), F.array("id").alias("dids"))
    q = spark.createDataFrame([(0, [7])], "qb int, qids array<long>")
    met = dense.met_blocks(d, q, 200, 1)
    assert sorted(r["db"] for r in met.collect()) == list(range(200))
    assert max(r["count"] for r in met.groupBy("qb", "part").count().collect()) <= dense.DOC_BLOCKS
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_late_in_parts(monkeypatch):
    monkeypatch.setattr(dense, "TOKEN_PART", 7)
    draw = np.random.default_rng(1)
    q_at, d_at = np.r_[0, np.cumsum(draw.integers(1, 12, 9))], np.r_[0, np.cumsum(draw.integers(1, 20, 30))]
    q, d = draw.normal(size=(q_at[-1], 4)), draw.normal(size=(d_at[-1], 4))
    want = [[np.maximum((q[a:b] @ d[x:y].T).max(1), 0.0).sum() for x, y in zip(d_at, d_at[1:])] for a, b in zip(q_at, q_at[1:])]
    assert np.allclose(dense._late(q, q_at, d, d_at), want)


def test_centroid_in_blocks(spark, monkeypatch):
    """Several buckets and blocks, unknown items, repeated rows, a key of unknown items only."""
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 5)
    monkeypatch.setattr(dense, "KEY_BLOCK", 4)
    vectors = {i: [float(i % 4 + 1), float(-i), 2.0] for i in range(20)}
    histories = [(u, (u * 7 + j * j) % 25) for u in range(12) for j in range(u + 1)] + [(99, 1000)]
    known = spark.createDataFrame(list(vectors.items()), "item long, vector array<double>")
    found = {r["user"]: r["vector"] for r in dense.centroid(spark.createDataFrame(histories, "user long, item long"), known, "user", 3).collect()}
    for u in {u for u, _ in histories}:
        mine = [np.array(vectors[i]) / np.linalg.norm(vectors[i]) for v, i in histories if v == u and i in vectors]
        assert np.allclose(found[u], np.mean(mine, axis=0) if mine else [0.0] * 3, atol=1e-6)
    plan = dense.centroid(spark.createDataFrame(histories, "user long, item long"), known, "user", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # no row for each component of each row


def test_search_in_tiles(spark, monkeypatch):
    """Many tiles and parts, ties, ids that are texts, token vectors; no row of blocks with blocks is made."""
    for name, value in (("TILE", 90), ("LEAST", 10), ("QUERY_PART", 4), ("DOC_PART", 7)):
        monkeypatch.setattr(dense, name, value)
    draw = np.random.default_rng(4)
    x = draw.integers(-2, 3, (80, 3)) + 0.5
    docs = spark.createDataFrame([(f"d{i:02}", v.tolist()) for i, v in enumerate(x)], "doc_id string, vector array<float>")
    asked = docs.where("doc_id < 'd30'").select(F.col("doc_id").alias("qid"), "vector")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.floor(unit @ unit.T * 1e6 + 0.5) / 1e6
    found = dense.search(asked, docs, 6, exclude_self=True)
    want = {(f"d{a:02}", f"d{b:02}", n) for a in range(30) for n, b in enumerate(sorted((b for b in range(80) if b != a), key=lambda b: (-scores[a, b], b))[:6], 1)}
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    tokens = lambda rows, key: spark.createDataFrame([(i, [v.tolist() for v in t]) for i, t in rows], f"{key} long, vector array<array<double>>")
    sets = [(i, x[i : i + 1 + i % 4]) for i in range(60)]
    late = lambda q, d: float(np.floor(np.maximum((q @ d.T).max(1), 0.0).sum() * 1e6 + 0.5) / 1e6)
    found = dense.search(tokens(sets[:20], "qid"), tokens(sets, "doc_id"), 5, score="max_sim")
    want = {(a, b, n) for a, q in sets[:20] for n, b in enumerate(sorted(range(60), key=lambda b: (-late(q, sets[b][1]), b))[:5], 1)}
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in found.collect()} == want


def test_vectors_are_made_once(spark):
    """Neither a count nor a condition makes them another time."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<array<double>>")
    def vector(i):
        made.add(1)
        return [[float(i), 1.0]] * (i % 3) if i != 5 else None

    docs = spark.range(30).select(F.col("id").alias("doc_id"), vector("id").alias("vector"))
    asked = spark.createDataFrame([(1, [[1.0, 2.0]])], "qid long, vector array<array<double>>")
    assert len(dense.search(asked, docs, 50, score="max_sim", most=4).collect()) == 19
    assert made.value == 30
