"""Neighbours by blocks of the Gram matrix against plain loops."""

import math
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tallyrank.operators import neighbours


def plain(rows, kind, shrinkage):
    """{(item, other): (sim, common)} of (user, item, label) rows."""
    users = {}
    for u, i, x in rows:
        users.setdefault(u, []).append((i, x))
    if kind == "adjusted":
        means = {u: sum(x for _, x in h) / len(h) for u, h in users.items()}
        values = {u: [(i, x - means[u]) for i, x in h] for u, h in users.items()}
    else:
        values = users
    size, n, dot, common, met = {}, {}, {}, {}, set()
    for h in values.values():
        for i, x in h:
            if kind != "adjusted" or x:
                size[i], n[i] = size.get(i, 0.0) + x * x, n.get(i, 0) + 1
        for (i, x), (j, y) in product(h, h):
            if i != j:
                dot[i, j], common[i, j] = dot.get((i, j), 0.0) + x * y, common.get((i, j), 0) + 1
                if x and y or kind != "adjusted":
                    met.add((i, j))
    out = {}
    for i, j in met:
        c = common[i, j]
        sim = c / (n[i] + n[j] - c) if kind == "jaccard" else dot[i, j] / ((math.sqrt(size[i]) + 1e-12) * (math.sqrt(size[j]) + 1e-12) + 1e-12)
        out[i, j] = (sim * c / (c + shrinkage + 1e-12), c)
    return out


@pytest.mark.parametrize("kind", ["cosine", "jaccard", "adjusted"])
@pytest.mark.parametrize("named", [False, True])
def test_blocks(spark, monkeypatch, kind, named):
    """Many blocks, items of more pairs than a block may have, ids that are numbers or texts."""
    monkeypatch.setattr(neighbours, "PAIRS", 256)
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(60) for i in range(40) if (u * 7 + i * i) % 6 == 0 or i == 3]
    if named:
        rows = [(u, f"p{i}", x) for u, i, x in rows]
    df = spark.createDataFrame(rows, f"user long, item {'string' if named else 'long'}, label double")
    want = plain(rows, kind, 2.0)
    found = {(r["item"], r["other"]): (r["sim"], r["common"]) for r in neighbours.similarities(df, kind, 2.0).collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[x][0] - want[x][0]) < 1e-6 and found[x][1] == want[x][1] for x in want)
    nearest = neighbours.nearest(df, kind, 2.0, 5, 0.02)
    best = sorted((r["item"], r["place"], r["other"]) for r in nearest.collect())
    again = sorted((r["item"], r["place"], r["other"]) for r in neighbours.top_neighbours(spark.createDataFrame([(*x, *v) for x, v in found.items()], "item {0}, other {0}, sim double, common long".format("string" if named else "long")), 5, 0.02).collect())
    assert best == again
    assert "Join" not in nearest._jdf.queryExecution().executedPlan().toString()  # no row for a pair of items is shuffled


def test_lists_are_sent_packed():
    """Lists that go to blocks together take few bytes an item."""
    draw = np.random.default_rng(1)
    lists = [sorted(draw.choice(20_000, 60, replace=False).tolist()) for _ in range(500)]
    column = lambda rows: pa.array(rows, pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), column([[float(i % 5 + 1) for i in h] for h in lists]), column([[float(i % 300) for i in h] for h in lists]), pa.array([0.0] * 500)], names=["items", "xs", "stats", "mean"])
    sent = list(neighbours._sent(neighbours._block_of([10_000], 2), 2)(iter([batch])))
    assert sum(b.num_rows for b in sent) == 2
    assert sum(b.nbytes for b in sent) < 8 * sum(map(len, lists)) * 2


def test_ratings_are_read_once(spark):
    """Neighbours and scores come of the same histories."""
    from oracle import SMALL

    from tallyrank.plans import registry

    for name in ("knn_score", "knn_recommend", "knn_score_centred"):
        assert "lineitem" not in registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
