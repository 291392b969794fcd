"""Recommendations in parts of blocks, and ridge systems by columns."""

import numpy as np

from tallyrank.operators import factors


def test_recommend_in_parts(spark, monkeypatch):
    for name, value in (("USER_BLOCK", 7), ("ITEM_BLOCK", 9), ("PART", 2)):
        monkeypatch.setattr(factors, name, value)
    draw = np.random.default_rng(2)
    u, v = draw.normal(size=(15, 3)), draw.normal(size=(30, 3))
    table = lambda key, m: spark.createDataFrame([(i, r.tolist(), 0.1 * (i % 3)) for i, r in enumerate(m)], f"{key} long, factors array<double>, bias double")
    seen = {(a, b) for a in range(15) for b in range(30) if (a * b) % 4 == 1}
    found = factors.recommend(table("user", u), table("item", v), spark.createDataFrame(sorted(seen), "user long, item long"), 5)
    scores = np.floor((u @ v.T + 0.1 * (np.arange(15) % 3)[:, None] + 0.1 * (np.arange(30) % 3)) * 1e6 + 0.5) / 1e6
    want = {(a, n, b) for a in range(15) for n, b in enumerate(sorted((b for b in range(30) if (a, b) not in seen), key=lambda b: (-scores[a, b], b))[:5], 1)}
    assert {(r["user"], r["rank"], r["item"]) for r in found.collect()} == want


def test_recommend_to_all_users(spark):
    """The registered query leaves no user out, and items alike are exact whatever was seen of them."""
    from oracle import SMALL

    from tallyrank.plans import registry, tables

    found = registry.queries()["factor_recommend"](spark, SMALL)
    users = tables.interactions(spark, SMALL).select("user").distinct()
    assert users.join(found, "user", "left_anti").count() == 0 < users.where("user % 20 != 0").count()


def test_recommend_of_items_alike(spark, monkeypatch):
    monkeypatch.setattr(factors, "ITEM_BLOCK", 9)
    v = [[float(i % 3 - 1), 1.0] for i in range(90)]
    u = [[1.0, float(a % 2)] for a in range(6)]
    table = lambda key, m: spark.createDataFrame([(i, r, 0.1 * (i % 2)) for i, r in enumerate(m)], f"{key} long, factors array<double>, bias double")
    seen = {(a, b) for a in range(6) for b in range(90) if b % 3 == 2 and b < 12 * a}
    found = factors.recommend(table("user", u), table("item", v), spark.createDataFrame(sorted(seen), "user long, item long"), 4)
    score = lambda a, b: round(u[a][0] * v[b][0] + u[a][1] * v[b][1] + 0.1 * (b % 2), 6)
    want = {(a, n, b) for a in range(6) for n, b in enumerate(sorted((b for b in range(90) if (a, b) not in seen), key=lambda b: (-score(a, b), b))[:4], 1)}
    assert {(r["user"], r["rank"], r["item"]) for r in found.collect()} == want


def test_ridge_by_columns(spark):
    draw = np.random.default_rng(3)
    v, rows = draw.normal(size=(9, 3)), [(u, i, float((u + i) % 5)) for u in range(6) for i in range(9) if (u * i) % 3 != 1]
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "item long, factors array<double>")
    found = factors.ridge_step(spark.createDataFrame(rows, "user long, item long, label double"), items, "user", "item", 0.1)
    for r in found.collect():
        own = [(i, x) for u, i, x in rows if u == r["user"]]
        m, b = v[[i for i, _ in own]], np.array([x for _, x in own])
        assert np.allclose(r["factors"], np.linalg.solve(m.T @ m + 0.1 * len(own) * np.eye(3), m.T @ b))
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each entry
