"""Quality rules, change points and centroid clusters against brute force, and on odd tables."""

import base64
import datetime
import hashlib
import math
import random
import re

import numpy as np
import pytest
import zstandard
from cases import ODD, documents
from oracle import SMALL

from tallyrank.llm import centroids, change_points, quality_rules, queries

# --- 11: quality rules ----------------------------------------------------------------------------------------------


def rules_by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 600 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = set()
    for i, w in enumerate(windows):
        if w in twice:
            covered |= set(range(i, i + 8))
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    raw = text.encode()
    zstd = zstandard.ZstdCompressor(level=3)

    def fits(part):
        ratio = len(zstd.compress(part)) / len(part)
        return next(low <= ratio <= high for edge, low, high in quality_rules.BANDS if len(part) < edge)

    parts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    kept = not base and fits(raw) and sum(len(p) for p in parts if not fits(p)) <= 0.3 * len(raw)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered), base, kept


def rule_texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéfghilmnoprstu", k=rng.randint(2, 9))) for _ in range(4000)]
    some = lambda k: " ".join(rng.choices(vocabulary, k=k))
    line = some(12)
    noise = base64.b64encode(rng.randbytes(30_000)).decode()
    spaced = " ".join(noise[i : i + 7] for i in range(0, len(noise), 7))
    a = some(9)
    return [
        some(400), some(19), some(20), "\n".join([line] * 60), "\n".join([some(9), line, line + " ", line, "", "", " ", line]), some(500) + "\n" + "\n".join([line] * 8), spaced, some(4000) + " " + spaced, some(9000) + " " + spaced[:3000],
        " ".join([*["again"] * 9, some(30)]), f"{a} x {a} {some(70)}", "<p>**#|$%& " + some(50), some(3000) + " " + "once more " * 4000, "é" * 50 + " ü" * 50, "a b c d e f g h " * 2 + some(200),
    ]


def test_quality_rules(spark):
    texts = rule_texts() + ODD
    docs = documents(spark, texts + texts[:3])
    out = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert len(out) == len(texts) + 3
    for i, t in enumerate(texts + texts[:3]):
        assert tuple(out[i][c] for c in (*quality_rules.MEASURES, "base_failed", "kept")) == rules_by_force(t), i
    verdicts = [out[i]["kept"] for i in range(15)]
    assert verdicts[:9] == [True, False, True, False, False, True, False, False, True]  # noise and half noise go, a little noise stays
    assert out[3]["ratio"] < 0.1 and out[6]["ratio"] > 0.7 and out[len(texts) - len(ODD)]["ratio"] is None
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_quality_rules_of_a_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op11_quality_rules(spark, SMALL).collect()
    assert {r["doc_id"]: tuple(r[c] for c in (*quality_rules.MEASURES, "base_failed", "kept")) for r in out} == {d: rules_by_force(t) for d, t in docs.items()}


def test_quality_rules_leave_good_texts_alone(spark):
    folder = SMALL.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [r for r in queries.op11_quality_rules(spark, folder).collect() if r["n_words"] >= 20]
    assert all(r["kept"] for r in out if labels.get(r["doc_id"]) == 1)
    bad = [r for r in out if labels.get(r["doc_id"]) == 0]
    assert sum(not r["kept"] for r in bad) > 0.4 * len(bad)


# --- 12: change points ----------------------------------------------------------------------------------------------
def cuts_by_force(q, penalty=change_points.PENALTY, least=change_points.SHORTEST):
    """All segmentations in order, by plain dynamic programming over (cost, segments, starts from the last one)."""
    n = len(q)

    def one(a, b):
        m, s, ss = b - a, sum(q[a:b]), sum(x * x for x in q[a:b])
        v = 1 + (m * ss - s * s) // (m * m)
        return m, s, v, m * math.floor(1000 * math.log(v))

    best = [(0, 0, ())] + [None] * n
    for j in range(least, n + 1):
        best[j] = min((best[i][0] + one(i, j)[3] + (penalty if i else 0), best[i][1] + 1, (i, *best[i][2])) for i in range(j - least + 1) if best[i])
    starts = list(best[n][2][::-1]) if n >= least else [0]
    parts = [one(a, b) for a, b in zip(starts, [*starts[1:], n], strict=True)]
    return [(k, a, *p, len(starts), sum(x[3] for x in parts) + penalty * (len(starts) - 1)) for k, (a, p) in enumerate(zip(starts, parts, strict=True), 1)]


def made_series(seed, many, longest):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(many):
        n = int(rng.integers(1, longest))
        level = np.repeat(rng.choice([0, 3, 40, 900], n // 6 + 1), 6)[:n]
        q = level * (rng.random(n) < 0.8) + rng.integers(0, 4, n) * rng.integers(0, 2)
        out.append([int(x) for x in (q if rng.random() < 0.8 else np.full(n, 5))])
    return out


@pytest.mark.parametrize("penalty,block,cells,days", [(10_000, 256, 1 << 19, 1 << 16), (0, 5, 100, 50), (700, 7, 1 << 19, 200)])
def test_cuts_are_the_best_ones(monkeypatch, penalty, block, cells, days):
    monkeypatch.setattr(change_points, "BLOCK", block)
    monkeypatch.setattr(change_points, "CELLS", cells)
    monkeypatch.setattr(change_points, "DAYS", days)
    series = made_series(penalty, 60, 70)
    bounds = np.cumsum([0, *map(len, series)])
    dates, values = np.concatenate([np.arange(len(q)) for q in series]), np.concatenate(series)
    for totals in (values, values.astype(object), values * 10**9):
        of, rows = change_points.solved(dates, totals, bounds, penalty, 5)
        for s, q in enumerate(series):
            expected = cuts_by_force(q if totals[0] == values[0] and (totals == values).all() else [x * 10**9 for x in q], penalty)
            assert [r[:4] + r[5:] for o, r in zip(of, rows, strict=True) if o == s] == [e[:4] + e[5:] for e in expected]


def test_change_points_of_rows(spark):
    """Nulls, repeated rows, a null key, a hot key, days without rows, short series, clashing columns, an empty table."""
    rng = random.Random(5)
    day = lambda d: datetime.datetime(2024, 1, 1, rng.randrange(24)) + datetime.timedelta(days=d)
    rows = [(v, rng.choice([1, 2, 50, None]), None if rng.random() < 0.05 else day(rng.randrange(60) if v != 4 else rng.randrange(3)), 1, "x") for v in (1, 2, 3, 4, None) for _ in range(80)]
    rows += [(7, 10**9 * (1 + d // 15), day(d), 1, "x") for d in range(30)] + [(8, 3, day(9), 1, "x")] * 2 + [(9, None, day(1), 1, "x")] + rows[:7]
    schema = "vendor_id long, quantity long, shipped_at timestamp_ntz, segment_no int, __day string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    series = {}
    for v, q, at, *_ in rows:
        if q is not None and at is not None:
            own = series.setdefault(v, {})
            d = (at.date() - datetime.date(1970, 1, 1)).days
            own[d] = own.get(d, 0) + q
    expected = []
    for v, own in series.items():
        first = min(own)
        for k, a, *rest in cuts_by_force([own.get(d, 0) for d in range(first, max(own) + 1)]):
            expected.append((v, k, first + a, *rest))
    out = change_points.segments(df, "vendor_id", "shipped_at", "quantity")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    assert change_points.segments(df.limit(0), "vendor_id", "shipped_at", "quantity").collect() == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_long_series_in_blocks():
    q = [x for k in range(12) for x in ([k % 3 * 200] * 40 if k % 2 else [5, 900] * 20)]
    _, rows = change_points.solved(np.arange(len(q)), np.array(q), np.array([0, len(q)]), 10_000, 5)
    assert [r[:4] + r[5:] for r in rows] == [e[:4] + e[5:] for e in cuts_by_force(q)]


# --- 13: centroids --------------------------------------------------------------------------------------------------
def clusters_by_force(rows, k, rounds, dim):
    keep = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(keep, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in keep]
        for j in range(len(c)):
            members = [v for (_, v), o in zip(keep, own, strict=True) if o == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    at = [nearest(v) for _, v in keep]
    most = 2**63 - 1
    inertia = [min(most, sum(min(most, d) for d, o in at if o == j)) for j in range(len(c))]
    total = min(most, sum(min(most, d) for d, _ in at))
    return sorted([(i, o, min(most, d), inertia[o], total, hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), (d, o) in zip(keep, at, strict=True)], key=str)


@pytest.mark.parametrize("block,rows,k,wide", [(4096, 300, 8, False), (7, 120, 5, False), (5, 60, 4, True), (4096, 3, 8, False)])
def test_clusters(spark, monkeypatch, block, rows, k, wide):
    monkeypatch.setattr(centroids, "BLOCK", block)
    monkeypatch.setattr(centroids, "BUCKET", 3)
    rng = np.random.default_rng(rows)
    centres = rng.normal(0, 1, (5, 6))
    table = [(int(i), [float(x) for x in centres[rng.integers(5)] + rng.normal(0, 0.4, 6)]) for i in rng.permutation(rows)]
    table += table[:9] + [(None, [0.5] * 6), (10**6, [0.25] * 6), (10**6, [0.75] * 6)] + [(7, [0.125] * 6)] * 20
    if wide:
        table += [(10**7 + i, [float(x) for x in rng.normal(0, 10.0 ** rng.integers(3, 300), 6)]) for i in range(6)]
    table += [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0] * 5 + [None]), (5, [float("nan")] + [1.0] * 5), (6, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in table], "vec_id long, embedding array<double>, cluster int, block int").repartition(4)
    out = centroids.clusters(df, k=k, rounds=10, dim=6)
    assert sorted(map(tuple, out.collect()), key=str) == clusters_by_force(table, k, 10, 6)
    assert centroids.clusters(df.limit(0), k=k, dim=6).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_rounds_compare_what_changed_only():
    """Whatever moved, delta rounds assign as full ones do."""
    rng = np.random.default_rng(1)
    x = rng.integers(-30, 30, (400, 5))
    now = [[int(y) for y in c] for c in rng.integers(-30, 30, (6, 5))]
    owners, distances = centroids.assign(x, np.full(400, -1), np.full(400, 2**63 - 1), centroids.Round(now, list(range(6))))
    for _ in range(25):
        moved = sorted(rng.choice(6, int(rng.integers(1, 6)), replace=False).tolist())
        for c in moved:
            now[c] = [int(y) for y in np.array(now[c]) + rng.integers(-9, 9, 5)]
        owners, distances = centroids.assign(x, owners, distances, centroids.Round(now, moved))
        every = ((x[:, None] - np.array(now)) ** 2).sum(axis=2)
        assert (owners == every.argmin(axis=1)).all() and (distances == every.min(axis=1)).all()


def test_transfers_add_up_to_sums():
    rng = np.random.default_rng(2)
    for x in (rng.integers(-(2**20), 2**20, (90, 3)), np.array([[int(y) * 10**40 for y in row] for row in rng.integers(-9, 9, (90, 3))], object)):
        before, after = rng.integers(-1, 4, 90), rng.integers(0, 4, 90)
        sums, counts = np.zeros((4, 3), object), [0] * 4
        for t in centroids.transfers(x, before, after):
            counts[t["centroid"]] += t["n"]
            sums[t["centroid"]] += np.array([y << 32 * t["digit"] for y in t["sums"]], object)
        for c in range(4):
            assert counts[c] == (after == c).sum() - (before == c).sum()
            assert sums[c].tolist() == [int(y) for y in x[after == c].sum(axis=0) - x[before == c].sum(axis=0)]
