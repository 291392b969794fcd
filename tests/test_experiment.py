"""The experiment runner, end to end on small tables."""

import os

import pytest
from oracle import SMALL

from tallyrank.plans import experiment, tables
from tallyrank.sources.readers import loader


@loader("parts")
def parts(spark, folder):
    return tables.interactions(spark, folder)


CONFIG = {
    "experiment_name": "small",
    "task_type": "recs",
    "dataset": {"name": "parts", "params": {"folder": SMALL}},
    "model": [{"name": "popularity"}, {"name": "itemknn", "params": {"k": 5}}],
    "execution": {"n_runs": 1},
    "evaluation": {"top_ks": [5], "metrics": ["NDCG", "RECALL"], "negatives": 10, "tests": ["ttest_rel"]},
}


def test_recs(spark, tmp_path):
    said = []
    out = experiment.run(spark, CONFIG, str(tmp_path), said.append)
    rows = out.collect()
    assert len(rows) == 2 * 2 * 2  # a t test makes two runs of it
    assert all(0 <= r["Value"] <= 1 for r in rows)
    assert {"summary.csv", "runs.csv", "ttest-rel_diagnostics.csv"} <= set(os.listdir(tmp_path / "small"))
    # with eval skipped, what was kept comes back
    again = experiment.run(spark, CONFIG | {"execution": {"n_runs": 1, "skip": ["eval"]}}, str(tmp_path), lambda s: None)
    key = lambda r: tuple(r)
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))


def test_all_unseen_items_on_request(spark, tmp_path, monkeypatch):
    drawn = []
    plain = experiment.splits.negatives
    monkeypatch.setattr(experiment.splits, "negatives", lambda seen, items, n, seed: drawn.append((seen, items, plain(seen, items, n, seed))) or drawn[-1][-1])
    config = CONFIG | {"model": [{"name": "popularity"}], "evaluation": {"top_ks": [5], "metrics": ["RECALL"], "negatives": "all"}}
    assert experiment.run(spark, config, str(tmp_path), lambda s: None).count() > 0
    seen, items, found = drawn[0]
    pairs = seen.select("user", "item").distinct().count()
    assert found.count() == seen.select("user").distinct().count() * items.count() - pairs > 0


def test_search(spark, tmp_path):
    rows = [(f"tag{i % 3}", f"doc about tag{i % 3} number {i}", f"tag{i % 3}", f"d{i}") for i in range(40)]
    pairs = spark.createDataFrame(rows, "search_query string, document string, category string, document_id string")
    loader("pairs")(lambda s: pairs)
    config = {"experiment_name": "s", "task_type": "search", "dataset": {"name": "pairs"}, "model": [{"name": "bm25"}], "evaluation": {"top_ks": [10], "metrics": ["MRR"]}}
    assert 0 < experiment.run(spark, config, str(tmp_path), lambda s: None).collect()[0]["Value"] <= 1


def test_settings():
    assert [experiment.unlimited(x) for x in (None, "all", "inf", 0, -1, "20", 3.0)] == [None, None, None, None, None, 20, 3]
    assert experiment.merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    assert experiment.fingerprint({"a": 1, "seed": 1}) == experiment.fingerprint({"a": 1, "seed": 2, "execution": {}})
    for bad in ({"task_type": "x", "model": [{}]}, {"task_type": "recs", "model": []}, {"task_type": "recs", "model": [{"name": "nothing"}]}):
        with pytest.raises(ValueError):
            experiment.validate(bad)
