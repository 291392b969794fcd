"""Cases small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tallyrank.functions import scalars as S
from tallyrank.functions.text import Stemmer, stemmed, tokens
from tallyrank.functions.vectors import cosine, max_sim
from tallyrank.operators import bm25, dense, factors, history, interactions, metrics, neighbours, significance, splits
from tallyrank.sources import readers, sinks


def one(df):
    return df.collect()[0][0]


@pytest.fixture(scope="module")
def listed(spark):
    rows = [("g", "a", 1.0, 0.9), ("g", "b", 0.0, 0.8), ("g", "c", 1.0, 0.7), ("g", "d", 0.0, 0.1)]
    return spark.createDataFrame(rows, "gid string, item string, y_true double, y_pred double")


def value(df):
    return df.collect()[0]["value"]


def test_metrics_by_hand(spark, listed):
    assert value(metrics.precision(listed, 2)) == 0.5
    assert value(metrics.recall(listed, 2)) == 0.5
    assert value(metrics.average_precision(listed, 4)) == pytest.approx(5 / 6)
    assert value(metrics.average_precision(listed, 2)) == 1.0
    assert value(metrics.precision(listed, 10)) == 0.5
    third = spark.createDataFrame([("g", "a", 0.0, 3.0), ("g", "b", 0.0, 2.0), ("g", "c", 1.0, 1.0)], listed.schema)
    assert value(metrics.reciprocal_rank(third)) == pytest.approx(1 / 3)
    graded = spark.createDataFrame([("g", "a", 3.0, 3.0), ("g", "b", 0.0, 2.0), ("g", "c", 2.0, 1.0)], listed.schema)
    assert value(metrics.ndcg(graded, 2)) == pytest.approx(0.703918, abs=1e-6)
    ideal = spark.createDataFrame([("g", "a", 3.0, 3.0), ("g", "b", 2.0, 2.0), ("g", "c", 0.0, 1.0)], listed.schema)
    assert value(metrics.ndcg(ideal, 3)) == value(metrics.ndcg(ideal, 3, exponential=True)) == 1.0
    none = listed.withColumn("y_true", F.lit(0.0))
    for f in (metrics.precision, metrics.recall, metrics.average_precision, metrics.ndcg):
        assert value(f(none, 3)) == 0.0
    assert value(metrics.reciprocal_rank(none)) == 0.0


def test_nan_scores_rank_last(spark, listed):
    rows = listed.withColumn("y_pred", F.when(F.col("item") == "a", float("nan")).otherwise(F.col("y_pred")))
    assert value(metrics.precision(rows, 1)) == 0.0


def test_evaluate_skips_groups_without_hits(spark, listed):
    both = listed.unionByName(listed.withColumn("gid", F.lit("h")).withColumn("y_true", F.lit(0.0)))
    assert metrics.evaluate(both, [2], ["precision", "unknown"]).collect()[0]["Value"] == 0.25
    assert metrics.evaluate(both, [2], ["precision"], skip_empty=True).collect()[0]["Value"] == 0.5
    assert {r["K"]: r["PRECISION"] for r in metrics.pooled(listed, [1, 4]).collect()} == {1: 1.0, 4: 0.5}


def interactions_of(spark, rows):
    return spark.createDataFrame(rows, "user long, item long, label double, time long")


def test_temporal_split(spark):
    df = interactions_of(spark, [(1, i, 1.0, i) for i in range(10)] + [(2, 0, 1.0, 0)])
    parts = {(r["user"], r["part"]): r["n"] for r in splits.temporal(df, 0, 3).groupBy("user", "part").agg(F.count("*").alias("n")).collect()}
    assert parts == {(1, "train"): 7, (1, "test"): 3, (2, "test"): 1}
    with pytest.raises(ValueError):
        splits.fold_ratio(0, 3, 0.2, 0.3)
    with pytest.raises(ValueError):
        splits.fold_ratio(3, 3)
    with pytest.raises(ValueError):
        splits.SplitConfig(0.6, 0.5)


def test_results_do_not_depend_on_partitioning(spark):
    df = interactions_of(spark, [(u, (u * 7 + j) % 30, float(j % 5 + 1), j) for u in range(8) for j in range(12)])
    items = interactions.encoded(df.select("item").distinct(), "item", "code")
    a, b = (sorted(map(tuple, splits.negatives(x, items, 5, 1).collect())) for x in (df, df.repartition(7)))
    assert a == b
    seen = {(r["user"], r["item"]) for r in df.collect()}
    assert not seen & {(u, i) for u, i, _ in a}
    assert [r["code"] for r in items.orderBy("item").collect()] == list(range(30))


def test_negatives_are_filled_up(spark):
    seen = {1: 90, 2: 99, 3: 100, 4: 3, 5: 75}  # the first so many items
    df = interactions_of(spark, [(u, i, 1.0, 0) for u, own in seen.items() for i in range(own)])
    items = spark.createDataFrame([(i, i) for i in range(100)], "code long, item long")
    for n, want in ((20, {1: 10, 2: 1, 3: 0, 4: 20, 5: 20}), (None, {1: 10, 2: 1, 3: 0, 4: 97, 5: 25})):
        rows = splits.negatives(df, items, n, 1).collect()
        for u, own in seen.items():
            assert sorted(r["place"] for r in rows if r["user"] == u) == list(range(1, want[u] + 1))
            assert len({r["item"] for r in rows if r["user"] == u and r["item"] >= own}) == want[u]


def test_k_core_and_counts(spark):
    df = interactions_of(spark, [(u, i, 1.0, 0) for u in range(3) for i in range(3)] + [(9, 0, 1.0, 0)])
    assert interactions.k_core(df, 3).count() == 9
    assert interactions.min_count(df, "user", 2).count() == 9
    assert {r["item"] for r in interactions.popular(df, 1).collect()} == {0}
    with pytest.raises(ValueError):
        interactions.canonical(df.drop("label"))
    with pytest.raises(ValueError):
        interactions.require_rows(df.where("false"), "nothing")


def test_feedback_modes(spark):
    mode = lambda labels: interactions.feedback_mode(interactions_of(spark, [(1, 1, float(x), 0) for x in labels])).collect()[0]["mode"]
    assert mode(range(1, 6)) == "explicit"
    assert mode([1, 1]) == mode([0]) == "implicit_binary"
    assert mode(range(1, 51)) == "implicit_count"


def test_neighbours_by_hand(spark):
    df = interactions_of(spark, [(u, i, 1.0, 0) for u in (1, 2) for i in (10, 20)])
    sims = neighbours.similarities(neighbours.merged(df), "cosine", 20)
    assert {round(r["sim"], 6) for r in sims.collect()} == {0.090909}
    assert {r["sim"] for r in neighbours.similarities(neighbours.merged(df), "jaccard").collect()} == {1.0}
    assert neighbours.default_k(100) == 10 and neighbours.default_k(2) == 1
    pop = interactions.popularity(df)
    new = spark.createDataFrame([(7,)], "user long")
    out = neighbours.recommend(neighbours.scores(df, sims), df, 5, new, pop).collect()
    assert [(r["user"], r["item"], r["rank"]) for r in sorted(out, key=lambda r: r["rank"])] == [(7, 10, 1), (7, 20, 2)]
    pairs = spark.createDataFrame([(1, 10), (1, 99), (5, 10)], "user long, item long")
    got = {(r["user"], r["item"]): r["score"] for r in neighbours.rules(pairs, neighbours.scores(df, sims), df, pop).collect()}
    assert got == {(1, 10): float("-inf"), (1, 99): 0.0, (5, 10): 1.0}
    centred = neighbours.scores(df, sims, "centred", means=df.groupBy("item").agg(F.avg("label").alias("mean")))
    assert {r["score"] for r in centred.collect()} == {1.0}


def test_vectors(spark):
    df = spark.createDataFrame([([[1.0, 0.0]], [[-1.0, 0.0]], [1.0, 2.0], [0.0, 0.0])], "q array<array<double>>, d array<array<double>>, a array<double>, z array<double>")
    row = df.select(max_sim("q", "d").alias("m"), cosine("a", "a").alias("c"), cosine("a", "z").alias("z")).collect()[0]
    assert (row["m"], round(row["c"], 12), row["z"]) == (0.0, 1.0, 0.0)
    known = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(1, 1), (1, 2)], "qid long, doc_id long")
    out = dense.rerank(asked, known.withColumnRenamed("doc_id", "qid"), known).collect()
    assert {r["doc_id"]: r["score"] for r in out} == {1: 1.0, 2: -10.0}
    histories = spark.createDataFrame([(1, 5)], "user long, item long")
    assert dense.centroid(histories, known.withColumnRenamed("doc_id", "item"), "user", 2).collect()[0]["vector"] == [0.0, 0.0]


def test_residuals_come_back(spark):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(60)], "id long, vector array<double>")
    book = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]]
    coded, edges, means = dense.residual_buckets(dense.assign_centroids(rows, book))
    assert all(e == sorted(e) and len(e) == 3 for e in edges)
    back = dense.reconstructed(coded, book, means).collect()
    near = sum(sum((a - b) ** 2 for a, b in zip(r["vector"], r["rebuilt"], strict=True)) for r in back)
    far = sum(sum(x * x for x in r["residual"]) for r in back)
    assert near < far / 4


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue sky"), (3, "a blue sky")], "doc_id long, text string")
    index = bm25.build(bm25.corpus(docs))
    asked = spark.createDataFrame([(1, "red"), (2, "nothing here")], "qid long, text string")
    scored = bm25.scores(index, asked)
    assert [r["doc_id"] for r in bm25.top_k(scored, 5).orderBy("rank").collect()] == [2, 1]
    rows = spark.createDataFrame([(1, 3), (1, 1)], "qid long, doc_id long")
    assert {r["doc_id"]: r["score"] > 0 for r in bm25.candidates(scored, rows).collect()} == {3: False, 1: True}
    single = bm25.retrieval_as_user(scored.where("doc_id = 2").withColumnRenamed("qid", "query")).collect()[0]
    assert (single["user"], single["time"], single["score"], single["label"]) == ("retrieval::1", 0, 0.0, 1.0)
    tags = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "item long, tag string, weight double")
    got = {r["user"]: r["search_query"] for r in bm25.tag_query(spark.createDataFrame([(1, 1), (2, 9)], "user long, item long"), tags).collect()}
    assert got == {1: "y x", 2: ""}


def test_stemmer(spark):
    # from the published examples of the algorithm
    stem = Stemmer()
    words = "caresses ponies cats feed agreed plastered motoring sing conflated hopping falling hissing fizzed happy sky relational conditional vietnamization triplicate electrical hopefulness goodness revival adjustment adoption probate rate cease controll roll"
    stems = "caress poni cat feed agre plaster motor sing conflat hop fall hiss fizz happi sky relat condit vietnam triplic electr hope good reviv adjust adopt probat rate ceas control roll"
    assert [stem(w) for w in words.split()] == stems.split()
    df = spark.createDataFrame([("The running foxes",), (None,)], "text string").select(stemmed(tokens("text", ["the"])).alias("s"))
    assert [r["s"] for r in df.collect()] == [["run", "fox"], []]


def test_p_values():
    assert significance.wilcoxon_p(0, 6, 0) == 0.03125
    assert significance.student_p(2.0, 10) == pytest.approx(0.07338803477, abs=1e-9)
    assert significance.student_p(0.0, 5) == pytest.approx(1.0)
    assert significance.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_significance(spark):
    rows = [(r, m, 5, "NDCG", v + r / 100) for r in range(8) for m, v in (("a", 0.5), ("b", 0.4 - r / 50))] + [(99, "a", 5, "NDCG", 1.0)]
    df = spark.createDataFrame(rows, "RunId long, Model string, K int, Metric string, Value double")
    assert significance.paired(df).count() == 8  # the run without b is left out
    for f in (significance.wilcoxon, significance.t_test):
        row = f(df).collect()[0]
        assert row["Winner"] == "a" and row["Significant"] and row["N_runs"] == 8
    assert significance.TESTS["ttest_rel"] is significance.TESTS["t-test"]
    shown = {r["Model"]: r["shown"] for r in significance.marked(df, significance.t_test(df)).collect()}
    assert shown["a"].endswith(significance.MARK) and not shown["b"].endswith(significance.MARK)


def test_scalars(spark):
    df = spark.createDataFrame([("  A \t b ", '["x","y"]', "not json", "2020-01-02 00:00:01")], "a string, j string, n string, t string")
    row = df.select(S.clean_name("a").alias("a"), S.json_list("j").alias("j"), S.json_list("n").alias("n"), S.lenient_epoch("t").alias("t"), S.lenient_epoch("n").alias("z")).collect()[0]
    assert tuple(row) == ("a b", ["x", "y"], [], 1577923201, 0)
    assert one(spark.range(1).select(S.sorted_tags(F.array(*map(F.lit, ["b", "A", "a", "b"]))))) == ["A", "a", "b"]
    assert one(spark.range(1).select(S.split_list(F.lit(" 1, 2,,3 ")))) == ["1", "2", "3"]


def test_ridge_is_exact(spark):
    import numpy as np

    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)], "user long, item long, label double")
    v = {1: [1.0, 0.5], 2: [0.2, 1.0]}
    others = spark.createDataFrame(list(v.items()), "item long, factors array<double>")
    got = {r["user"]: r["factors"] for r in factors.ridge_step(df, others, "user", "item", 0.1).collect()}
    for user, rated in ((1, [(1, 1.0), (2, 2.0)]), (2, [(1, 3.0)])):
        m = np.array([v[i] for i, _ in rated])
        want = np.linalg.solve(m.T @ m + 0.1 * len(rated) * np.eye(2), m.T @ np.array([r for _, r in rated]))
        assert got[user] == pytest.approx(want.tolist())


def test_history(spark):
    df = interactions_of(spark, [(1, i, 1.0, i) for i in range(6)])
    pairs = {r["place"]: (r["search_query"], r["document_id"]) for r in history.next_item_pairs(df, 3, 2, None).collect()}
    assert pairs[2] == ("0,1", 2) and pairs[5] == ("2,3,4", 5) and len(pairs) == 4
    half = history.half_query_truth(df, 5).collect()[0]
    assert (half["query_ids"], half["ground_truth_ids"]) == ([1, 2], [3, 4, 5])
    assert history.dropout(df, 0.5, 1).count() == 3


def test_readers_and_reports(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a1,u1,4.0,10\nbad\n")
    rows = readers.headerless(spark, str(tmp_path / "r.csv")).collect()
    assert tuple(rows[0]) == ("a1", "u1", 4.0, 10) and rows[1]["user"] is None
    assert readers.raw_lines(spark, str(tmp_path / "r.csv"), ["item", "user", "rating", "timestamp"], 4).count() == 1
    (tmp_path / "m.jsonl").write_text('{"asin": "x", "title": " T ", "description": ["d", " e "], "category": ["B", "a", "B"]}\n')
    assert tuple(readers.products(spark, str(tmp_path / "m.jsonl")).collect()[0]) == ("x", "T", "d e", ["a", "B"])
    (tmp_path / "q.csv").write_text("q,t,b\nfox,red,brown\nfox,red,brown\n,x,y\n")
    pairs = readers.generic_pairs(spark, str(tmp_path / "q.csv"), "q", ["t", "b"]).collect()
    assert [(r["search_query"], r["document"]) for r in pairs] == [("fox", "red\nbrown")]
    generic = readers.generic_interactions(spark, str(tmp_path / "q.csv"), "csv", {"user": "q", "item": "t"}).collect()
    assert (generic[0]["user"], generic[0]["label"], generic[0]["time"]) == ("fox", 1.0, 0)
    (tmp_path / "p.tsv").write_text("u\t\tThe  Band\t3\nu\tid1\tX\t2\nv\t\tY\tbad\n")
    assert {r["item"] for r in readers.plays(spark, str(tmp_path / "p.tsv")).collect()} == {"the band", "id1"}
    with pytest.raises(KeyError):
        readers.get_loader("nothing")
    with pytest.raises(FileNotFoundError):
        readers.dataset_path("MovieLens", [str(tmp_path)])
    report = spark.createDataFrame([(5, 0.5, None)], "K int, NDCG double, MAP double")
    sinks.write_report(report, str(tmp_path / "out" / "r.csv"))
    assert (tmp_path / "out" / "r.csv").read_text().splitlines()[1] == "5,0.500000000000,"
    text = sinks.latex(report, "A & B", {(0, "NDCG"): True})
    assert r"\textbf{0.5000}" in text and r"A \& B" in text and "tab:a-b" in text


def test_metric_files(spark, tmp_path):
    for run in (1, 2):
        (tmp_path / f"run_{run}.csv").write_text("Model,K,Metric,Value\nm,5,NDCG,0.5\n")
    assert {r["RunId"] for r in readers.metric_files(spark, f"{tmp_path}/*.csv").collect()} == {"1", "2"}


def test_stream_equals_batch(spark, tmp_path):
    from oracle import SMALL

    from tallyrank.streaming import ingest

    source = tmp_path / "in"
    source.mkdir()
    (source / "events.parquet").write_bytes(open(f"{SMALL}/events.parquet", "rb").read())
    stream = ingest.windowed(ingest.read_events(spark, str(source)), late="3650 days")
    run = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    key = lambda r: (r["user"], r["item"], r["start"], r["n"])
    assert sorted(map(key, spark.sql("SELECT * FROM w").collect())) == sorted(map(key, ingest.windowed(spark.read.parquet(f"{SMALL}/events.parquet")).collect()))
