"""The registered corpus queries against their SQL or brute force, and the pipeline stage by stage."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import regex
from oracle import SMALL, connect, same
from pyspark.sql import functions as F
from test_operators import by_id, classes_by_force, hits_by_force, removed_by_force, rows_of, table

import corpus_pipeline
from tallyrank.llm import language, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    same(queries.queries()[name](spark, SMALL), connect(SMALL), queries.oracle_sql()[name])


def test_whole_tables_by_force(spark):
    rows = sorted(rows_of(table(spark, "documents")))
    assert {k: v[1:] for k, v in by_id(queries.op3_near_duplicates(spark, SMALL)).items()} == classes_by_force(rows)
    assert sorted((tuple(r) for r in queries.op7_repeated_passages(spark, SMALL).collect()), key=str) == removed_by_force(rows)


def test_repeated_passages_of_a_larger_table(spark):
    """The query, and the texts that the pipeline's stage leaves, at a size with long passages under repeated lines."""
    folder = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = removed_by_force(rows_of(docs))
    assert sorted((tuple(r) for r in queries.op7_repeated_passages(spark, folder).collect()), key=str) == expected
    left = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["repeated_passages"](spark, docs, folder).collect()}
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {d for d, n, gone, _ in expected if not gone or gone < n}
    for d, _, gone, digest in expected:
        if d in left:
            assert (hashlib.sha256(left[d].encode()).hexdigest() == digest) if gone else (left[d] == whole[d])


def test_language_held_out(spark):
    folder = SMALL.replace("0.001", "0.01")
    out = queries.op4_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97


def test_languages_by_a_plain_model(spark):
    """Counts of contexts in dictionaries, escape method C, eight bits for what was never seen; whole texts."""
    rows = table(spark, "documents").select("doc_id", "text", "lang").collect()
    folded = {r["doc_id"]: b"    " + bytes(language.fold(np.frombuffer(r["text"].encode(), np.uint8))) for r in rows if r["text"]}
    counts = {}
    for r in rows:
        if r["lang"] is not None and r["doc_id"] in folded and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            own, data = counts.setdefault(r["lang"], {}), folded[r["doc_id"]]
            for i in range(4, len(data)):
                for k in range(5):
                    after = own.setdefault(data[i - k : i], {})
                    after[data[i]] = after.get(data[i], 0) + 1
    sums = {name: {c: (sum(after.values()), len(after), after) for c, after in own.items()} for name, own in counts.items()}

    def bits(data, own):
        total = 0.0
        for i in range(4, len(data)):
            for k in range(4, -1, -1):
                n, kinds, after = own.get(data[i - k : i], (0, 0, None))
                if after is None:
                    continue
                if data[i] in after:
                    total -= math.log2(after[data[i]] / (n + kinds))
                    break
                total -= math.log2(kinds / (n + kinds))
            else:
                total += 8
        return total

    out = {r["doc_id"]: r["lang_pred"] for r in queries.op4_language(spark, SMALL).collect()}
    for r in rows:
        if not r["text"] or not regex.search(r"\p{L}", r["text"]):
            assert out[r["doc_id"]] == "und"
        else:
            assert out[r["doc_id"]] == min(sorted(sums), key=lambda name: bits(folded[r["doc_id"]], sums[name]))  # noqa: B023


def test_pipeline(spark):
    docs = table(spark, "documents")
    benchmark = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(rows_of(docs))
        out = stage(spark, docs, SMALL).cache()
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for c, _ in classes_by_force(before).values()})
        if name == "repeated_passages":
            assert out.count() == sum(1 for _, n, gone, _ in removed_by_force(before) if not (gone and gone == n))
        if name == "decontaminate":
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, h in hits_by_force(before, benchmark).items() if not h[-1])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    """Nulls in any column, empty texts, repeated rows and ids, clashing columns, no benchmark or no documents at all."""
    docs, labels, bench = (table(spark, x) for x in ("documents", "labels", "benchmark"))
    rows = [(None, "no id at all", None, None, None), (10**9, None, None, "s", 1), (10**9, "", "en", None, None), (10**9 + 1, " \\n", "en", "s", 2)] + [(10**9 + 2, "the same row again", "en", "s", None)] * 5
    odd = spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    whole = docs.limit(60).unionByName(odd, allowMissingColumns=True)
    for name in ("id", "hash", "score", "__id", "__hash", "spans", "label", "content"):
        whole = whole.withColumn(name, F.lit(1))
    if kind == "empty":
        whole, labels, bench = whole.limit(0), labels.limit(0), bench.limit(0)
    folder = f"file://{tmp_path}"
    for name, df in (("documents", whole), ("labels", labels), ("benchmark", bench.withColumn("n", F.lit(2)).withColumn("print", F.lit("x")))):
        df.write.parquet(f"{folder}/{name}.parquet")
    read = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, folder)
        assert out.columns == read.columns, name
        read = spark.createDataFrame(out.collect(), read.schema)
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == read.count() and (kind == "odd") == bool(out)
    if kind == "odd":
        assert sum(r["doc_id"] == 10**9 + 2 for r in out) <= 1  # copies of one row are one document
