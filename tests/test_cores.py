"""Cores and splits against loops, and what their plans read and sort."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyrank.operators import graph, interactions, pairwise
from tallyrank.plans import builders


def rows(spark):
    x = [(u, i, float(u % 5), u * 7 + i) for u in range(40) for i in range(60) if (u * 31 + i * 17 + u * i) % 11 < 3] + [(None, 3, 1.0, 1), (None, 4, 1.0, 2), (5, None, 1.0, 3)]
    return x, spark.createDataFrame(x, "user long, item long, label double, time long")


@pytest.mark.parametrize("k,rounds", [(9, 5), (11, 2), (1, 3), (40, 5)])
def test_cores_are_those_of_a_loop(spark, k, rounds):
    x, df = rows(spark)
    for _ in range(rounds):
        for at in (1, 0):
            n = Counter(r[at] for r in x)
            x = [r for r in x if r[at] is not None and n[r[at]] >= k]
    found = interactions.k_core(df, k, rounds)
    assert found.columns == df.columns and sorted(map(tuple, found.collect())) == sorted(x)


def test_columns_where_only_items_go(spark):
    df = spark.createDataFrame([(u, i, 1.0, 2) for u in range(5) for i in range(4)] + [(0, 9, 1.0, 2)], "user long, item long, label double, time long")
    found = interactions.k_core(df, 3, 4)
    assert found.columns == df.columns and found.count() == 20 and found.where("item = 9").count() == 0


def test_three_parts_read_once_and_sort_once(spark):
    _, df = rows(spark)
    found = builders.three_parts(df, least=8, truth=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("LogicalRDD") == 1
    physical = found._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("user#") and "__n" not in physical
    users = {}
    for r in df.where("user is not null").collect():
        users.setdefault(r["user"], []).append((r["time"], r["item"], r["label"]))
    expected = set()
    for u, own in users.items():
        n = len(own)
        if n >= 8:
            for place, (time, item, _) in enumerate(sorted(own, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))):
                part = "train" if place < int(n * 0.6) else "query" if place < int(n * 0.8) else "truth"
                if part != "truth" or place < int(n * 0.8) + 2:
                    expected.add((u, item, time, part, place, n))
    assert {tuple(r) for r in found.select("user", "item", "time", "part", "place", F.col("size")).collect()} == expected


def counted(spark, df):
    """The rows, and a count of how often each is made: that of each reading of the source."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), made


def test_codes_and_layers_read_their_source_once(spark):
    _, df = rows(spark)
    n = df.count()
    source, made = counted(spark, df)
    assert pairwise.coded(source).m == 60 and made.value == n
    edges = graph.edges(df.where("user is not null and item is not null"))
    nodes, made = counted(spark, edges.select(F.col("src").alias("node")).distinct().withColumn("vector", F.array(F.lit(1.0), F.lit(2.0))))
    assert graph.propagate(edges, nodes, 3).count() == 100 == made.value
