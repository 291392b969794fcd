"""Negatives: draws stay in a user's list; totals without the product."""

from pyspark.sql import functions as F

from tallyrank.operators import splits


def rows(spark):
    seen = spark.createDataFrame([(u, i) for u in range(6) for i in range(40) if (u + i) % (u + 2) == 0 or u == 5 and i < 39], "user long, item long")
    return seen, spark.range(40).select(F.col("id").alias("item"), F.col("id").alias("code"))


def test_totals_are_those_of_the_product(spark):
    seen, items = rows(spark)
    seen = seen.unionByName(spark.createDataFrame([(9, i) for i in range(40)] + [(3, 77)], "user long, item long"))  # one who has all, one unknown item
    product = splits.negatives(seen, items, None, 1).groupBy("user").agg(F.count("*").alias("n"), F.sum("item").alias("items"))
    totals = splits.unseen_totals(seen, items)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, product.collect()))
    assert "Generate" not in totals._jdf.queryExecution().executedPlan().toString()  # no row for each user and item


def test_draws_are_not_grouped_by_code(spark):
    """Users of few draws, and one with a single item left, who is filled up."""
    seen, items = rows(spark)
    found = splits.negatives(seen, items, 4, 1)
    known = {tuple(r) for r in seen.collect()}
    got = [tuple(r) for r in found.collect()]
    assert not known & {(u, i) for u, i, _ in got}
    places = {u: sorted(p for v, _, p in got if v == u) for u in range(6)}
    assert places == {**{u: [1, 2, 3, 4] for u in range(5)}, 5: [1]}
    few = splits.negatives(seen.where("user < 5"), items, 4, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in few  # lists are in a table; no draw is grouped again
