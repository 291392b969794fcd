"""Registered queries on sources, sinks and builders: tables are written as files of each layout and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import factors, interactions, neighbours, significance
from ..operators.lineage import cut, shared_folder
from ..sources import readers
from . import builders
from .model_queries import _own_and_near, runs
from .queries import HALF, W, _core_sql, query
from .tables import PART_DOCS, PART_TAGS, draw, draw_int, part_docs, part_tags, q, table
from .tables import interactions as rows_of


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}/{name}"


def lines(df: DataFrame, name: str, sep: str = ",", header: bool = True, quote: str = '"') -> str:
    path = scratch(df.sparkSession, name)
    df.write.options(sep=sep, header=header, quote=quote, emptyValue="").csv(path)
    return path


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


# --- sources --------------------------------------------------------------------------------------------------------
@query("SELECT p_partkey AS movieId, p_name AS title, p_type || '|' || p_brand AS genres FROM part")
def source_csv(spark, d):
    path = lines(parts(spark, d).select(F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"), F.concat_ws("|", "p_type", "p_brand").alias("genres")), "movies.csv")
    return readers.csv(spark, path, readers.MOVIES)


@query("SELECT 'i' || l_partkey AS item, 'u' || l_suppkey AS \"user\", l_quantity AS rating, l_orderkey AS timestamp FROM lineitem")
def source_headerless(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("i"), "l_partkey"), F.concat(F.lit("u"), "l_suppkey"), "l_quantity", "l_orderkey")
    return readers.headerless(spark, lines(rows, "ratings.csv", header=False))


@query("SELECT event_id::VARCHAR AS a, event_type AS b FROM events WHERE event_id % 3 <> 0")
def source_raw_lines(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.concat_ws(" , ", F.col("event_id").cast("string"), "event_type")).alias("value"))
    path = scratch(spark, "raw.txt")
    rows.write.text(path)
    return readers.raw_lines(spark, path, ["a", "b"], 2)


@query("""SELECT 'u' || l_suppkey AS "user", CASE WHEN l_partkey % 2 = 0 THEN 'mb' || l_partkey ELSE 'artist no ' || l_partkey END AS item, '  Artist  No ' || l_partkey || ' ' AS artist_name, l_linenumber::BIGINT AS plays FROM lineitem WHERE l_suppkey % 7 <> 0""")
def source_plays(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.select(
        F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("u"), "l_suppkey")), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("mb"), "l_partkey")),
        F.concat(F.lit("  Artist  No "), "l_partkey", F.lit(" ")), "l_linenumber",
    ).toDF("u", "m", "n", "p")
    path = scratch(spark, "plays.tsv")
    rows.write.options(sep="\t", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.plays(spark, path)


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def source_tsv(spark, d):
    return readers.read_any(spark, lines(parts(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "artists.tsv", "\t")).select(F.col("id").cast("bigint").alias("id"), "name")


@query("SELECT event_id, event_type, value FROM events")
def source_json_lines(spark, d):
    path = scratch(spark, "events.jsonl")
    rows = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    rows.unionByName(spark.createDataFrame([("{broken",), ('{"event_id": "x"',)], "value string")).write.option("compression", "gzip").text(path)
    return readers.json_lines(spark, path, "event_id bigint, event_type string, value double")


@query("SELECT 2::BIGINT AS n")
def source_malformed_lines(spark, d):
    path = scratch(spark, "events.jsonl")
    rows = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    rows.unionByName(spark.createDataFrame([("{broken",), ('{"event_id": "x"',)], "value string")).write.text(path)
    return readers.malformed(spark, path, "event_id bigint, event_type string").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, event_type AS \"what.type\", value AS \"what.value\" FROM events")
def source_flattened_json(spark, d):
    path = scratch(spark, "events.json")
    table(spark, d, "events").select(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("type"), "value").alias("what")).write.json(path)
    return readers.flattened(readers.json_lines(spark, path))


@query("""SELECT user_id::VARCHAR AS "user", event_type AS item, coalesce(value, 1.0) AS label, 0::BIGINT AS time FROM events""")
def source_generic_interactions(spark, d):
    path = scratch(spark, "rows.parquet")
    table(spark, d, "events").select("user_id", "event_type", "value").write.parquet(path)
    return readers.generic_interactions(spark, path, "parquet", {"user": "user_id", "item": "event_type", "label": "value"})


@query("""SELECT DISTINCT p_brand AS search_query, p_name || chr(10) || p_type AS document, p_type AS category, p_partkey::VARCHAR AS document_id FROM part""")
def source_generic_pairs(spark, d):
    path = lines(parts(spark, d).select("p_brand", "p_name", "p_type", "p_partkey"), "pairs.csv", "|")
    return readers.generic_pairs(spark, path, "p_brand", ["p_name", "p_type"], "p_type", "p_partkey", sep="|")


@query("""SELECT 'B' || p_partkey AS item, p_name AS title, p_type || ' ' || p_brand AS description, list_sort([p_brand, 'x' || p_size]) AS category FROM part""")
def source_products(spark, d):
    path = scratch(spark, "meta.json")
    size = F.concat(F.lit("x"), F.col("p_size").cast("string"))
    rows = parts(spark, d).select(F.concat(F.lit("B"), "p_partkey").alias("asin"), F.concat(F.lit(" "), "p_name").alias("title"), F.array("p_type", "p_brand").alias("description"), F.array(F.array(size, F.col("p_brand")), F.array(F.col("p_brand"))).alias("categories"))
    rows.write.option("compression", "gzip").json(path)
    return readers.products(spark, path)


# --- builders -------------------------------------------------------------------------------------------------------
LINES = """WITH l AS (SELECT l_suppkey, l_partkey, l_quantity, l_orderkey FROM lineitem)"""


@query(f"""{W}, n AS (SELECT "user", count(*) AS n FROM i GROUP BY 1), s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS c FROM n),
b AS (SELECT min(n) FILTER (WHERE r = floor((c - 1) * 0.1 + 0.5)) AS lo, min(n) FILTER (WHERE r = floor((c - 1) * 0.9 + 0.5)) AS hi FROM s)
SELECT i.*, p_name AS title, p_type AS genres FROM i JOIN n USING ("user") LEFT JOIN part ON p_partkey = item, b WHERE n > lo AND n < hi""")
def build_movie_ratings(spark, d):
    ratings = rows_of(spark, d).select(F.col("user").alias("userId"), F.col("item").alias("movieId"), F.col("label").alias("rating"), F.col("time").alias("timestamp"))
    return builders.movie_ratings(ratings, parts(spark, d).select(F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"), F.col("p_type").alias("genres"))).select("user", "item", "label", "time", "title", "genres")


@query(_core_sql(5, 9, f"{W}, half AS (SELECT * FROM i WHERE {draw_int(42, '\"user\"', 'item', 'time')} < 2147483648)", "half"))
def build_product_ratings(spark, d):
    """Half of the ratings, and of these the users and items with nine or more."""
    return builders.product_ratings(rows_of(spark, d), 0.5, 9)


@query(f"""{W}, p AS (SELECT "user", item, sum(label) AS label FROM i GROUP BY 1, 2), n AS (SELECT "user", count(*) AS n FROM p GROUP BY 1), s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS c FROM n),
b AS (SELECT min(n) FILTER (WHERE r = floor((c - 1) * 0.1 + 0.5)) AS lo, min(n) FILTER (WHERE r = floor((c - 1) * 0.9 + 0.5)) AS hi FROM s)
SELECT "user", item, label, row_number() OVER (PARTITION BY "user" ORDER BY label DESC, item) AS time FROM p JOIN n USING ("user"), b WHERE n > lo AND n < hi""")
def build_artist_plays(spark, d):
    plays = rows_of(spark, d).groupBy("user", "item").agg(F.sum("label").alias("plays"))
    return builders.artist_plays(plays, ascending=False).select("user", "item", "label", "time")


def _relative_sql() -> str:
    from .model_queries import _as_user, index_sql, scores_sql

    return f"""WITH {PART_DOCS}, {PART_TAGS}, r AS (SELECT item, tag, CASE WHEN max(weight) OVER (PARTITION BY item) > 0 THEN weight / max(weight) OVER (PARTITION BY item) ELSE 0 END AS weight FROM pt),
k AS (SELECT * FROM r WHERE weight >= 0.8), kt AS (SELECT * FROM k WHERE tag IN (SELECT tag FROM k GROUP BY 1 HAVING count(*) >= 2)), best AS (SELECT item, string_agg(tag, ' ' ORDER BY weight DESC, tag) AS t FROM kt GROUP BY 1),
ds AS (SELECT item AS doc_id, concat_ws(' ', text, t) AS text FROM pd LEFT JOIN best USING (item)), qs AS (SELECT DISTINCT tag AS query FROM kt), {index_sql('ds')}, {scores_sql('qs', 'query', 'query')}, {_as_user(20)}"""


@query(_relative_sql())
def build_relative_tag_users(spark, d):
    """Tags with a weight near the greatest of their item, as users of the documents that they retrieve."""
    found = builders.retrieval_by_relative_tag(part_docs(spark, d), part_tags(spark, d), k=20, min_items=2)
    return found.withColumn("score", S.quantised("score"))


SCORES = "sc AS (SELECT l_partkey AS movieId, l_suppkey AS tagId, max(l_discount) * 10 AS relevance FROM lineitem GROUP BY 1, 2)"


def _scores(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("movieId"), F.col("l_suppkey").alias("tagId")).agg((F.max("l_discount") * 10).alias("relevance"))


@query(f'WITH {SCORES} SELECT tagId AS "user", movieId AS item, relevance AS label, relevance AS time FROM sc WHERE relevance > 0.8')
def build_tag_users(spark, d):
    return builders.tag_users(_scores(spark, d))


@query(f"""WITH {SCORES} SELECT s_name AS search_query, p_name || ' ' || replace(p_type, '|', ' ') AS document, s_name AS category, movieId::VARCHAR AS document_id FROM sc JOIN supplier ON s_suppkey = tagId JOIN part ON p_partkey = movieId WHERE relevance > 0.8""")
def build_tag_pairs(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tagId"), F.col("s_name").alias("tag"))
    movies = parts(spark, d).select(F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"), F.col("p_type").alias("genres"))
    return builders.tag_pairs(_scores(spark, d), names, movies)


PRODUCTS = "pr AS (SELECT p_partkey AS item, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS description, unnest([p_brand, p_type, 'z' || p_size]) AS category FROM part)"


def _products(spark, d):
    size = F.concat(F.lit("z"), F.col("p_size").cast("string"))
    return parts(spark, d).select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("description"), F.array("p_brand", "p_type", size).alias("category"))


@query(f"""WITH {PRODUCTS}, c AS (SELECT DISTINCT category AS "user", item FROM pr WHERE length(category) >= 2), best AS (SELECT item FROM c GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 150)
SELECT "user", item, 0.8::DOUBLE AS label, 0::BIGINT AS time FROM c WHERE item IN (SELECT item FROM best)""")
def build_category_users(spark, d):
    return builders.category_users(_products(spark, d), 150)


@query(f"""WITH {PRODUCTS}, c AS (SELECT DISTINCT category AS search_query, CASE WHEN description <> '' THEN title || '. ' || description ELSE title END AS document, category, item::VARCHAR AS document_id FROM pr WHERE length(category) >= 2)
SELECT * FROM c WHERE search_query IN (SELECT search_query FROM c GROUP BY 1 HAVING count(*) >= 10)""")
def build_category_pairs(spark, d):
    return builders.category_pairs(_products(spark, d))


def _artists(spark, d):
    tagged = table(spark, d, "lineitem").select(F.col("l_partkey").alias("artistID"), (F.col("l_suppkey") % 20).alias("tagID"))
    tags = spark.range(20).select(F.col("id").alias("tagID"), F.concat(F.lit("tag"), "id").alias("tagValue"))
    artists = parts(spark, d).select(F.col("p_partkey").alias("id"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(" no "), "p_partkey").alias("name"))
    plays = table(spark, d, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_suppkey").alias("user"), F.concat(F.lit("a"), "l_partkey").alias("item"), F.col("l_partkey").alias("artistID"), F.col("l_linenumber").cast("bigint").alias("plays"))
    named = parts(spark, d).select(F.col("p_partkey").alias("artistID"), F.concat("p_name", F.lit("  no  "), "p_partkey").alias("artist_name"))
    return tagged, tags, artists, plays.join(named, "artistID")


ARTISTS = """tg AS (SELECT l_partkey AS artistID, 'tag' || (l_suppkey % 20) AS tagValue, count(*) AS n FROM lineitem GROUP BY 1, 2), played AS (SELECT DISTINCT l_partkey AS artistID FROM lineitem WHERE l_partkey % 3 <> 0)"""


@query(f"""WITH {ARTISTS}, r AS (SELECT tagValue AS "user", 'a' || artistID AS item, n::DOUBLE AS label FROM tg JOIN played USING (artistID))
SELECT * FROM r WHERE "user" IN (SELECT "user" FROM r GROUP BY 1 HAVING count(*) >= 2)""")
def build_artist_tag_users(spark, d):
    return builders.artist_tag_users(*_artists(spark, d)).select("user", "item", "label")


@query(f"""WITH {ARTISTS}, f AS (SELECT tagValue FROM tg GROUP BY 1 HAVING sum(n) >= 50), b AS (SELECT *, row_number() OVER (PARTITION BY artistID ORDER BY n DESC, tagValue) AS place FROM tg WHERE tagValue IN (SELECT tagValue FROM f))
SELECT DISTINCT tagValue AS search_query, '  ' || upper(p_name) || ' no ' || artistID AS document, tagValue AS category, artistID::VARCHAR AS document_id FROM b JOIN played USING (artistID) JOIN part ON p_partkey = artistID WHERE place <= 3""")
def build_artist_tag_pairs(spark, d):
    return builders.artist_tag_pairs(*_artists(spark, d), top=3)


@query("""WITH bt AS (SELECT l_partkey AS b, l_suppkey % 20 AS t, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT DISTINCT 'tag' || t AS search_query, p_name || chr(10) || p_brand || chr(10) || (1900 + p_size)::VARCHAR AS document, 'tag' || t AS category, b::VARCHAR AS document_id FROM bt JOIN part ON p_partkey = b WHERE n >= 2""")
def build_book_pairs(spark, d):
    books = parts(spark, d).select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("authors"), (F.col("p_size") + 1900.0).alias("original_publication_year"))
    tagged = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("goodreads_book_id"), (F.col("l_suppkey") % 20).alias("tag_id")).agg(F.count("*").alias("count"))
    return builders.book_pairs(books, tagged, spark.range(20).select(F.col("id").alias("tag_id"), F.concat(F.lit("tag"), "id").alias("tag_name")), 2)


@query(f"""{W}, c AS (SELECT * FROM i WHERE "user" IN (SELECT "user" FROM i GROUP BY 1 HAVING count(*) >= 5)), p AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY time, item, label) - 1 AS place, count(*) OVER (PARTITION BY "user") AS size FROM c),
s AS (SELECT *, CASE WHEN place < floor(size * 0.6::DOUBLE) THEN 'train' WHEN place < floor(size * 0.8::DOUBLE) THEN 'query' ELSE 'truth' END AS part FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY "user", part ORDER BY place) AS n FROM s)
SELECT * EXCLUDE (n) FROM r WHERE part <> 'truth' OR n <= 4""")
def build_three_parts(spark, d):
    return builders.three_parts(rows_of(spark, d), truth=4)


@query(f"""WITH {PART_TAGS}, r AS (SELECT item, tag, CASE WHEN max(weight) OVER (PARTITION BY item) > 0 THEN weight / max(weight) OVER (PARTITION BY item) ELSE 0 END AS relevance FROM pt), k AS (SELECT * FROM r WHERE relevance >= 0.8)
SELECT tag, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 2""")
def relative_tags_kept(spark, d):
    rows = interactions.relative_weight(part_tags(spark, d), "item", "weight").where("relevance >= 0.8")
    return interactions.min_count(rows, "tag", 2).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT event_type AS query FROM events ORDER BY {draw(42, 'query')}, query LIMIT 3""")
def query_limit(spark, d):
    return builders.limited(table(spark, d, "events").select(F.col("event_type").alias("query")).distinct(), 3)


# --- neighbour modes, cold starts, tests ------------------------------------------------------------------------------
def _knn_sql(value: str) -> str:
    from .model_queries import MERGED, sims_sql

    return f"{W}, {MERGED}, {sims_sql('cosine', 20.0)} {value}"


@query(_knn_sql(f"SELECT m.\"user\", near.item, {q('sum(sim)', 8)} AS score FROM m JOIN near ON near.other = m.item GROUP BY 1, 2"))
def knn_score_binary(spark, d):
    return neighbours.scores(*_own_and_near(spark, d), "binary")


@query(_knn_sql(f"SELECT m.\"user\", near.item, {q('CASE WHEN sum(abs(sim)) > 0 THEN sum(sim * label) / sum(abs(sim)) ELSE 0 END', 8)} AS score FROM m JOIN near ON near.other = m.item GROUP BY 1, 2"))
def knn_score_normalised(spark, d):
    return neighbours.scores(*_own_and_near(spark, d), normalise=True)


@query(_knn_sql(f""", mu AS (SELECT item, avg(label) AS mean FROM m GROUP BY 1), c AS (SELECT m."user", near.item, CASE WHEN sum(abs(sim)) > 0 THEN sum(sim * (label - o.mean)) / sum(abs(sim)) ELSE 0 END AS x FROM m JOIN near ON near.other = m.item JOIN mu o ON o.item = m.item GROUP BY 1, 2)
SELECT c."user", item, {q(q('mean + x', 8))} AS score FROM c JOIN mu USING (item)"""))
def knn_score_centred(spark, d):
    own, near = _own_and_near(spark, d)
    out = neighbours.scores(own, near, "centred", means=own.groupBy("item").agg(F.avg("label").alias("mean")))
    return out.withColumn("score", S.quantised("score"))


@query(f"""{W}, {HALF}, pop AS (SELECT item, count(*) AS n, count(*) / max(count(*)) OVER () AS popularity FROM i GROUP BY 1),
x AS (SELECT DISTINCT "user", unnest([item, item + 1, -1]) AS item FROM i WHERE item % 50 = 0), y AS (SELECT "user", item FROM x UNION SELECT -5, item FROM x)
SELECT y."user", y.item, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i."user" = y."user" AND i.item = y.item) THEN -1.0 ELSE {q('coalesce(pop.popularity, 0) * (CASE WHEN y."user" = -5 OR pop.item IS NULL THEN 1 ELSE 1e-3 END)')} END AS score FROM y LEFT JOIN pop USING (item)""")
def knn_rules(spark, d):
    df = rows_of(spark, d)
    x = df.where("item % 50 = 0").select("user", F.explode(F.array(F.col("item"), F.col("item") + 1, F.lit(-1).cast("bigint"))).alias("item")).distinct()
    pairs = x.unionByName(x.select(F.lit(-5).cast("bigint").alias("user"), "item")).distinct()
    nothing = df.select("user", "item", F.lit(0.0).alias("score")).limit(0)
    out = neighbours.rules(pairs, nothing, df, interactions.popularity(df), tie=1e-3)
    return out.withColumn("score", F.when(F.col("score") == float("-inf"), -1.0).otherwise(S.quantised("score")))


@query(f"""{W}, f AS (SELECT "user", item, {q('avg(label)')} AS label FROM i GROUP BY 1, 2) SELECT (SELECT count(*) FROM f) AS n, (SELECT {q('avg(label)')} FROM f) AS mean""")
def merged_labels(spark, d):
    rows = neighbours.merged(rows_of(spark, d)).withColumn("label", S.quantised("label"))
    return rows.agg(F.count("*").alias("n"), S.quantised(F.avg("label")).alias("mean"))


def vector_sql(key: str) -> str:
    return f"[((({key} * 7 + x) % 11) - 5) / 10.0 FOR x IN range(8)]"


@query(f"""{W}, us AS (SELECT DISTINCT "user" FROM i), it AS (SELECT DISTINCT item FROM i),
s AS (SELECT u."user", it.item, {q('list_sum(list_transform(list_zip(' + vector_sql('u."user"') + ', ' + vector_sql('it.item') + '), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) + (it.item % 3) / 10.0')} AS score FROM us u, it WHERE NOT EXISTS (SELECT 1 FROM i WHERE i."user" = u."user" AND i.item = it.item))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 10""")
def factor_recommend(spark, d):
    df = cut(rows_of(spark, d).select("user", "item").distinct())  # users, items and what was seen come of it
    vector = lambda key: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: (((F.col(key) * 7 + x) % 11) - 5) / 10.0)
    users = df.select("user").distinct().select("user", vector("user").alias("factors"), F.lit(0.0).alias("bias"))
    items = df.select("item").distinct().select("item", vector("item").alias("factors"), ((F.col("item") % 3) / 10.0).alias("bias"))
    return factors.recommend(users, items, df, 10)


@query(None)
def wilcoxon_p_values(spark, d):
    return significance.wilcoxon(runs(spark, d)).select("Metric", "K", "Model_A", "Model_B", "statistic", S.quantised("p_value").alias("p_value"))


@query(None)
def t_test_p_values(spark, d):
    return significance.t_test(runs(spark, d)).select("Metric", "K", "Model_A", "Model_B", S.quantised("statistic").alias("statistic"), S.quantised("p_value").alias("p_value"))
