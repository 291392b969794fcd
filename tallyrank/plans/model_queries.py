"""The registered queries on retrieval, neighbours, factors, graphs and tests, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.text import STOP_WORDS
from ..functions.text import tokens as tokens_of
from ..functions.vectors import chunks, unit
from ..operators import alternating, ann, bm25, dense, factors, graph, history, late, metrics, neighbours, pairwise, significance
from ..operators.lineage import cut
from . import builders
from .queries import query
from .tables import INTERACTIONS, PART_DOCS, PART_TAGS, corpus, draw_int, part_docs, part_tags, passages, q, table, tokens, vectors
from .tables import interactions as rows_of

W = f"WITH {INTERACTIONS}"
DIM, TOKEN = 64, 16


# --- lexical retrieval ----------------------------------------------------------------------------------------------
def index_sql(docs: str) -> str:
    """Statistics and postings of a relation (doc_id, text)."""
    return f"""toks AS (SELECT doc_id, {tokens('text')} AS t FROM {docs}), dls AS (SELECT doc_id, len(t) AS dl, t FROM toks),
stats AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS average FROM dls),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM dls) GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(*) AS df, ln(1.0 + ((SELECT n FROM stats) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post GROUP BY 1)"""


def scores_sql(queries: str, key: str = "qid", text: str = "text") -> str:
    part = "qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT average FROM stats)))"
    return f"""asked AS (SELECT {key}, term, count(*) AS qtf FROM (SELECT {key}, unnest({tokens(text)}) AS term FROM {queries}) GROUP BY 1, 2),
scores AS (SELECT {key}, doc_id, {q(f'sum({part})')} AS score FROM asked JOIN dfs USING (term) JOIN post USING (term) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id) AS rank FROM scores)"""


QUERIES = "qs AS (SELECT item_id AS qid, text FROM benchmark)"
DOCS = "ds AS (SELECT doc_id, text FROM documents)"
BM25 = f"WITH {QUERIES}, {DOCS}, {index_sql('ds')}, {scores_sql('qs')}"


@query(f"WITH {DOCS}, {index_sql('ds')} SELECT term, df, {q('idf')} AS idf FROM dfs")
def bm25_stats(spark, d):
    return bm25.build(corpus(spark, d)).terms.withColumn("idf", S.quantised("idf"))


@query(f"{BM25} SELECT * FROM ranked WHERE rank <= 10")
def bm25_topk(spark, d):
    return bm25.search(bm25.build(corpus(spark, d)), corpus(spark, d), passages(spark, d), 10)


STOPPED = "list_filter({x}, lambda t: NOT list_contains(" + str(STOP_WORDS) + ", t))"


@query(f"{BM25.replace(tokens('text'), STOPPED.format(x=tokens('text')))} SELECT * FROM ranked WHERE rank <= 10")
def bm25_stop_words(spark, d):
    """Stop words left out of documents and queries."""
    return bm25.search(bm25.build(corpus(spark, d), STOP_WORDS), corpus(spark, d), passages(spark, d), 10, stop_words=STOP_WORDS)


@query(None)
def bm25_stemmed(spark, d):
    """As the search scorer does: without stop words, then stems. A test compares it with a plain loop."""
    how = {"stop_words": STOP_WORDS, "stems": True}
    return bm25.search(bm25.build(corpus(spark, d), **how), corpus(spark, d), passages(spark, d), 10, **how)


# relevant: the document has the passage's first eight tokens in a row
RELEVANT = f"""grams AS (SELECT DISTINCT doc_id, array_to_string(t[s : s + 7], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS s FROM toks WHERE len(t) >= 8)),
lead AS (SELECT qid, array_to_string(({tokens('text')})[1 : 8], ' ') AS g FROM qs WHERE len({tokens('text')}) >= 8), rel AS (SELECT qid, doc_id FROM lead JOIN grams USING (g))"""


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    t = tokens_of("text")
    docs = corpus(spark, d).select("doc_id", t.alias("t")).where(F.size("t") >= 8)
    grams = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 7), lambda s: F.array_join(F.slice("t", s, 8), " "))).alias("g"))
    lead = passages(spark, d).select("qid", t.alias("t")).where(F.size("t") >= 8).select("qid", F.array_join(F.slice("t", 1, 8), " ").alias("g"))
    return lead.join(grams, "g").select("qid", "doc_id").distinct()


@query(f"""{BM25}, {RELEVANT}, cand AS (SELECT DISTINCT qid, doc_id FROM rel UNION SELECT qid, (qid * 7) % 1000 FROM qs), hits AS (SELECT * FROM ranked WHERE rank <= 1000)
SELECT c.qid, c.doc_id, coalesce(h.score, 0) AS score FROM cand c LEFT JOIN hits h USING (qid, doc_id)""")
def bm25_candidates(spark, d):
    rows = _relevant(spark, d).unionByName(passages(spark, d).select("qid", (F.col("qid") * 7 % 1000).alias("doc_id"))).distinct()
    return bm25.candidates(bm25.search(bm25.build(corpus(spark, d)), corpus(spark, d), passages(spark, d), 1000), rows)


@query(f"""{BM25}, {RELEVANT}, hits AS (SELECT qid, doc_id, score FROM ranked WHERE rank <= 50), full_rows AS (SELECT qid AS gid, doc_id AS item, CASE WHEN r.doc_id IS NULL THEN 0.0 ELSE 1.0 END AS y_true, coalesce(score, 0) AS y_pred
 FROM (SELECT qid, doc_id, score FROM hits) h FULL JOIN (SELECT qid, doc_id, doc_id AS d2 FROM rel) r USING (qid, doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY y_pred DESC, item) AS rank, row_number() OVER (PARTITION BY gid ORDER BY y_true DESC, item) AS ideal, (y_true > 0)::INT AS hit FROM full_rows)
SELECT k AS K, 'NDCG' AS Metric, {q('avg(v)')} AS Value FROM (SELECT gid, k, CASE WHEN sum(CASE WHEN ideal <= k THEN y_true / log2(ideal + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rank <= k THEN y_true / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= k THEN y_true / log2(ideal + 1) ELSE 0 END) ELSE 0 END AS v FROM rk, (VALUES (5), (10)) ks(k) GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT k, 'PRECISION', {q('avg(v)')} FROM (SELECT gid, k, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / least(k, count(*)) AS v FROM rk, (VALUES (5), (10)) ks(k) GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT k, 'RECALL', {q('avg(v)')} FROM (SELECT gid, k, CASE WHEN sum(hit) > 0 THEN sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / sum(hit) ELSE 0 END AS v FROM rk, (VALUES (5), (10)) ks(k) GROUP BY 1, 2) GROUP BY 1""")
def bm25_full_eval(spark, d):
    hits = bm25.search(bm25.build(corpus(spark, d)), corpus(spark, d), passages(spark, d), 50)
    rows = bm25.full_rows(hits, _relevant(spark, d)).withColumnRenamed("qid", "gid")
    return metrics.evaluate(rows, [5, 10], ["NDCG", "PRECISION", "RECALL"]).withColumn("Value", S.quantised("Value"))


LAST = """lasts AS (SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY time DESC, item DESC, label DESC) AS back FROM i) WHERE back <= 20)"""
TAG_QUERY = f"""{LAST}, tw AS (SELECT "user", tag, {q('sum(weight)')} AS weight FROM lasts JOIN pt USING (item) GROUP BY 1, 2),
tq AS (SELECT "user", string_agg(tag, ' ' ORDER BY place) AS search_query FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY weight DESC, tag) AS place FROM tw) WHERE place <= 15 GROUP BY 1)"""


def _lasts(spark: SparkSession, d: str) -> DataFrame:
    return history.last_n(rows_of(spark, d), 20).select("user", F.explode("items").alias("item"))


@query(f"{W}, {PART_TAGS}, {TAG_QUERY} SELECT \"user\", coalesce(search_query, '') AS search_query FROM (SELECT DISTINCT \"user\" FROM lasts) LEFT JOIN tq USING (\"user\")")
def tag_query(spark, d):
    return bm25.tag_query(_lasts(spark, d), part_tags(spark, d))


def _as_user(k: int) -> str:
    return f"""hit AS (SELECT * FROM (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0) WHERE r <= {k}),
sc AS (SELECT *, (score - min(score) OVER (PARTITION BY query)) / (max(score) OVER (PARTITION BY query) - min(score) OVER (PARTITION BY query) + 1e-9) AS s FROM hit)
SELECT 'retrieval::' || query::VARCHAR AS "user", doc_id AS item, 1.0::DOUBLE AS label, r - 1 AS time, {q('s')} AS score FROM sc"""


@query(f"""WITH {PART_DOCS}, {PART_TAGS}, best AS (SELECT item, string_agg(tag, ' ' ORDER BY weight DESC, tag) AS t FROM pt GROUP BY 1),
ds AS (SELECT item AS doc_id, concat_ws(' ', text, t) AS text FROM pd LEFT JOIN best USING (item)), qs AS (SELECT DISTINCT tag AS query FROM pt), {index_sql('ds')}, {scores_sql('qs', 'query', 'query')}, {_as_user(100)}""")
def retrieval_as_user_tag(spark, d):
    return builders.retrieval_by_tag(part_docs(spark, d), part_tags(spark, d)).withColumn("score", S.quantised("score"))


@query(f"""{W}, {PART_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY time DESC, item DESC, label DESC) AS back FROM i),
qs AS (SELECT "user" AS query, string_agg(text, ' ' ORDER BY back DESC) AS sq FROM r JOIN pd USING (item) WHERE back <= 5 GROUP BY 1), ds AS (SELECT item AS doc_id, text FROM pd), {index_sql('ds')}, {scores_sql('qs', 'query', 'sq')}, {_as_user(20)}""")
def retrieval_as_user_profile(spark, d):
    return builders.retrieval_by_profile(rows_of(spark, d), part_docs(spark, d), k=20, items=5).withColumn("score", S.quantised("score"))


@query(f"""WITH {PART_DOCS}, cats AS (SELECT p_partkey AS item, p_type AS category FROM part), qs AS (SELECT category AS query FROM cats GROUP BY 1 HAVING count(DISTINCT item) >= 10),
ds AS (SELECT item AS doc_id, text FROM pd), {index_sql('ds')}, {scores_sql('qs', 'query', 'query')}, {_as_user(100)}""")
def retrieval_as_user_category(spark, d):
    cats = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"))
    return builders.retrieval_by_category(part_docs(spark, d), cats).withColumn("score", S.quantised("score"))


@query(f"WITH {PART_TAGS} SELECT tag AS \"user\", item, weight AS label, weight AS time FROM pt WHERE weight > 0.8")
def query_as_user(spark, d):
    rows = part_tags(spark, d).select(F.col("tag").alias("tagId"), F.col("item").alias("movieId"), F.col("weight").alias("relevance"))
    return builders.tag_users(rows, 0.8)


# --- item neighbours ------------------------------------------------------------------------------------------------
MERGED = 'm AS (SELECT "user", item, avg(label) AS label FROM i GROUP BY 1, 2)'


def pairs_sql(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT a.item, b.item AS other, sum(a.label * b.label) AS dot, count(*) AS common FROM {rows} a JOIN {rows} b ON a."user" = b."user" AND a.item < b.item GROUP BY 1, 2)"""


def sims_sql(kind: str, shrinkage: float) -> str:
    rows = "c" if kind == "adjusted" else "m"
    sim = "common::DOUBLE / (x.n + y.n - common)" if kind == "jaccard" else "dot / (x.norm * y.norm + 1e-12)"
    pairs = pairs_sql("pr", rows) if kind != "adjusted" else f"{pairs_sql('rawp', 'm')}, {pairs_sql('cp', 'c')}, pr AS (SELECT cp.item, cp.other, cp.dot, rawp.common FROM cp JOIN rawp USING (item, other))"
    centred = 'c AS (SELECT * FROM (SELECT "user", item, label - avg(label) OVER (PARTITION BY "user") AS label FROM m) WHERE label <> 0), ' if kind == "adjusted" else ""
    return f"""{centred}own AS (SELECT item, sqrt(sum(label * label)) + 1e-12 AS norm, count(*) AS n FROM {rows} GROUP BY 1), {pairs},
once AS (SELECT pr.item, other, {q(f'({sim}) * common / (common + {shrinkage} + 1e-12)')} AS sim, common FROM pr JOIN own x ON x.item = pr.item JOIN own y ON y.item = pr.other),
sims AS (SELECT * FROM once UNION ALL SELECT other, item, sim, common FROM once),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sim DESC, other) AS place FROM sims WHERE sim >= 0.02) WHERE place <= 20)"""


def _near(spark: SparkSession, d: str, kind: str, shrinkage: float) -> DataFrame:
    return neighbours.nearest(rows_of(spark, d), kind, shrinkage, 20, 0.02)


def _own_and_near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Merged rows and cosine neighbours, of histories that are made once; the neighbours in a table, as their joins depend on its size."""
    lists = neighbours.histories(rows_of(spark, d))
    return neighbours.rows_of(lists), cut(neighbours.nearest_of(lists, "cosine", 20.0, 20, 0.02))


@query(f"{W}, {MERGED}, {sims_sql('cosine', 20.0)} SELECT * FROM near")
def knn_cosine(spark, d):
    return _near(spark, d, "cosine", 20.0)


@query(f"{W}, {MERGED}, {sims_sql('adjusted', 20.0)} SELECT item, other, sim FROM sims WHERE sim > 0.05")
def knn_adjusted(spark, d):
    return neighbours.similarities(rows_of(spark, d), "adjusted", 20.0, 0.05).where("sim > 0.05").select("item", "other", "sim")


@query(f"{W}, {MERGED}, {sims_sql('jaccard', 5.0)} SELECT * FROM near")
def knn_jaccard(spark, d):
    return _near(spark, d, "jaccard", 5.0)


KNN_SCORES = f"ks AS (SELECT m.\"user\", near.item, {q('sum(sim * label)', 8)} AS score FROM m JOIN near ON near.other = m.item GROUP BY 1, 2)"
RECOMMENDED = """rec AS (SELECT * FROM (SELECT ks.*, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM ks WHERE NOT EXISTS (SELECT 1 FROM m WHERE m."user" = ks."user" AND m.item = ks.item)) WHERE rank <= 10)"""


@query(f"{W}, {MERGED}, {sims_sql('cosine', 20.0)}, {KNN_SCORES} SELECT * FROM ks")
def knn_score(spark, d):
    return neighbours.scores(*_own_and_near(spark, d))


@query(f"{W}, {MERGED}, {sims_sql('cosine', 20.0)}, {KNN_SCORES}, {RECOMMENDED} SELECT * FROM rec")
def knn_recommend(spark, d):
    rows, near = _own_and_near(spark, d)
    return neighbours.recommend(neighbours.scores(rows, near), rows, 10)


# --- vectors --------------------------------------------------------------------------------------------------------
UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""WITH {UNIT}, s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, {q(DOT.format(a='a.v', b='b.v'))} AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(spark, d):
    rows = vectors(spark, d)
    return dense.search(rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vector"), rows, 10, exclude_self=True)


@query(f"""WITH {UNIT}, r AS (SELECT vec_id AS qid, unnest([vec_id + 1, vec_id + 7, -1]) AS doc_id FROM embeddings) SELECT r.qid, r.doc_id, CASE WHEN b.vec_id IS NULL THEN -10.0 ELSE {q(DOT.format(a='a.v', b='b.v'))} END AS score FROM r JOIN u a ON a.vec_id = r.qid LEFT JOIN u b ON b.vec_id = r.doc_id""")
def dense_candidates(spark, d):
    rows = vectors(spark, d)
    wanted = rows.select(F.col("doc_id").alias("qid"), F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 7, F.lit(-1).cast("bigint"))).alias("doc_id"))
    normal = rows.withColumn("vector", unit("vector"))
    return dense.rerank(wanted, normal.select(F.col("doc_id").alias("qid"), "vector"), normal, score="dot")


@query(f"""{W}, {UNIT}, n AS (SELECT count(*) AS c FROM embeddings), h AS (SELECT DISTINCT "user", item % (SELECT c FROM n) AS item FROM i),
x AS (SELECT "user", unnest(v) AS x, generate_subscripts(v, 1) AS at_ FROM h JOIN u ON vec_id = item), me AS (SELECT "user", at_, {q('avg(x)')} AS x FROM x GROUP BY 1, 2)
SELECT "user", {q('sum(x * at_)')} AS fingerprint, count(*) AS dim FROM me GROUP BY 1""")
def centroid_query(spark, d):
    rows = vectors(spark, d).select(F.col("doc_id").alias("item"), "vector")
    h = rows_of(spark, d).select("user", (F.col("item") % F.lit(rows.count())).alias("item")).distinct()
    out = dense.centroid(h, rows, "user", DIM)
    return out.select("user", S.quantised(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)).alias("fingerprint"), F.size("vector").cast("bigint").alias("dim"))


def weights_sql(name: str, rows: str, key: str) -> str:
    return f"""{name}t AS (SELECT {key}, term, ln(1 + count(*)::DOUBLE) AS w FROM (SELECT {key}, unnest({tokens('text')}) AS term FROM {rows}) GROUP BY 1, 2), {name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}t)"""


@query(f"""WITH {QUERIES}, {DOCS}, {weights_sql('qw', 'qs', 'qid')}, {weights_sql('dw', 'ds', 'doc_id')}, s AS (SELECT qid, doc_id, {q('sum(qw.weight * dw.weight)')} AS score FROM qw JOIN dw USING (term) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def sparse_dot_topk(spark, d):
    asked = dense.sparse_weights(bm25.term_counts(passages(spark, d), "qid"), "qid")
    there = dense.sparse_weights(bm25.term_counts(corpus(spark, d), "doc_id"), "doc_id")
    return dense.best(dense.sparse_scores(asked, there), 10)


TOKENS = "tk AS (SELECT vec_id, [v[1:16], v[17:32], v[33:48], v[49:64]] AS t FROM u)"


@query(f"""WITH {UNIT}, {TOKENS}, s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, {q(f"list_sum(list_transform(a.t, lambda x: greatest(0, list_max(list_transform(b.t, lambda y: {DOT.format(a='x', b='y')})))))")} AS score FROM tk a, tk b WHERE a.vec_id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def maxsim_topk(spark, d):
    rows = vectors(spark, d).select("doc_id", chunks(unit("vector"), TOKEN, DIM // TOKEN).alias("vector"))
    return dense.search(rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vector"), rows, 5, score="max_sim")


@query(None)
def residual_quantise(spark, d):
    rows = vectors(spark, d).select("doc_id", F.posexplode(chunks(unit("vector"), TOKEN, DIM // TOKEN)).alias("place", "vector"))
    book = dense.fit_centroids(rows, 8)
    coded, _, means = dense.residual_buckets(dense.assign_centroids(rows, book))
    rebuilt = dense.reconstructed(coded, book, means)
    error = F.aggregate(F.zip_with("vector", "rebuilt", lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda s, x: s + x)
    return rebuilt.select("doc_id", "place", "code", S.quantised(error).alias("error"))


# token vectors of the masked tables: four bytes of the token's hash
PIECES = r"""regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"""
TOKENS = f"""dt AS (SELECT doc_id, unnest(list_concat(['[D]'], {PIECES})[1:180]) AS token FROM documents WHERE text IS NOT NULL),
dk AS MATERIALIZED (SELECT DISTINCT doc_id, token FROM dt WHERE token = '[D]' OR NOT regexp_matches(token, '^[^\\s\\p{{L}}\\p{{N}}]$')),
qo AS (SELECT item_id AS qid, list_concat(['[Q]'], {PIECES})[1:32] AS t FROM benchmark WHERE text IS NOT NULL),
qt AS MATERIALIZED (SELECT qid, token, count(*) AS n FROM (SELECT qid, unnest(list_concat(t, list_resize(['[MASK]'], 32 - len(t), '[MASK]'))) AS token FROM qo) GROUP BY 1, 2),
vec AS MATERIALIZED (SELECT token, list_transform([1, 3, 5, 7], lambda j: (('0x' || substr(md5(token), j, 2))::INTEGER - 127.5) / 128.0::DOUBLE) AS v FROM (SELECT token FROM dk UNION SELECT token FROM qt))"""


def _token_vectors(tokens):
    """Four bytes of each token's hash, which is made once for all four."""
    numbers = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"))
    return F.transform(numbers, lambda n: F.array(*[(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("double") - 127.5) / 128.0 for s in (24, 16, 8, 0)]))


@query(f"""WITH {TOKENS}, pair AS MATERIALIZED (SELECT a.token AS qtoken, b.token, list_dot_product(a.v, b.v) AS s FROM (SELECT DISTINCT token FROM qt) x JOIN vec a USING (token), (SELECT DISTINCT token FROM dk) y JOIN vec b USING (token)),
top AS (SELECT qtoken, doc_id, greatest(0, max(s)) AS s FROM dk JOIN pair USING (token) GROUP BY 1, 2), sc AS (SELECT qid, doc_id, {q('sum(n * s)')} AS score FROM qt JOIN top ON top.qtoken = qt.token GROUP BY 1, 2)
SELECT qid, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""")
def maxsim_masked(spark, d):
    """Benchmark texts padded to 32 tokens against documents of 180 tokens whose signs are masked."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", late.document_tokens("text").alias("t"))
    docs = docs.select("doc_id", late.unmasked(_token_vectors("t.token"), "t.keep").alias("vector"))
    asked = table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("qid"), _token_vectors(late.query_tokens("text")).alias("vector"))
    return dense.search(asked, docs, 5, score="max_sim", most=late.DOCUMENT_LENGTH * 4)


EDGES, MEANS = [-0.1, 0.0, 0.1], [-0.15, -0.05, 0.05, 0.15]
BOOK = [[(1.0 if c == k else 0.0) * (0.2 if k < 8 else -0.2) for c in range(8)] for k in range(8)] + [[(-0.2 if c == k else 0.0) for c in range(8)] for k in range(8)]
PACKED = f"""u AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings WHERE len(embedding) > 0),
tok AS MATERIALIZED (SELECT doc_id, place, v[8 * place + 1 : 8 * place + 8] AS v FROM u, (SELECT unnest(range(0, 8)) AS place)), book AS (SELECT unnest({BOOK}) AS c, unnest(range(0, 16)) AS code),
own AS (SELECT doc_id, place, any_value(v) AS v, arg_max(c, -code + 1000 * s) AS c, arg_max(code, -code + 1000 * s) AS code FROM (SELECT tok.*, c, code, floor(list_dot_product(v, c) * 1e9 + 0.5) AS s FROM tok, book) GROUP BY 1, 2),
b AS MATERIALIZED (SELECT doc_id, place, v, c, code, list_transform(list_zip(v, c), lambda z: CASE WHEN z[1] - z[2] > 0.1 THEN 3 WHEN z[1] - z[2] > 0.0 THEN 2 WHEN z[1] - z[2] > -0.1 THEN 1 ELSE 0 END) AS b FROM own)"""


def _packed(spark, d):
    rows = vectors(spark, d).where(F.size("vector") > 0).select("doc_id", F.posexplode(chunks(unit("vector"), 8, 8)).alias("place", "vector"))
    book = late.Book(BOOK, [EDGES] * 8, [MEANS] * 8)
    return late.encoded(rows, book), book


@query(f"""WITH {PACKED} SELECT doc_id, place::INTEGER AS place, code::INTEGER AS code, printf('%02X%02X', b[1] + 4 * b[2] + 16 * b[3] + 64 * b[4], b[5] + 4 * b[6] + 16 * b[7] + 64 * b[8]) AS packed FROM b""")
def packed_codes(spark, d):
    return _packed(spark, d)[0].select("doc_id", "place", "code", F.hex("packed").alias("packed"))


@query(f"""WITH {PACKED}, r AS MATERIALIZED (SELECT doc_id, place, list_transform(list_zip(c, b), lambda z: z[1] + CASE z[2]::INTEGER WHEN 3 THEN 0.15 WHEN 2 THEN 0.05 WHEN 1 THEN -0.05 ELSE -0.15 END::DOUBLE) AS r FROM b),
top AS (SELECT a.doc_id AS qid, a.place, r.doc_id, greatest(0, max(list_dot_product(a.v, r.r))) AS s FROM tok a, r WHERE a.doc_id % 50 = 0 GROUP BY 1, 2, 3), sc AS (SELECT qid, doc_id, {q('sum(s)')} AS score FROM top GROUP BY 1, 2)
SELECT qid, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""")
def packed_search(spark, d):
    """Scores from codes and tables alone; the SQL rebuilds the vectors."""
    coded, book = _packed(spark, d)
    asked = vectors(spark, d).where("doc_id % 50 = 0").where(F.size("vector") > 0).select(F.col("doc_id").alias("qid"), chunks(unit("vector"), 8, 8).alias("vector"))
    return late.packed_search(asked, coded, book, 5)


CELLS_SQL = f"""u AS MATERIALIZED (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings WHERE len(embedding) > 0),
cell AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('0|' || doc_id::VARCHAR), doc_id) - 1 AS cell, v AS c FROM u ORDER BY md5('0|' || doc_id::VARCHAR), doc_id LIMIT 16),
near AS MATERIALIZED (SELECT doc_id, v, cell, row_number() OVER (PARTITION BY doc_id ORDER BY floor(list_dot_product(v, c) * 1e9 + 0.5) DESC, cell) AS place FROM u, cell)"""


@query(f"""WITH {CELLS_SQL}, met AS (SELECT a.doc_id AS qid, b.doc_id, {q('list_dot_product(a.v, b.v)')} AS score FROM near a JOIN near b ON a.cell = b.cell AND b.place = 1 WHERE a.place <= 5 AND a.doc_id % 20 = 0)
SELECT qid, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM met) WHERE rank <= 10""")
def dense_cells(spark, d):
    """Search in the lists of the five nearest of sixteen cells, which are vectors of the table."""
    rows = vectors(spark, d)
    return ann.search(rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vector"), ann.build(rows, 16, 0), 10, 5)


@query(None)
def dense_approximate(spark, d):
    """The ten nearest by the inverted file with as many probes as a sample of queries needs, and the share of each query's exact ten that is among them."""
    rows = vectors(spark, d)
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vector")
    index = ann.build(rows)
    found = ann.search(asked, index, 10, ann.tuned_probes(asked, index, rows, 10, 0.93))
    return found.join(ann.recall(found, dense.search(asked, rows, 10)), "qid", "left")


# --- factors and graphs ---------------------------------------------------------------------------------------------
BIAS = f"""mu AS (SELECT avg(label) AS mean FROM i), ub AS (SELECT "user", {q('avg(label - (SELECT mean FROM mu))', 9)} AS bias FROM i GROUP BY 1), ib AS (SELECT item, {q('avg(label - (SELECT mean FROM mu))', 9)} AS bias FROM i GROUP BY 1)"""


@query(f"{W}, {BIAS} SELECT 'user' AS kind, \"user\"::VARCHAR AS id, bias FROM ub UNION ALL SELECT 'item', item::VARCHAR, bias FROM ib")
def bias_terms(spark, d):
    return factors.bias_terms(rows_of(spark, d))


def _fixed(key: str):
    """Four fixed factors of an id."""
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: ((F.col(key) * j) % 7 - 3) / 10.0)


FIXED = "list_transform([1, 2, 3, 4], lambda j: (({x} * j) % 7 - 3) / 10.0::DOUBLE)"


@query(f"""{W}, {BIAS}, r AS (SELECT DISTINCT "user", (item + 1) % 2500 AS item FROM i), uf AS (SELECT *, {FIXED.format(x='"user"')} AS f FROM ub), vf AS (SELECT *, {FIXED.format(x='item')} AS f FROM ib)
SELECT r."user", r.item, {q(f"CASE WHEN uf.f IS NOT NULL AND vf.f IS NOT NULL THEN (SELECT mean FROM mu) + uf.bias + vf.bias + {DOT.format(a='uf.f', b='vf.f')} ELSE (SELECT mean FROM mu) END")} AS score
FROM r LEFT JOIN uf ON uf."user" = r."user" LEFT JOIN vf ON vf.item = r.item""")
def factor_score(spark, d):
    rows = rows_of(spark, d)
    mean = factors.global_mean(rows)
    users, items = (factors.biases(rows, k, mean).withColumn("factors", _fixed(k)) for k in ("user", "item"))
    wanted = rows.select("user", ((F.col("item") + 1) % 2500).alias("item")).distinct()
    return factors.score(wanted, users, items, mean)


@query(f"""{W}, {BIAS}, pop AS (SELECT item FROM i GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 50), r AS (SELECT DISTINCT "user", (item + 1) % 2500 AS item FROM i)
SELECT r."user", r.item, CASE WHEN ub.bias IS NOT NULL AND ib.bias IS NOT NULL THEN {q(f"(SELECT mean FROM mu) + ub.bias + ib.bias + {DOT.format(a=FIXED.format(x='r."user"'), b=FIXED.format(x='r.item'))}")} ELSE {q("(SELECT mean FROM mu)")} + CASE WHEN pop.item IS NOT NULL THEN 0.01 ELSE 0 END END AS score
FROM r LEFT JOIN ub ON ub."user" = r."user" LEFT JOIN ib ON ib.item = r.item LEFT JOIN pop ON pop.item = r.item""")
def nmf_score(spark, d):
    from ..operators.interactions import popularity

    rows = rows_of(spark, d)
    mean = factors.global_mean(rows)
    users, items = (factors.biases(rows, k, mean).withColumn("factors", _fixed(k)) for k in ("user", "item"))
    wanted = rows.select("user", ((F.col("item") + 1) % 2500).alias("item")).distinct()
    best = popularity(rows).orderBy(F.desc("n"), "item").limit(50)
    rough = mean if mean is None else float(int(mean * 1e6 + 0.5)) / 1e6
    return factors.cold_start(factors.score(wanted, users, items, mean), users, items, best, rough)


@query(None)
def als_train(spark, d):
    """The error of each sweep, and whether it is the one that is kept."""
    found = alternating.fit(neighbours.merged(rows_of(spark, d)), rank=8, sweeps=4)
    return spark.createDataFrame([(i, e, i == found.kept) for i, e in enumerate(found.errors, 1)], "sweep int, rmse double, kept boolean")


TWO = "(({x} * {j}) % 7 - 3) / 10.0::DOUBLE"


@query(f"""{W}, {MERGED}, mu AS (SELECT avg(label) AS mean FROM m), vf AS (SELECT item, {TWO.format(x='item', j=1)} AS a, {TWO.format(x='item', j=2)} AS b, (item % 3 - 1) / 5.0::DOUBLE AS bias FROM (SELECT DISTINCT item FROM m)),
s AS (SELECT "user", 0.1::DOUBLE * count(*) AS reg, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * (label - mean - bias)) AS ya, sum(b * (label - mean - bias)) AS yb FROM m JOIN vf USING (item), mu GROUP BY 1)
SELECT "user", {q('((bb + reg) * ya - ab * yb) / ((aa + reg) * (bb + reg) - ab * ab)')} AS f1, {q('((aa + reg) * yb - ab * ya) / ((aa + reg) * (bb + reg) - ab * ab)')} AS f2 FROM s""")
def als_half_sweep(spark, d):
    rows = neighbours.merged(rows_of(spark, d))
    two = F.array(*[((F.col("item") * j) % 7 - 3) / 10.0 for j in (1, 2)])
    items = rows.select("item").distinct().select("item", two.alias("factors"), ((F.col("item") % 3 - 1) / 5.0).alias("bias"))
    found = alternating.half_sweep(rows, items, "user", "item", 2, factors.global_mean(rows), 0.1, True)
    return found.select("user", S.quantised(F.col("factors")[0]).alias("f1"), S.quantised(F.col("factors")[1]).alias("f2"))


@query(None)
def ridge_solve(spark, d):
    rows = neighbours.merged(rows_of(spark, d))
    items = rows.select("item").distinct().withColumn("factors", _fixed("item"))
    return factors.ridge_step(rows, items, "user", "item", 0.1).select("user", S.quantised(F.aggregate("factors", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(None)
def nmf_train(spark, d):
    rows = factors.scaled_labels(neighbours.merged(rows_of(spark, d)))
    found = alternating.fit_nonnegative(rows, rank=8, iterations=4, tolerance=0.0)
    return found.users.select("user", F.size("factors").alias("rank"), (F.array_min("factors") >= 0).alias("nonnegative"))


ONES = "(({x} * {j}) % 7 + 1) / 10.0::DOUBLE"


@query(f"""{W}, {MERGED}, w AS (SELECT "user", {ONES.format(x='"user"', j=1)} AS a, {ONES.format(x='"user"', j=2)} AS b FROM (SELECT DISTINCT "user" FROM m)), h AS (SELECT item, {ONES.format(x='item', j=1)} AS a, {ONES.format(x='item', j=2)} AS b FROM (SELECT DISTINCT item FROM m)),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM h), x AS (SELECT "user", sum(label * a) AS a, sum(label * b) AS b FROM m JOIN h USING (item) GROUP BY 1)
SELECT "user", {q('w.a * x.a / (w.a * aa + w.b * ab + 0.5 * w.a + 0.25)')} AS f1, {q('w.b * x.b / (w.a * ab + w.b * bb + 0.5 * w.b + 0.25)')} AS f2, {q('w.a * x.a + w.b * x.b')} AS cross_sum FROM w JOIN x USING ("user"), g""")
def nmf_step(spark, d):
    rows = neighbours.merged(rows_of(spark, d))
    side = lambda k: rows.select(k).distinct().select(k, F.array(*[((F.col(k) * j) % 7 + 1) / 10.0 for j in (1, 2)]).alias("factors"))
    found = alternating.multiplied(rows, side("user"), side("item"), "user", "item", alternating.gram(side("item"), 2), 0.25, 0.5)
    return found.select("user", S.quantised(F.col("factors")[0]).alias("f1"), S.quantised(F.col("factors")[1]).alias("f2"), S.quantised("cross").alias("cross_sum"))


# users' and items' codes, and an item that the user does not have for each pair
CODED = """ip AS (SELECT DISTINCT "user", item FROM i), uc AS (SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS u FROM (SELECT DISTINCT "user" FROM ip)), ic AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM ip)),
c AS MATERIALIZED (SELECT u, i FROM ip JOIN uc USING ("user") JOIN ic USING (item)), m AS (SELECT count(*) AS m FROM ic)"""


def _turn(turn: str) -> str:
    return f"{draw_int(42, '0', 'u', 'i', turn)} % (SELECT m FROM m)"


DRAWN = f"""d0 AS (SELECT u, i, turn, {_turn('turn')} AS j FROM c, (SELECT unnest(range(0, 8)) AS turn)), f0 AS (SELECT u, i, arg_min(j, turn) AS j FROM d0 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.u = d0.u AND c.i = d0.j) GROUP BY 1, 2),
r0 AS (SELECT u, i FROM c WHERE NOT EXISTS (SELECT 1 FROM f0 WHERE f0.u = c.u AND f0.i = c.i)), lack AS (SELECT u, x.i AS j, row_number() OVER (PARTITION BY u ORDER BY x.i) - 1 AS r, count(*) OVER (PARTITION BY u) AS n FROM (SELECT DISTINCT u FROM r0) y, ic x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.u = y.u AND c.i = x.i)),
n0 AS (SELECT * FROM f0 UNION ALL SELECT r0.u, r0.i, l.j FROM r0 JOIN lack l ON l.u = r0.u AND l.r = {draw_int(42, '0', 'r0.u', 'r0.i', "'rest'")} % l.n)"""


def _few_items(spark, d):
    """Interactions with items folded to 60, so that there are users who have most of them."""
    return rows_of(spark, d).withColumn("item", F.col("item") % 60)


FEW = INTERACTIONS.replace("l_partkey AS item", "l_partkey % 60 AS item")


@query(f"""WITH {FEW}, {CODED}, {DRAWN} SELECT "user", a.item, b.item AS negative FROM n0 JOIN uc USING (u) JOIN ic a ON a.i = n0.i JOIN ic b ON b.i = n0.j""")
def pair_negatives(spark, d):
    c = pairwise.coded(_few_items(spark, d))
    found = pairwise.negatives(c.pairs, c.m)
    return found.join(c.users, "u").join(c.items, "i").join(c.items.select(F.col("i").alias("j"), F.col("item").alias("negative")), "j").select("user", "item", "negative")


@query(f"""{W}, {CODED}, d0 AS (SELECT u, i, turn, {_turn('turn')} AS j FROM c, (SELECT unnest(range(1, 11)) AS turn)),
us AS (SELECT u, {FIXED.format(x='u')} AS f FROM uc), vs AS (SELECT i, {FIXED.format(x='i')} AS f FROM ic),
sc AS (SELECT us.u, vs.i, {q('f1 + f2 + f3 + f4', 9)} AS s FROM (SELECT u, i, us.f[1] * vs.f[1] AS f1, us.f[2] * vs.f[2] AS f2, us.f[3] * vs.f[3] AS f3, us.f[4] * vs.f[4] AS f4 FROM us, vs) JOIN us USING (u) JOIN vs USING (i)),
near AS (SELECT d0.* FROM d0 JOIN sc a ON a.u = d0.u AND a.i = d0.i JOIN sc b ON b.u = d0.u AND b.i = d0.j WHERE b.s > a.s - 0.1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.u = d0.u AND c.i = d0.j)),
v AS (SELECT u, i, min(turn) AS trials, arg_min(j, turn) AS j FROM near GROUP BY 1, 2)
SELECT "user", a.item, b.item AS negative, trials::INTEGER AS trials, {q('least(10.0, ln(greatest(1.0, floor(((SELECT m FROM m) - 1) / trials))))')} AS weight FROM v JOIN uc USING (u) JOIN ic a ON a.i = v.i JOIN ic b ON b.i = v.j""")
def warp_violations(spark, d):
    c = pairwise.coded(rows_of(spark, d))
    side = lambda codes, key: codes.select(key, *[(((F.col(key) * j) % 7 - 3) / 10.0).alias(f"x{j}") for j in range(1, 5)])
    found = pairwise.violations(c.pairs, side(c.users, "u"), side(c.items, "i"), [f"x{j}" for j in range(1, 5)], c.m, margin=0.1)
    named = found.join(c.users, "u").join(c.items, "i").join(c.items.select(F.col("i").alias("j"), F.col("item").alias("negative")), "j")
    return named.select("user", "item", "negative", "trials", S.quantised("weight").alias("weight"))


def _smoothed(out: str, state: str) -> str:
    """A relation (node, at_, x) smoothed over two layers with equal weights."""
    layer = lambda name, of: f"{name} AS MATERIALIZED (SELECT src AS node, at_, sum(weight * x) AS x FROM g JOIN {of} ON dst = node GROUP BY 1, 2)"
    return f"{layer(out + '1', state)}, {layer(out + '2', out + '1')}, {out} AS MATERIALIZED (SELECT node, at_, sum(x) / 3 AS x FROM (SELECT * FROM {state} UNION ALL SELECT * FROM {out}1 UNION ALL SELECT * FROM {out}2) GROUP BY 1, 2)"


@query(f"""{W}, {CODED}, one AS (SELECT 2 * u AS src, 2 * i + 1 AS dst FROM c), both_ AS (SELECT * FROM one UNION ALL SELECT dst, src FROM one), deg AS (SELECT src, count(*)::DOUBLE AS d FROM both_ GROUP BY 1),
g AS MATERIALIZED (SELECT b.src, b.dst, 1.0 / sqrt(x.d * y.d) AS weight FROM both_ b JOIN deg x ON x.src = b.src JOIN deg y ON y.src = b.dst),
e0 AS MATERIALIZED (SELECT src AS node, unnest([1, 2, 3, 4]) AS at_, ((src * unnest([1, 2, 3, 4])) % 7 - 3) / 10.0::DOUBLE AS x FROM deg), {_smoothed('e', 'e0')},
t AS MATERIALIZED (SELECT u, i, (7 * i + u + 1) % (SELECT m FROM m) AS j FROM c),
dif AS MATERIALIZED (SELECT t.*, x.at_, x.x AS ux, y.x AS ix, z.x AS jx FROM t JOIN e x ON x.node = 2 * u JOIN e y ON y.node = 2 * i + 1 AND y.at_ = x.at_ JOIN e z ON z.node = 2 * j + 1 AND z.at_ = x.at_),
sl AS MATERIALIZED (SELECT u, i, j, (1 / (1 + exp(-sum(ux * (ix - jx)))) - 1) / (SELECT count(*) FROM t) AS slope, ln(1 + exp(-sum(ux * (ix - jx)))) / (SELECT count(*) FROM t) AS loss FROM dif GROUP BY 1, 2, 3),
gr AS MATERIALIZED (SELECT node, at_, sum(x) AS x FROM (SELECT 2 * u AS node, at_, slope * (ix - jx) AS x FROM dif JOIN sl USING (u, i, j) UNION ALL SELECT 2 * i + 1, at_, slope * ux FROM dif JOIN sl USING (u, i, j) UNION ALL SELECT 2 * j + 1, at_, -slope * ux FROM dif JOIN sl USING (u, i, j)) GROUP BY 1, 2), {_smoothed('b', 'gr')},
n AS (SELECT node, count(*) AS n FROM (SELECT 2 * u AS node FROM t UNION ALL SELECT 2 * i + 1 FROM t UNION ALL SELECT 2 * j + 1 FROM t) GROUP BY 1), ls AS (SELECT 2 * u AS node, sum(loss) AS loss FROM sl GROUP BY 1),
reg AS (SELECT node, at_, 0.5 / (SELECT count(*) FROM t) * n * x AS x FROM n JOIN e0 USING (node)), al AS (SELECT node, at_, sum(x) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM reg) GROUP BY 1, 2)
SELECT node, {q('1e3 * coalesce(any_value(loss), 0)')} AS loss, {', '.join(f"{q(f'1e3 * sum(x) FILTER (WHERE at_ = {k})')} AS g{k}" for k in range(1, 5))} FROM al LEFT JOIN ls USING (node) GROUP BY node""")
def graph_gradient(spark, d):
    """A thousand times the gradient of the pairwise loss, by the vectors that two layers smooth."""
    c = pairwise.coded(rows_of(spark, d))
    names = [f"x{j}" for j in range(1, 5)]
    edges = cut(pairwise.item_graph(c.pairs))
    nodes = edges.select(F.col("src").alias("node")).distinct()
    state = nodes.select("node", *[(((F.col("node") * j) % 7 - 3) / 10.0).alias(f"x{j}") for j in range(1, 5)])
    triples = c.pairs.select(pairwise.user_node("u").alias("u"), pairwise.item_node("i").alias("i"), (((7 * F.col("i") + F.col("u") + 1) % c.m) * 2 + 1).alias("j"))
    found = pairwise.state_gradient(cut(triples), cut(state), edges, names, [1 / 3] * 3, triples.count(), 0.5)
    return found.select("node", *[S.quantised(F.col(x) * 1e3).alias(name) for x, name in [("loss", "loss"), *((f"g_x{j}", f"g{j}") for j in range(1, 5))]])


@query(None)
def graph_train(spark, d):
    found = pairwise.train(rows_of(spark, d), dim=8, layers=2, epochs=4, rate=0.1, reg=1e-4)
    return spark.createDataFrame(list(enumerate(found.losses, 1)), "epoch int, loss double")


@query(None)
def warp_train(spark, d):
    found = pairwise.train(rows_of(spark, d), dim=8, epochs=3, loss="warp", optimiser="adagrad", bias=True)
    return found.items


@query(None)
def bpr_train(spark, d):
    found = pairwise.train(rows_of(spark, d), dim=8, epochs=2)
    return found.users.select(F.lit("user").alias("kind"), F.col("user").alias("id"), "factors").unionByName(found.items.select(F.lit("item").alias("kind"), F.col("item").alias("id"), "factors"))


@query(f"""WITH f AS (SELECT event_id, [value / 100.0::DOUBLE, (user_id % 10) / 10.0::DOUBLE, (event_id % 3)::DOUBLE] AS x FROM events)
SELECT event_id, {q("0.5 + (0.1 * x[1] + 0.2 * x[2] - 0.3 * x[3]) + ((0.5 * x[1] - 0.4 * x[2] + 0.3 * x[3]) ** 2 - (0.25 * x[1] * x[1] + 0.16 * x[2] * x[2] + 0.09 * x[3] * x[3])) * 0.5 + ((0.1 * x[1] + 0.2 * x[2] + 0.3 * x[3]) ** 2 - (0.01 * x[1] * x[1] + 0.04 * x[2] * x[2] + 0.09 * x[3] * x[3])) * 0.5", 12)} AS score FROM f""")
def fm_score(spark, d):
    rows = table(spark, d, "events").select("event_id", F.array(F.col("value") / 100.0, (F.col("user_id") % 10) / 10.0, (F.col("event_id") % 3).cast("double")).alias("features"))
    return factors.fm_score(rows, [0.1, 0.2, -0.3], [[0.5, 0.1], [-0.4, 0.2], [0.3, 0.3]], 0.5).select("event_id", "score")


def _layer(name: str, state: str) -> str:
    return f"{name} AS (SELECT src AS node, at_, sum(weight * x) AS x FROM g JOIN {state} ON dst = node GROUP BY 1, 2)"


@query(f"""{W}, one AS (SELECT DISTINCT 'u' || "user" AS src, 'i' || item AS dst FROM i), both_ AS (SELECT * FROM one UNION ALL SELECT dst, src FROM one), deg AS (SELECT src, count(*)::DOUBLE AS d FROM both_ GROUP BY 1),
g AS (SELECT b.src, b.dst, 1.0 / sqrt(x.d * y.d) AS weight FROM both_ b JOIN deg x ON x.src = b.src JOIN deg y ON y.src = b.dst),
e0 AS (SELECT src AS node, unnest([1, 2, 3, 4]) AS at_, ((substr(src, 2)::BIGINT * unnest([1, 2, 3, 4])) % 7 - 3) / 10.0::DOUBLE AS x FROM deg), {_layer('e1', 'e0')}, {_layer('e2', 'e1')}
SELECT node, at_ - 1 AS place, {q('sum(x) / 3')} AS x FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY 1, 2""")
def gcn_propagate(spark, d):
    g = cut(graph.edges(rows_of(spark, d)))  # the nodes come of it, and every layer
    nodes = g.select(F.col("src").alias("node")).distinct().withColumn("id", F.substring("node", 2, 20).cast("bigint")).select("node", _fixed("id").alias("vector"))
    return graph.propagate(g, nodes, 2).select("node", F.posexplode("vector").alias("place", "x"))


@query(f"{W} SELECT \"user\", string_agg(item::VARCHAR, ',' ORDER BY back DESC) AS items FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY time DESC, item DESC, label DESC) AS back FROM i) WHERE back <= 50 GROUP BY 1")
def seq_last_n(spark, d):
    return history.last_n(rows_of(spark, d), 50).select("user", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"""{W}, st AS (SELECT item, lead(item) OVER (PARTITION BY "user" ORDER BY time, item, label) AS next FROM i), c AS (SELECT item, next, count(*) AS n FROM st WHERE next IS NOT NULL GROUP BY 1, 2), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY item) AS share FROM c),
la AS (SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY time DESC, item DESC, label DESC) AS back FROM i) WHERE back = 1)
SELECT "user", next AS item, {q('share')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, next) AS rank FROM la JOIN sh USING (item)) WHERE rank <= 5""")
def seq_next_items(spark, d):
    rows = rows_of(spark, d)
    last = history.last_n(rows, 1).select("user", F.element_at("items", 1).alias("item"))
    return graph.next_items(last, graph.transitions(rows), 5)


# --- tests and reports: runs are years, models market segments ------------------------------------------------------
RUNS = """runs AS (SELECT year(o_orderdate) AS RunId, c_mktsegment AS Model, k AS K, 'REVENUE' AS Metric, avg(o_totalprice / k) / 1000000.0 AS Value FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES (5), (10)) ks(k) GROUP BY 1, 2, 3)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.year("o_orderdate").alias("RunId"), F.col("c_mktsegment").alias("Model"), "o_totalprice", F.explode(F.array(F.lit(5), F.lit(10))).alias("K"))
    return rows.groupBy("RunId", "Model", "K").agg((F.avg(F.col("o_totalprice") / F.col("K")) / 1e6).alias("Value")).withColumn("Metric", F.lit("REVENUE"))


PAIRED = f"""{RUNS}, whole AS (SELECT Metric, K, RunId FROM runs GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(DISTINCT Model) FROM runs)), kept AS (SELECT runs.* FROM runs JOIN whole USING (Metric, K, RunId)),
paired AS (SELECT x.Metric, x.K, x.RunId, x.Model AS Model_A, y.Model AS Model_B, x.Value AS a, y.Value AS b FROM kept x JOIN kept y ON x.Metric = y.Metric AND x.K = y.K AND x.RunId = y.RunId AND x.Model < y.Model)"""


@query(f"WITH {PAIRED} SELECT Metric, K, RunId, Model_A, Model_B, {q('a')} AS a, {q('b')} AS b FROM paired")
def paired_runs(spark, d):
    return significance.paired(runs(spark, d)).withColumn("a", S.quantised("a")).withColumn("b", S.quantised("b"))


@query(f"""WITH {PAIRED}, s AS (SELECT Metric, K, Model_A, Model_B, count(*) AS N_runs, avg(a) AS ma, avg(b) AS mb, avg(a - b) AS md, stddev_samp(a - b) AS sd FROM paired GROUP BY 1, 2, 3, 4)
SELECT Metric, K, Model_A, Model_B, N_runs, {q('ma', 9)} AS mean_A, {q('mb', 9)} AS mean_B, {q('md', 9)} AS mean_diff, {q('md / (sd / sqrt(N_runs))')} AS statistic FROM s""")
def ttest_stat(spark, d):
    return significance.t_statistic(significance.paired(runs(spark, d)))


@query(f"""WITH {PAIRED}, d AS (SELECT *, {q('a - b', 12)} AS d FROM paired), z AS (SELECT *, abs(d) AS s FROM d WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY Metric, K, Model_A, Model_B ORDER BY s) + (count(*) OVER (PARTITION BY Metric, K, Model_A, Model_B, s) - 1) / 2.0 AS rk FROM z)
SELECT Metric, K, Model_A, Model_B, count(*) AS N_effective, sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS W_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0 END)::DOUBLE AS W_minus FROM r GROUP BY 1, 2, 3, 4""")
def wilcoxon_stat(spark, d):
    return significance.signed_ranks(significance.paired(runs(spark, d))).drop("ties", "statistic")


@query(None)
def significance_diagnostics(spark, d):
    rows = runs(spark, d)
    return significance.wilcoxon(rows, min_runs=3).unionByName(significance.t_test(rows))


@query(None)
def significance_marked(spark, d):
    rows = runs(spark, d)
    return significance.marked(rows, significance.t_test(rows, alpha=0.5))


@query(f"""WITH {RUNS}, me AS (SELECT Model, K, Metric, avg(Value) AS mean FROM runs GROUP BY 1, 2, 3) SELECT Model, K, Metric, {q('mean')} AS mean, mean >= max(mean) OVER (PARTITION BY K, Metric) - 1e-12 AS best FROM me""")
def summary_best(spark, d):
    from ..sources.sinks import summary

    return summary(runs(spark, d)).withColumn("mean", S.quantised("mean"))


@query("SELECT user_id AS \"user\", event_type AS item, date_trunc('day', ts)::DATE AS day, count(*) AS n, " + q("sum(value)", 4) + " AS label FROM events GROUP BY 1, 2, 3")
def windowed_events(spark, d):
    from ..streaming.ingest import windowed

    out = windowed(table(spark, d, "events"), "1 day")
    return out.select("user", "item", F.col("start").cast("timestamp_ntz").cast("date").alias("day"), "n", S.quantised("label", 4).alias("label"))
