"""The registered queries of this subpackage: each applies its operator to the whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, change_points, decontaminate, exact_topk, language, licenses, neardup, quality, quality_rules, sampling, sentence_pieces, substrings, token_files, toxicity
from .common import held_out, table

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
END_ID = 2
QUALITY_THRESHOLD, TOXICITY_THRESHOLD = 0.3, 0.7


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Ranking:
    """Fitted on labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label"))
    return quality.fitted(table(spark, sf_dir, "documents"), labels.where("label in (0, 1)"), QUALITY_THRESHOLD)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir), keep_text=False)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col(quality.SCORE).alias("score"), (F.col(quality.SCORE) >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)).select("doc_id", F.col("toxic").alias("label"))
    found, counts = sampling.labelled(table(spark, sf_dir, "documents"), labels.where("label in (0, 1)"), toxicity.SAMPLE)
    return toxicity.train(found.get(1, []), found.get(0, []), counts.get(1, 0) / max(1, sum(counts.values())), TOXICITY_THRESHOLD)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir), keep_text=False)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col(toxicity.SCORE).alias("score"), (F.col(toxicity.SCORE) >= TOXICITY_THRESHOLD).cast("int").alias("predicted"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = docs.where(~held_out("doc_id", 4, 2)).select("doc_id", F.col("lang").alias("label"))
    found, _ = sampling.labelled(docs, labels, language.SAMPLE)
    predicted = language.identify(docs, language.train(found))
    return predicted.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op12_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "sale_lines").where(F.col("flag").isin("kept", "swapped"))
    return change_points.segments(taken, "vendor_id", "shipped_at", "quantity")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
wins AS (SELECT doc_id, s, md5(array_to_string(t[s : s + 49], ' ')) AS h FROM (SELECT doc_id, t, unnest(range(1, len(t) - 48)) AS s FROM w WHERE len(t) >= 50)),
firsts AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM wins JOIN firsts USING (h) WHERE d < doc_id),
places AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM places x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(t) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH b AS (SELECT item_id, t, least(10, len(t)) AS n FROM (SELECT item_id, {_ALNUM} AS t FROM benchmark) WHERE len(t) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(t[s : s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS s FROM b)),
d AS (SELECT doc_id, {_ALNUM} AS t FROM documents),
dw AS (SELECT doc_id, n, s, array_to_string(t[s : s + n - 1], ' ') AS g FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(t) >= n)),
hits AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN iw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, len(t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: Keys are cost * 100000 + segments; `keys` and `starts` grow by a day at a time.
OP12_SQL = """
WITH RECURSIVE taken AS (
  SELECT vendor_id, (shipped_at::DATE - DATE '1970-01-01')::BIGINT AS day, sum(quantity)::BIGINT AS q
  FROM sale_lines WHERE flag IN ('kept', 'swapped') AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2
),
ends AS (SELECT vendor_id, row_number() OVER () AS v, min(day) AS d0, max(day) - min(day) + 1 AS n FROM taken GROUP BY 1),
filled AS (
  SELECT e.v, e.i, coalesce(t.q, 0) AS q FROM (SELECT *, unnest(range(0, n)) AS i FROM ends) e
  LEFT JOIN taken t ON t.vendor_id IS NOT DISTINCT FROM e.vendor_id AND t.day = e.d0 + e.i
),
sums AS (
  SELECT v, i + 1 AS j, (sum(q) OVER w)::BIGINT AS s, (sum(q * q) OVER w)::BIGINT AS ss FROM filled WINDOW w AS (PARTITION BY v ORDER BY i)
  UNION ALL SELECT v, 0, 0, 0 FROM ends
),
spreads AS (
  SELECT a.v, a.j AS i, b.j AS j, b.j - a.j AS m, b.s - a.s AS total, 1 + ((b.j - a.j) * (b.ss - a.ss) - (b.s - a.s) * (b.s - a.s)) // ((b.j - a.j) * (b.j - a.j)) AS spread
  FROM sums a JOIN sums b ON a.v = b.v AND b.j >= a.j + 5
  UNION ALL SELECT e.v, 0, n, n, s, 1 + (n * ss - s * s) // (n * n) FROM ends e JOIN sums b ON e.v = b.v AND b.j = n WHERE n < 5
),
costs AS (SELECT *, m * floor(1000 * ln(spread::DOUBLE))::BIGINT AS cost FROM spreads),
offers AS (SELECT v, j, list((cost + CASE WHEN i > 0 THEN 10000 ELSE 0 END) * 100000 + 1 ORDER BY i) AS c FROM costs WHERE m >= 5 GROUP BY 1, 2),
best(v, j, keys, starts) AS (
  SELECT v, 4::BIGINT, [0, 1152921504606846976, 1152921504606846976, 1152921504606846976, 1152921504606846976]::BIGINT[], [0, 0, 0, 0, 0]::BIGINT[] FROM ends WHERE n >= 5
  UNION ALL
  SELECT v, j, list_append(keys, list_min(o)), list_append(starts, list_position(o, list_min(o)) - 1) FROM (
    SELECT b.v, b.j + 1 AS j, keys, starts, list_transform(list_zip(keys[1 : b.j - 3], f.c), lambda z: z[1] + z[2]) AS o FROM best b JOIN offers f ON f.v = b.v AND f.j = b.j + 1
  )
),
cuts(v, a, b, starts) AS (
  SELECT e.v, CASE WHEN n < 5 THEN 0 ELSE starts[n + 1] END, n, starts FROM ends e LEFT JOIN best b ON e.v = b.v AND b.j = n WHERE n < 5 OR b.v IS NOT NULL
  UNION ALL SELECT v, starts[a + 1], a, starts FROM cuts WHERE a > 0
),
parts AS (SELECT c.v, c.a, m, total, spread, cost FROM cuts c JOIN costs x ON x.v = c.v AND x.i = c.a AND x.j = c.b)
SELECT vendor_id, (row_number() OVER (PARTITION BY v ORDER BY a))::INTEGER AS segment_no, d0 + a AS first_day, m AS n_days, total, spread, cost,
  count(*) OVER (PARTITION BY v) AS n_segments, (sum(cost) OVER (PARTITION BY v))::BIGINT + 10000 * (count(*) OVER (PARTITION BY v) - 1) AS best_cost
FROM parts JOIN ends USING (v)
"""


def _op13_sql() -> str:
    """Lloyd's rounds written out, each with all centroids."""
    steps = []
    for r in range(centroids.ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT rid, c.k, v.x, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{r} c),
a{r} AS MATERIALIZED (SELECT rid, x, k, distance FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, k) AS place FROM d{r}) WHERE place = 1)""")
        if r < centroids.ROUNDS:
            steps.append(f"""s{r} AS (SELECT k, p, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{r}) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT k, list((s - (s % n + n) % n) // n ORDER BY p) AS x FROM s{r} GROUP BY 1) m ON m.k = c.k)""")
    last = centroids.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: floor({centroids.SCALE} * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {centroids.DIM} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y::DOUBLE))) = 0
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x FROM (SELECT sha256('{centroids.SALT}:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {centroids.CENTROIDS})),
{", ".join(steps)},
names AS (SELECT k, sha256(list_aggregate(list_transform(x, lambda y: y::VARCHAR), 'string_agg', ',')) AS centroid_sha256 FROM c{last})
SELECT vec_id, a.k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{last} a JOIN v USING (rid) JOIN names ON names.k = a.k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality, op2_toxicity, op3_near_duplicates, op4_language, op5_token_files, op6_license_scan, op7_repeated_passages, op8_decontaminate, op9_sentence_pieces, op10_exact_topk,
        op11_quality_rules, op12_change_points, op13_centroid_clusters,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": licenses.scan_sql(), "op7_repeated_passages": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_exact_topk": OP10_SQL, "op12_change_points": OP12_SQL, "op13_centroid_clusters": _op13_sql()}
