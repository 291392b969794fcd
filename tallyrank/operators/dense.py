"""Dense, learned-sparse and late-interaction retrieval. Vectors are input columns: encoders are outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scalars import quantised
from ..functions.vectors import cosine, dot, max_sim, unit

#: Queries and documents in one block of an index.
QUERY_BLOCK, DOC_BLOCK = 256, 2048
#: Numbers in one tile, of queries or documents: each tile of queries meets each of documents once. Documents that a tile has at least,
#: where there could be fewer tiles than cores.
TILE, LEAST = 1 << 22, 2048
#: Queries, documents and token vectors that are multiplied at once.
QUERY_PART, DOC_PART, TOKEN_PART = 256, 4096, 1024
#: Vectors in one block and keys in one bucket when histories are averaged.
VECTOR_BLOCK, KEY_BLOCK = 1 << 16, 1 << 14
#: Pairs of blocks are spread over at least so many keys, each with at most so many blocks of documents.
SPREAD, DOC_BLOCKS = 64, 16


def met_blocks(d: DataFrame, q: DataFrame, n_docs: int, n_queries: int) -> DataFrame:
    """Each block of documents (numbered db) with each block of queries (qb).

    Queries are copied to several keys, so that few blocks of queries do not bring all documents to few tasks; none is broadcast."""
    spread = min(n_docs, max(-(-SPREAD // n_queries), -(-n_docs // DOC_BLOCKS)))
    left = d.withColumn("part", F.pmod("db", F.lit(spread))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    return left.join(q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).hint("shuffle_hash"), ["qb", "part"])


def _vectors(column: pa.ChunkedArray, deep: bool, normalise: bool) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of rows, and for token vectors where each row's begin."""
    rows = column.combine_chunks()
    starts = np.array(rows.offsets) - rows.offsets[0].as_py() if deep else np.arange(len(rows) + 1)
    vectors = rows.flatten() if deep else rows
    flat = np.array(vectors.flatten(), np.float64)
    found = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
    if normalise and len(found):
        size = np.sqrt(np.cumsum(found * found, axis=1)[:, -1:])  # added in the order of functions.vectors.unit
        found = np.divide(found, size, out=found, where=size > 0)
    return found, starts


def _parts(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about TOKEN_PART token vectors, or of one row."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + TOKEN_PART, side="right")) - 1)
        yield low, high
        low = high


def _late(q: np.ndarray, q_at: np.ndarray, d: np.ndarray, d_at: np.ndarray) -> np.ndarray:
    """The best document token for each query token, at least 0; their sum. Never all tokens with all tokens at once; query tokens
    of the same vector are multiplied once."""
    own, of = np.unique(q, axis=0, return_inverse=True)
    of, best = of.ravel(), np.zeros((len(d_at) - 1, len(own)))
    for x, y in _parts(d_at):
        for low in range(0, len(own), TOKEN_PART):
            products = d[d_at[x] : d_at[y]] @ own[low : low + TOKEN_PART].T
            for i in range(x, y):  # row by row, which is faster than reduceat along this axis
                products[d_at[i] - d_at[x] : d_at[i + 1] - d_at[x]].max(axis=0, out=best[i, low : low + TOKEN_PART])
    best = np.maximum(best.T, 0.0, order="C")
    scores = np.empty((len(q_at) - 1, len(d_at) - 1))
    for a in range(len(q_at) - 1):
        scores[a] = best[of[q_at[a] : q_at[a + 1]]].sum(axis=0)
    return scores


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6  # as functions.scalars.quantised


def _chosen(parts: Iterator[tuple[int, np.ndarray]], n: int, k: int, order: np.ndarray, same: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of n queries and of their k best documents, and the scores, from parts (first document, scores); ties by `order`. `same` are
    places of queries and documents that do not meet."""
    rows, cols, values, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, -np.inf)
    for low, scores in parts:
        m = scores.shape[1]
        here = (same[1] >= low) & (same[1] < low + m)
        scores[same[0][here], same[1][here] - low] = -np.inf
        if m > k and np.isneginf(least).any():
            least = np.maximum(least, _rounded(np.partition(scores, m - k, axis=1)[:, m - k]))
        r, c = np.nonzero((scores >= (least - 1e-6)[:, None]) & (scores > -np.inf))
        rows, cols, values = np.r_[rows, r], np.r_[cols, c + low], np.r_[values, _rounded(scores[r, c])]
        at = np.lexsort((order[cols], -values, rows))
        rows, cols, values = rows[at], cols[at], values[at]
        begins = np.searchsorted(rows, np.arange(n + 1))
        kept = np.arange(len(rows)) - begins[rows] < k
        full = np.flatnonzero(np.diff(begins) >= k)
        least[full] = np.maximum(least[full], values[begins[full] + k - 1])
        rows, cols, values = rows[kept], cols[kept], values[kept]
    return rows, cols, values


def plain(ids: pa.Array) -> np.ndarray:
    return np.array(ids.to_pylist(), object) if pa.types.is_string(ids.type) else np.array(ids)


def k_best(asking: np.ndarray, q: tuple[np.ndarray, np.ndarray], names: np.ndarray, d: tuple[np.ndarray, np.ndarray], k: int, deep: bool = False, exclude_self: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their k best documents, and the scores, never with all scores at once. `asking` and `names` are ids."""
    (q, q_at), (d, d_at) = q, d
    sorted_at = np.argsort(names, kind="stable")
    order = np.empty(len(names), np.int64)
    order[sorted_at] = np.arange(len(names))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(asking), QUERY_PART):
        b = min(a + QUERY_PART, len(asking))
        same = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if exclude_self:
            first, last = (np.searchsorted(names, asking[a:b], side, sorter=sorted_at) for side in ("left", "right"))
            same = np.repeat(np.arange(b - a), last - first), sorted_at[np.concatenate([np.arange(x, y) for x, y in zip(first, last, strict=True)]).astype(np.int64)]

        def parts(a: int = a, b: int = b) -> Iterator[tuple[int, np.ndarray]]:
            step = max(1, DOC_PART // 8) if deep else DOC_PART
            for x in range(0, len(names), step):
                y = min(x + step, len(names))
                yield x, _late(q[q_at[a] : q_at[b]], q_at[a : b + 1] - q_at[a], d[d_at[x] : d_at[y]], d_at[x : y + 1] - d_at[x]) if deep else q[a:b] @ d[x:y].T

        rows, cols, values = _chosen(parts(), b - a, k, order, same)
        out.append((rows + a, cols, values))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def tiles(numbers_q: int, numbers_d: int, n_docs: int, cores: int) -> tuple[int, int]:
    """How many tiles of queries and of documents there are."""
    nq = max(1, -(-numbers_q // TILE))
    return nq, max(1, -(-numbers_d // TILE), min(-(-2 * cores // nq), n_docs // LEAST))


def search(queries: DataFrame, docs: DataFrame, k: int, score: str = "cosine", qid: str = "qid", vector: str = "vector", exclude_self: bool = False, most: int | None = None) -> DataFrame:
    """The k best documents of each query: exact scores of all rows, quantised; ties to the lesser doc_id.

    Tiles of queries meet tiles of documents, and each pair of tiles sends on its own k best for each query. A task holds one tile of
    each and some of the scores; a vector is sent as it is, once to each tile of the other side. Vectors are normalised there
    when `score` is cosine; `max_sim` takes arrays of token vectors. All vectors have one length; rows without a vector take no part. With `most`, a bound of a row's
    numbers, tiles are cut by the numbers of rows, so that vectors are not made once more to be counted."""
    deep = score == "max_sim"
    # rows without a vector are left out where they arrive: a condition on it, pushed down, would make every vector twice
    asked, there = queries.select(F.col(qid).alias("k"), F.col(vector).alias("v")), docs.select(F.col("doc_id").alias("k"), F.col(vector).alias("v"))
    numbers = F.aggregate("v", F.lit(0).cast("bigint"), lambda n, t: n + F.size(t)) if deep else F.size("v").cast("bigint")
    numbers = F.greatest(F.lit(0), F.coalesce(numbers, F.lit(0))) if most is None else F.lit(most).cast("bigint")
    sized = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(numbers), F.lit(0)).alias("s")).first()
    of_queries, of_docs = sized(asked), sized(there)
    nq, nd = tiles(of_queries["s"], of_docs["s"], of_docs["n"], docs.sparkSession.sparkContext.defaultParallelism)
    tile = lambda df, n, own, m, other: df.withColumn(own, F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    kinds = [queries.schema[qid].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (t.filter(pc.greater(pc.list_value_length(t.column("v")), 0)) for t in (left, right))
        (qids, q), (dids, d) = ((t.column("k").combine_chunks(), _vectors(t.column("v"), deep, score == "cosine")) for t in (left, right))
        rows, cols, values = k_best(plain(qids), q, plain(dids), d, k, deep, exclude_self)
        return pa.table({"qid": qids.take(pa.array(rows)), "doc_id": dids.take(pa.array(cols)), "score": pa.array(values, pa.float64())})

    pairs = tile(asked, nq, "qb", nd, "db").groupBy("qb", "db").cogroup(tile(there, nd, "db", nq, "qb").groupBy("qb", "db"))
    return best(pairs.applyInArrow(run, f"qid {kinds[0]}, doc_id {kinds[1]}, score double"), k)


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(rows: DataFrame, queries: DataFrame, docs: DataFrame, unknown: float = -10.0, score: str = "cosine") -> DataFrame:
    """Scores of given (qid, doc_id) rows; `unknown` for a document without a vector."""
    met = rows.join(queries.select("qid", F.col("vector").alias("qv")), "qid").join(docs.select("doc_id", F.col("vector").alias("dv")), "doc_id", "left")
    value: Column = {"cosine": cosine, "dot": dot, "max_sim": max_sim}[score]("qv", "dv")
    return met.select("qid", "doc_id", F.when(F.col("dv").isNull(), F.lit(unknown)).otherwise(quantised(value)).alias("score"))


def _summed_vectors(key: str) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Each key's sums and counts by component over the vectors of one block that its items have."""

    def run(group: tuple, histories: pa.Table, vectors: pa.Table) -> pa.Table:
        names, listed = vectors.column("item").combine_chunks(), vectors.column("v").combine_chunks()
        lengths = np.diff(np.array(listed.offsets))
        width = int(lengths.max()) if len(lengths) else 0
        there = np.arange(width) < lengths[:, None]
        matrix, filled = np.zeros(there.shape), np.zeros(there.shape, bool)
        flat = listed.flatten()
        matrix[there], filled[there] = np.array(flat.fill_null(0.0), np.float64), np.array(flat.is_valid())
        # one row for each id, as a join sums repeated ids
        ids = names.dictionary_encode()
        code, n = np.array(ids.indices), len(ids.dictionary)
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(n))
        sums, counts = (np.add.reduceat(x[order], first, axis=0) if n else x for x in (matrix, filled.astype(np.int32)))
        at = pc.index_in(histories.column("item").combine_chunks(), value_set=ids.dictionary)
        kept = np.flatnonzero(np.array(at.is_valid()))
        asking = histories.column(key).combine_chunks().take(pa.array(kept)).dictionary_encode()
        who, of = np.array(asking.indices), np.array(at.take(pa.array(kept)), np.int64)
        order = np.argsort(who, kind="stable")
        who, of = who[order], of[order]
        edges, out = np.searchsorted(who, np.arange(len(asking.dictionary) + 1)), []
        for low in range(0, len(asking.dictionary), 1024):  # not all items' vectors at once
            high = min(low + 1024, len(asking.dictionary))
            mine, begins = of[edges[low] : edges[high]], edges[low:high] - edges[low]
            out.append([np.add.reduceat(x[mine], begins, axis=0) for x in (sums, counts)])
        total, n_of = (np.concatenate([o[j] for o in out]) if out else np.zeros((0, width)) for j in (0, 1))
        offsets = pa.array(np.arange(len(total) + 1) * width, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), t)) for x, t in ((total, pa.float64()), (n_of.astype(np.int32), pa.int32()))]
        return pa.table([asking.dictionary, *lists], names=[key, "s", "n"])

    return run


def centroid(histories: DataFrame, vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """The mean of the normalised vectors of a history's known items; zeros if none is known.

    Buckets of keys meet blocks of vectors, and each sends on one sum for each key: no vector is copied to a row of a history."""
    known = vectors.select("item", unit("vector").cast("array<double>").alias("v")).where("v is not null")
    n_vectors, n_keys = max(1, -(-known.count() // VECTOR_BLOCK)), max(1, -(-histories.select(key).distinct().count() // KEY_BLOCK))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = histories.select(key, "item").where(F.col("item").isNotNull() & F.col(key).isNotNull()).withColumn("kb", number(key, n_keys)).withColumn("vb", number("item", n_vectors))
    right = known.withColumn("vb", number("item", n_vectors)).withColumn("kb", F.explode(F.sequence(F.lit(0), F.lit(n_keys - 1))))
    schema = StructType([histories.schema[key], StructField("s", ArrayType(DoubleType())), StructField("n", ArrayType(IntegerType()))])
    summed = left.groupBy("kb", "vb").cogroup(right.groupBy("kb", "vb")).applyInArrow(_summed_vectors(key), schema)
    added = lambda c, t: F.aggregate(F.collect_list(c), F.array().cast(f"array<{t}>"), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast(t)) + F.coalesce(y, F.lit(0).cast(t))))
    both = summed.groupBy(key).agg(added("s", "double").alias("s"), added("n", "int").alias("n"))
    listed = both.select(key, F.filter(F.zip_with("s", "n", lambda s, n: F.when(n > 0, quantised(s / n))), lambda x: x.isNotNull()).alias("vector"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return histories.select(key).distinct().join(listed, key, "left").withColumn("vector", F.coalesce("vector", zeros))


def as_hits(scored: DataFrame, text: DataFrame) -> DataFrame:
    """Hit lists as one row for each query: its hits' texts and scores in order of rank."""
    joined = scored.join(text.select("doc_id", "text"), "doc_id")
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col("text").alias("doc_text"), "score")))
    return joined.groupBy("qid").agg(F.transform(ordered, lambda s: F.struct(s["doc_text"].alias("doc_text"), s["score"].alias("score"))).alias("hits"))


def sparse_weights(counts: DataFrame, key: str) -> DataFrame:
    """key, term, weight: log(1 + tf), normalised by each row's L2 norm. Stands in for a learned sparse encoder."""
    raw = counts.select(key, "term", F.log1p(F.col("tf").cast("double")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.when(norm > 0, F.col("w") / norm).otherwise(0.0)).drop("w")


def sparse_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, doc_id, score: dot products of sparse vectors, met by term."""
    met = queries.select("qid", "term", F.col("weight").alias("qw")).join(docs.select("doc_id", "term", "weight"), "term")
    return met.groupBy("qid", "doc_id").agg(quantised(F.sum(F.col("qw") * F.col("weight"))).alias("score"))


def assign_centroids(tokens: DataFrame, centroids: list[list[float]], vector: str = "vector") -> DataFrame:
    """Each token's centroid of the greatest dot product (the first of equals), and what is left after it.

    Centroids are a fixed number of vectors (a model), so they are literals of the plan."""
    book = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    products = F.transform(book, lambda c: quantised(dot(vector, c), 9))
    code = (F.array_position(products, F.array_max(products)) - 1).cast("int")
    out = tokens.withColumn("code", code)
    return out.withColumn("residual", F.zip_with(F.col(vector), F.element_at(book, F.col("code") + 1), lambda x, c: x.cast("double") - c))


def residual_buckets(assigned: DataFrame, bits: int = 2) -> tuple[DataFrame, list[list[float]], list[list[float]]]:
    """Residual components as bucket numbers between quantiles of their dimension, the edges, and each bucket's mean."""
    n = 2**bits
    long = assigned.select(F.posexplode("residual").alias("at", "x"))
    shares = [i / n for i in range(1, n)]
    edges = [list(r["e"]) for r in long.groupBy("at").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("e")).orderBy("at").collect()]  # one row for each dimension
    book = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in edges])
    number = lambda x, i: F.size(F.filter(F.element_at(book, i + 1), lambda e: e < x)).cast("tinyint")
    coded = assigned.withColumn("buckets", F.transform("residual", number))
    pairs = coded.select(F.posexplode(F.arrays_zip("residual", "buckets")).alias("at", "z")).groupBy("at", "z.buckets").agg(F.avg("z.residual").alias("mean"))
    means = [[0.0] * n for _ in edges]
    for r in pairs.collect():  # dimensions times buckets
        means[r["at"]][r["buckets"]] = r["mean"]
    return coded, edges, means


def reconstructed(coded: DataFrame, centroids: list[list[float]], means: list[list[float]]) -> DataFrame:
    """Vectors rebuilt from a centroid and the bucket means."""
    book = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    table = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in means])
    left = F.transform("buckets", lambda b, i: F.element_at(F.element_at(table, i + 1), b.cast("int") + 1))
    return coded.withColumn("rebuilt", F.zip_with(left, F.element_at(book, F.col("code") + 1), lambda r, c: r + c))


def fit_centroids(tokens: DataFrame, k: int, sample: int = 300_000, seed: int = 0, vector: str = "vector") -> list[list[float]]:
    """k-means centres of at most `sample` tokens, those of the least hashes: the same ones on any partitions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = tokens.orderBy(F.xxhash64(F.lit(seed), *tokens.columns)).limit(sample)
    model = KMeans(k=k, seed=seed, featuresCol="f", maxIter=10).fit(rows.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("f")))
    return [list(map(float, c)) for c in model.clusterCenters()]
