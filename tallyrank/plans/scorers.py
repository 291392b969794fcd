"""Search scorers for the experiment runner: each indexes documents (doc_id, text) and scores queries (qid, text).

Encoders need weights that are not here: dense and late-interaction scorers take vectors from a table, or else from
hashed terms, which stand in for an encoder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..functions.vectors import unit
from ..operators import bm25, dense
from ..sources.readers import plain_name


def hashed_vectors(docs: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """key and vector: the signed hashed counts of a text's terms, normalised. Terms that share a place add up."""
    counts = bm25.term_counts(docs, key).withColumn("at", F.pmod(F.xxhash64("term"), F.lit(dim)).cast("int"))
    sign = F.when(F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cells = counts.groupBy(key, "at").agg(F.sum(sign * F.log1p("tf")).alias("x"))
    held = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    return held.select(key, unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))).alias("vector"))


def hashed_tokens(docs: DataFrame, key: str, dim: int = 16, longest: int = 180, augment: int = 0) -> DataFrame:
    """key and vector: one hashed unit vector for each of a text's first `longest` words (punctuation has none); a query
    shorter than `augment` is filled up with the vector of a mask."""
    words = F.slice(tokens("text"), 1, longest)
    words = F.concat(words, F.array_repeat(F.lit("[MASK]"), F.greatest(F.lit(augment) - F.size(words), F.lit(0)))) if augment else words
    one = lambda w: unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(w, i), F.lit(2001)) / 1000.0) - 1.0))
    return docs.select(key, F.transform(words, one).alias("vector")).where(F.size("vector") > 0)


class Scorer:
    """`index` once, then `full` for the best of all documents or `candidates` for given rows (qid, doc_id)."""

    #: The score of a candidate that the index does not know.
    unknown = 0.0

    def __init__(self, **params: object):
        self.params = params

    def take(self, name: str, default):
        return self.params.get(name, default)

    def index(self, docs: DataFrame) -> object:
        raise NotImplementedError

    def full(self, index: object, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError

    def candidates(self, index: object, queries: DataFrame, rows: DataFrame) -> DataFrame:
        raise NotImplementedError


SCORERS: dict[str, type[Scorer]] = {}


def register_scorer(*names: str) -> Callable[[type[Scorer]], type[Scorer]]:
    def add(kind: type[Scorer]) -> type[Scorer]:
        for name in names:
            SCORERS[plain_name(name)] = kind
        return kind

    return add


@register_scorer("bm25", "BM25Model")
class Bm25(Scorer):
    """With stems and without stop words unless told otherwise."""

    def _how(self) -> dict:
        return {"stop_words": STOP_WORDS if self.take("stop_words", True) else None, "stems": bool(self.take("stemmer", True))}

    def index(self, docs):
        self.docs = docs
        return bm25.build(docs, **self._how())

    def full(self, index, queries, k):
        return bm25.search(index, self.docs, queries, k, k1=float(self.take("k1", bm25.K1)), b=float(self.take("b", bm25.B)), **self._how())

    def candidates(self, index, queries, rows):
        return bm25.candidates(bm25.scores(index, queries, k1=float(self.take("k1", bm25.K1)), b=float(self.take("b", bm25.B)), **self._how()), rows, int(self.take("cutoff", 1000)))


@register_scorer("spladeknn", "SpladeKnnModel", "sparse")
class Sparse(Scorer):
    unknown = -10.0

    def index(self, docs):
        return dense.sparse_weights(bm25.term_counts(docs, "doc_id"), "doc_id")

    def _scores(self, index, queries):
        return dense.sparse_scores(dense.sparse_weights(bm25.term_counts(queries, "qid"), "qid"), index)

    def full(self, index, queries, k):
        return dense.best(self._scores(index, queries), k)

    def candidates(self, index, queries, rows):
        known = index.select("doc_id").distinct().withColumn("__known", F.lit(True))
        met = rows.join(self._scores(index, queries), ["qid", "doc_id"], "left").join(known, "doc_id", "left")
        return met.withColumn("score", F.when(F.col("__known").isNull(), F.lit(self.unknown)).otherwise(F.coalesce("score", F.lit(0.0)))).drop("__known")


@register_scorer("dense", "DenseRetrieverModel", "BiEncoderSearchModel", "biencoder")
class Dense(Scorer):
    """Vectors of the `vectors` parameter (a DataFrame of id and vector), else hashed terms."""

    unknown = -10.0
    score = "cosine"

    def _vectors(self, docs, key, query=False):
        given = self.take("vectors", None)
        if given is None:
            return hashed_vectors(docs, key, int(self.take("dim", 64)))
        return docs.select(key).distinct().join(given.select(F.col("id").alias(key), "vector"), key)

    def index(self, docs):
        return self._vectors(docs, "doc_id")

    def full(self, index, queries, k):
        asked = queries if "vector" in queries.columns else self._vectors(queries, "qid", True)
        return dense.search(asked, index, k, self.score)

    def candidates(self, index, queries, rows):
        asked = queries if "vector" in queries.columns else self._vectors(queries, "qid", True)
        found = dense.rerank(rows.select("qid", "doc_id"), asked, index, self.unknown, self.score)
        return rows.join(found, ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(self.unknown)))


@register_scorer("colbert", "ColBERTModel", "lateinteraction")
class LateInteraction(Dense):
    """Sums of the best match of each query word."""

    unknown = 0.0
    score = "max_sim"

    def _vectors(self, docs, key, query=False):
        return hashed_tokens(docs, key, int(self.take("dim", 16)), int(self.take("query_max_length", 32) if query else self.take("doc_max_length", 180)), int(self.take("query_max_length", 32)) if query and self.take("augment", False) else 0)
