"""Late interaction with token masks, and over packed residual codes.

Token tables: a query is a marker, its words, and padding up to a fixed length, all of which take part; a document is a marker and its
words and signs up to a length, of which signs are masked: they take up places, but match nothing.

Packed codes: a token vector is the number of its nearest centroid and, for each component, in which bucket what is left over falls,
four two-bit buckets in a byte. The score of a query token with a coded one is the product with the centroid plus, for each byte,
an entry of a table of the query token's products with the 256 combinations of bucket means. So vectors are never rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import Name, col
from .dense import DOC_BLOCK, QUERY_BLOCK, assign_centroids, best

QUERY_MARK, DOCUMENT_MARK, PAD = "[Q]", "[D]", "[MASK]"
QUERY_LENGTH, DOCUMENT_LENGTH = 32, 180
PIECE = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SIGN = r"^[^\s\p{L}\p{N}]$"


def pieces(text: Name) -> Column:
    """Words in lower case and single signs, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(PIECE), F.lit(0))


def query_tokens(text: Name, length: int = QUERY_LENGTH) -> Column:
    """`length` tokens: the marker, as many pieces as fit, and padding, which takes part in the match."""
    own = F.slice(F.concat(F.array(F.lit(QUERY_MARK)), pieces(text)), 1, length)
    return F.concat(own, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(own)))


def document_tokens(text: Name, most: int = DOCUMENT_LENGTH, signs: bool = False) -> Column:
    """(token, keep) of at most `most` tokens: the marker and pieces; signs are kept only if told."""
    own = F.slice(F.concat(F.array(F.lit(DOCUMENT_MARK)), pieces(text)), 1, most)
    return F.transform(own, lambda t: F.struct(t.alias("token"), (F.lit(signs) | (t == DOCUMENT_MARK) | ~t.rlike(SIGN)).alias("keep")))


def unmasked(vectors: Name, keep: Name) -> Column:
    """The token vectors that take part, of vectors and a mask of the same length; all where there is no mask."""
    both = F.arrays_zip(col(vectors).alias("v"), col(keep).alias("k"))
    return F.when(col(keep).isNull(), col(vectors)).otherwise(F.transform(F.filter(both, lambda z: z["k"]), lambda z: z["v"]))


# --- packed codes ---------------------------------------------------------------------------------------------------
@dataclass
class Book:
    """A model of fixed size: centroids, and for each component the edges between its buckets and the buckets' means."""

    centroids: list[list[float]]
    edges: list[list[float]]
    means: list[list[float]]

    @property
    def dim(self) -> int:
        return len(self.centroids[0])

    def table(self, queries: np.ndarray) -> np.ndarray:
        """(byte place, query token, 256): products with the bucket means of the byte's four components."""
        places = -(-self.dim // 4)
        means, q = np.zeros((places * 4, 4)), np.zeros((len(queries), places * 4))
        means[: self.dim, : len(self.means[0])], q[:, : self.dim] = np.array(self.means), queries
        byte = np.arange(256)
        out = np.zeros((places, len(q), 256))
        for p in range(places):
            for j in range(4):
                out[p] += q[:, 4 * p + j, None] * means[4 * p + j][byte >> 2 * j & 3]
        return out


def encoded(tokens: DataFrame, book: Book, vector: str = "vector") -> DataFrame:
    """Adds code and packed: the nearest centroid, and the residual's buckets, four to a byte, the first in the lowest bits."""
    rows = assign_centroids(tokens, book.centroids, vector)
    edges = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in book.edges])
    buckets = F.transform("residual", lambda x, i: F.size(F.filter(F.element_at(edges, i + 1), lambda e: e < x)))
    at = lambda i: F.coalesce(F.try_element_at(F.col("__b"), i + 1), F.lit(0))
    byte = lambda p: at(4 * p) + 4 * at(4 * p + 1) + 16 * at(4 * p + 2) + 64 * at(4 * p + 3)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(-(-book.dim // 4) - 1)), lambda p: F.lpad(F.hex(byte(p)), 2, "0")), "")
    return rows.withColumn("__b", buckets).withColumn("packed", F.unhex(text)).drop("__b", "residual")


def _scored(book: Book, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = np.array(book.centroids)
        width = -(-book.dim // 4)
        for batch in batches:
            for i in range(batch.num_rows):
                one = {n: batch.column(j).slice(i, 1).flatten() for j, n in enumerate(batch.schema.names)}
                q_at = np.array(one["qs"].offsets) - one["qs"].offsets[0].as_py()
                queries = np.array(one["qs"].flatten().flatten(), np.float64).reshape(-1, book.dim)
                d_at = np.array(one["codes"].offsets) - one["codes"].offsets[0].as_py()
                codes = np.array(one["codes"].flatten())
                packed = np.frombuffer(b"".join(one["packs"].flatten().to_pylist()), np.uint8).reshape(-1, width)
                near, tables = queries @ centroids.T, book.table(queries)
                scores = near[:, codes]
                for p in range(width):
                    scores += tables[p][:, packed[:, p]]
                sums = np.add.reduceat(np.maximum(np.maximum.reduceat(scores, d_at[:-1], axis=1), 0.0), q_at[:-1], axis=0)
                sums = np.floor(sums * 1e6 + 0.5) / 1e6  # as functions.scalars.quantised
                ids = one["dids"]
                order = np.argsort(np.argsort(np.array(ids.to_pylist()), kind="stable"), kind="stable")
                at = [np.lexsort((order, -row))[:k] for row in sums]
                which = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [one["qids"].take(pa.array(np.repeat(np.arange(len(at)), [len(a) for a in at]))), ids.take(pa.array(which)), pa.array(np.concatenate([row[a] for row, a in zip(sums, at, strict=True)]))],
                    names=["qid", "doc_id", "score"],
                )

    return run


def packed_search(queries: DataFrame, coded: DataFrame, book: Book, k: int) -> DataFrame:
    """qid, doc_id, score, rank: for each query (qid, vector: token vectors) the k documents of the greatest sums of best matches,
    from `coded` rows (doc_id, place, code, packed), one for each token that takes part. Blocks meet blocks."""
    documents = coded.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "code", "packed"))).alias("t"))  # a document's tokens, DOCUMENT_LENGTH at most
    block = lambda df, key, size: F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // size)))).cast("int")
    d = documents.select(block(documents, "doc_id", DOC_BLOCK).alias("db"), "doc_id", F.col("t.code").alias("c"), F.col("t.packed").alias("p"))
    d = d.groupBy("db").agg(F.collect_list(F.struct("doc_id", "c", "p")).alias("r")).select(F.col("r.doc_id").alias("dids"), F.col("r.c").alias("codes"), F.col("r.p").alias("packs"))
    some = queries.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select("qid", F.transform("vector", lambda t: t.cast("array<double>")).alias("v"))
    q = some.withColumn("qb", block(some, "qid", QUERY_BLOCK // 8)).groupBy("qb").agg(F.collect_list(F.struct("qid", "v")).alias("r")).select("qb", F.col("r.qid").alias("qids"), F.col("r.v").alias("qs"))
    blocks = q.agg(F.max("qb")).first()[0]
    met = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks or 0)))).join(q, "qb").select("qids", "qs", "dids", "codes", "packs")
    kinds = [queries.schema["qid"].dataType.simpleString(), coded.schema["doc_id"].dataType.simpleString()]
    return best(met.mapInArrow(_scored(book, k), f"qid {kinds[0]}, doc_id {kinds[1]}, score double"), k)
