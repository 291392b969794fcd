"""Exact top-k search by inner product, through refined histograms of all scores.

Components become floor(256 * x), so scores are integers. Queries and candidates are laid out in blocks, and every
pair of blocks is scored whole. For each query a histogram of its scores over the interval that holds its kth
highest score is summed over all pairs; the bin with the kth score becomes the next interval, until few scores are
left from its lower edge up or it is one score wide. A last pass keeps the scores from the edge up and breaks ties by
id. A pair of blocks only reports its bins from the top down to its own kth score, and its own best k rows: what lies
lower cannot be among the k best overall. So each task sends a few numbers for a query, however many scores tie.

Vectors that are null, or hold a null or a component that is not finite, take no part; vectors of another length than
the query's are not compared with it. A query is no candidate for itself, by id: rows that repeat a query's id are not
its candidates either. Repeated candidate ids are each ranked, in the order of score and id. Each row that asks is a
query of its own, with k places of its own, also where rows repeat an id. Equal rows are scored once and counted: k
copies of a candidate are as good as all of them, and the result of a query is given once for each copy. So no block
grows with the copies of a row. An empty table gives no rows.

Scores are exact whatever the components: where 64 bits might not hold them, in Python's integers. A score beyond 64
bits counts as the nearest number of 64 bits, in ranking as in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

QUERY_BLOCK, ROW_BLOCK = 512, 4096
BINS = 256
#: A query whose scores from the edge up are at most this many times k is not refined further.
ENOUGH = 16


def _lookup(values: dict[int, int]):
    """A column: the value for the row's vector length."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in (values or {0: 1}).items() for x in pair]), F.col("dim"))


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """dim, block, ids, copies and vectors in so many blocks for each length, by a hash of the row."""
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), _lookup(counts)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        vectors = table.column("v").combine_chunks().flatten()
        return pa.table(
            {
                "dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1),
                "ids": pa.array([np.array(table.column("vec_id"), "<i8").tobytes()], pa.binary()), "copies": pa.array([np.array(table.column("copies"), "<i8").tobytes()], pa.binary()),
                "vectors": pa.array([np.array(vectors, "<f8").tobytes()], pa.binary()),
            }
        )

    return keyed.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, copies binary, vectors binary")


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as Python's integers."""
    # a double of 2**53 or more is whole; 256 times it may be beyond the largest double
    return np.array([int(y) << 8 if abs(y) >= 2.0**53 else math.floor(256 * y) for y in x.ravel().tolist()], object).reshape(x.shape)


def _exact(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Products of wide vectors."""
    q, r = _whole(q), _whole(r)
    return np.array([[min(max(y, -(2**63)), 2**63 - 1) for y in (r * p).sum(axis=1).tolist()] for p in q], np.int64).reshape(len(q), len(r))


def _scores(queries: bytes, rows: bytes, dim: int) -> np.ndarray:
    q, r = (np.frombuffer(x, "<f8").reshape(-1, dim) for x in (queries, rows))
    with np.errstate(over="ignore"):
        a, b = (np.abs(x).max(axis=1) * 256 + 1 for x in (q, r))
    limit = math.sqrt(2**53 / dim)  # below it, products and their sums are exact in doubles
    plain_q, plain_r = a < limit, b < limit
    inner = (np.floor(256 * q[plain_q]) @ np.floor(256 * r[plain_r]).T).astype(np.int64)
    if len(inner) == len(q) and plain_r.all():
        return inner
    out = np.empty((len(q), len(r)), np.int64)
    out[np.ix_(plain_q, plain_r)] = inner
    out[~plain_q] = _exact(q[~plain_q], r)
    out[np.ix_(plain_q, ~plain_r)] = _exact(q[plain_q], r[~plain_r])
    return out


def _pair(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    qids, rids, copies = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["copies"], "<i8")
    if row["dim"]:
        scores = _scores(row["queries"], row["vectors"], row["dim"])
    else:
        scores = np.zeros((len(qids), len(rids)), np.int64)
    return qids, rids, copies, scores


def _top(scores: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """The kth highest of the scores, or the least; each as often as it has copies."""
    best = np.argpartition(scores, len(scores) - k)[len(scores) - k :] if len(scores) > k else np.arange(len(scores))
    best = best[np.argsort(scores[best], kind="stable")[::-1]]
    return scores[best[min(int(np.searchsorted(np.cumsum(copies[best]), k)), len(best) - 1)]]


def search(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row that `is_query` marks."""
    space = Workspace(vectors.sparkSession)
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # -0.0 and 0.0 are one number
    rows = vectors.where(usable).select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"), is_query.alias("asks"))
    rows = rows.groupBy("vec_id", "v", "asks").agg(F.count("*").alias("copies")).withColumn("dim", F.size("v"))
    rows = space.written(rows, "distinct")
    # one row for each length that vectors have
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * 256 + 1, F.lit(2.0)))
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("m"), F.max(norm).alias("norm")).collect()
    count = lambda n, size: max(1, -(-n // size))
    row_blocks = {r.dim: count(r.n, ROW_BLOCK) for r in lengths}
    norms = {r.dim: math.sqrt(r.norm) for r in lengths}
    asking = _blocks(rows.where("asks").drop("asks"), {r.dim: count(r.m, QUERY_BLOCK) for r in lengths})
    asking = space.written(asking.select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("copies").alias("query_copies"), F.col("vectors").alias("queries")), "queries")
    there = space.written(_blocks(rows.drop("asks"), row_blocks), "rows")

    def pairs(edges: DataFrame) -> DataFrame:
        blocks = edges.join(asking, ["dim", "query_block"]).withColumn("block", F.explode(F.sequence(F.lit(0), _lookup(row_blocks) - 1)))
        return blocks.join(there, ["dim", "block"])

    #: Every query block with its edges: for each query the interval [low, low + width * BINS) of its kth score.
    edges = asking.select("dim", "query_block", F.lit(None).cast("binary").alias("low"), F.lit(None).cast("binary").alias("width"))
    state = None
    while True:
        bins = pairs(edges).mapInArrow(lambda b: _histograms(b, k, norms), "dim int, query_block int, place int, query_id bigint, width bigint, edge bigint, n bigint")
        counted = bins.groupBy("dim", "query_block", "place", "query_id", "width", "edge").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("dim", "query_block", "place").orderBy(F.desc("edge"))
        above = counted.withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("dim", "query_block", "place")))
        wanted = F.least(F.lit(k), F.col("all"))
        found = above.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
        found = found.select(
            "dim", "query_block", "place", "upto", "edge", "width",
            ((F.col("upto") <= ENOUGH * k) | (F.col("width") == 1)).alias("done"),
        )
        state = space.written(found if state is None else found.unionByName(state.where("done")), "edges")
        open_blocks = state.groupBy("dim", "query_block").agg(F.sort_array(F.collect_list(F.struct("place", "edge", "width", "done"))).alias("e"))
        packed = open_blocks.mapInArrow(_packed, "dim int, query_block int, low binary, width binary, open boolean")
        packed = space.written(packed, "packed")
        if packed.where("open").limit(1).count() == 0:
            break
        edges = packed.where("open").drop("open")
    key = ["dim", "query_block", "place"]
    best = pairs(packed.drop("open")).mapInArrow(lambda b: _filtered(b, k), "dim int, query_block int, place int, times bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = space.written(ranked.select("query_id", "rank", "vec_id", "score", "times"), "ranked")
    space.keep("ranked")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("query_id", "rank", "vec_id", "score")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            e = row["e"]
            low, width = np.full(e[-1]["place"] + 1, 2**62, "<i8"), np.zeros(e[-1]["place"] + 1, "<i8")  # width 0: nothing to refine
            for x in e:
                low[x["place"]], width[x["place"]] = x["edge"], 0 if x["done"] else x["width"]
            yield pa.RecordBatch.from_pydict(
                {"dim": pa.array([row["dim"]], pa.int32()), "query_block": pa.array([row["query_block"]], pa.int32()), "low": [low.tobytes()], "width": [width.tobytes()], "open": [bool((width > 0).any())]}
            )


def _histograms(batches: Iterator[pa.RecordBatch], k: int, norms: dict[int, float]) -> Iterator[pa.RecordBatch]:
    names = ["dim", "query_block", "place", "query_id", "width", "edge", "n"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            qids, rids, copies, scores = _pair(row)
            if row["low"] is None:
                # no score is beyond the product of the lengths; the same interval for all pairs
                with np.errstate(over="ignore"):
                    own = np.abs(np.frombuffer(row["queries"], "<f8").reshape(len(qids), -1)) * 256 + 1
                    reach = [min(int(min(x, 2.0**63)) + 2, 2**63 - 1) for x in (np.sqrt((own**2).sum(axis=1)) * norms[row["dim"]] * (1 + 1e-9)).tolist()]
                lows, widths = [-x - (x == 2**63 - 1) for x in reach], [-(-(2 * x + 2) // BINS) for x in reach]
            else:
                lows = np.frombuffer(row["low"], "<i8").tolist()
                widths = (-(-np.frombuffer(row["width"], "<i8") // BINS)).tolist()
            out: list[tuple] = []
            for p, q in enumerate(qids.tolist()):
                if p >= len(widths) or widths[p] == 0:
                    continue
                own = (rids != q) & (scores[p] >= lows[p])
                if not own.any():
                    continue
                s, c = scores[p][own], copies[own]
                near = s >= _top(s, c, k)
                s, c = s[near], np.minimum(c[near], k)
                # unsigned, as the difference may need all 64 bits
                which, place = np.unique((s.view(np.uint64) - np.uint64(lows[p] % 2**64)) // np.uint64(widths[p]), return_inverse=True)
                out += [(row["dim"], row["query_block"], p, q, widths[p], lows[p] + int(b) * widths[p], int(m)) for b, m in zip(which.tolist(), np.bincount(place, weights=c).tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _filtered(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["dim", "query_block", "place", "times", "query_id", "vec_id", "score"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            qids, rids, copies, scores = _pair(row)
            lows, times = np.frombuffer(row["low"], "<i8"), np.frombuffer(row["query_copies"], "<i8")
            parts = []
            for p, q in enumerate(qids.tolist()):
                if p >= len(lows):
                    continue
                own = np.flatnonzero((rids != q) & (scores[p] >= lows[p]))
                # this pair's own k best, each as often as it has copies
                own = own[np.lexsort((rids[own], ~scores[p][own]))[:k]]
                own = np.repeat(own, np.minimum(copies[own], k))[:k]
                parts.append((np.full(len(own), p), np.full(len(own), times[p]), np.full(len(own), q), rids[own], scores[p][own]))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["dim"]), pa.int32()), pa.array(np.full(n, row["query_block"]), pa.int32()), pa.array(columns[0], pa.int32()), *[pa.array(x, pa.int64()) for x in columns[1:]]], names=names
                )
