"""Approximate nearest vectors by an inverted file, its recall, and indexes kept by their corpus' signature.

Cells are unit vectors: those of least hash, moved to the means of a bounded sample. Every document is put into the list of
its nearest cell; a query looks into the lists of its `probes` nearest cells, where all documents are scored exactly, runs
of queries against blocks of documents. There are at most CELLS cells, so what every task is given is bounded;
a cell of many documents has many blocks. The sample serves the cells alone: every document is in the index.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.scalars import draw
from ..functions.vectors import unit
from .dense import DOC_BLOCK, best, k_best, plain, tiles
from .dense import search as exact_search

#: Cells, and documents that they are fitted on, at most.
CELLS, SAMPLE = 4096, 100_000
#: Products with cells that are held at once, and rows that are sent at once.
PRODUCTS, ROWS = 1 << 20, 4096


@dataclass
class Index:
    """Cells (unit vectors), and the lists: cell, dids, ds - ids and unit vectors of a block of documents."""

    cells: np.ndarray
    lists: DataFrame
    kind: str
    n: int


def _units(rows: DataFrame, key: str, name: str, vector: str = "vector") -> DataFrame:
    """key and unit vector v of the rows that have a vector of numbers which is not zero."""
    v = unit(vector)
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(whole & F.col(key).isNotNull()).select(F.col(key).alias(name), v.alias("v"))


def fit_cells(docs: DataFrame, cells: int, rounds: int = 4, sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """`docs` has doc_id and v. The cells start as the vectors of the least hashed ids; the sample is that of the least ones too."""
    rows = docs.orderBy(draw(seed, "doc_id"), "doc_id").limit(max(cells, sample if rounds else 0)).select("v").collect()
    x = np.array([r["v"] for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    c = x[:cells].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def nearest_cells(rows: DataFrame, key: str, cells: np.ndarray, probes: int) -> DataFrame:
    """key, v, cell and place: a row for each of the `probes` cells of the greatest products, of equal ones those of lesser
    number; place counts them from 1."""
    kind = rows.select(key, "v").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(PRODUCTS // max(1, len(cells)), ROWS // max(1, min(probes, len(cells)))))  # not all rows' cells at once
            for part in (batch.slice(low, step) for low in range(0, batch.num_rows, step)):
                n = part.num_rows
                x = np.array(part.column("v").flatten(), np.float64).reshape(n, -1)
                products = np.floor(x @ cells.T * 1e9 + 0.5)
                near = np.argsort(-products, axis=1, kind="stable")[:, :probes]
                out = part.take(pa.array(np.repeat(np.arange(n), near.shape[1])))
                yield pa.RecordBatch.from_arrays([out.column(key), out.column("v"), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), n))], names=[key, "v", "cell", "place"])

    return rows.select(key, "v").mapInArrow(run, kind.add("cell", IntegerType()).add("place", IntegerType()))


def _blocked(rows: DataFrame, key: str, size: int, names: tuple[str, str]) -> DataFrame:
    """cell and blocks of about `size` rows: ids and vectors. The counts are those of the cells, CELLS rows at most."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).alias("__blocks"))
    dealt = rows.join(F.broadcast(counts), "cell").withColumn("__block", F.pmod(F.xxhash64(key), F.col("__blocks")))
    packed = dealt.groupBy("cell", "__block").agg(F.collect_list(F.struct(F.col(key).alias("k"), "v")).alias("r"))
    return packed.select("cell", F.col("r.k").alias(names[0]), F.col("r.v").alias(names[1]))


def build(docs: DataFrame, cells: int | None = None, rounds: int = 4, seed: int = 0, vector: str = "vector") -> Index:
    """The index of documents (doc_id, vector); the square root of their number of cells unless told."""
    rows = _units(docs, "doc_id", "doc_id", vector)
    n = rows.count()
    cells = min(CELLS, cells or max(1, round(n**0.5)))
    centres = fit_cells(rows, cells, rounds, seed=seed)
    return Index(centres, _blocked(nearest_cells(rows, "doc_id", centres, 1), "doc_id", DOC_BLOCK, ("dids", "ds")), docs.schema["doc_id"].dataType.simpleString(), n)


def search(queries: DataFrame, index: Index, k: int, probes: int = 8, vector: str = "vector", exclude_self: bool = False) -> DataFrame:
    """qid, doc_id, score, rank: the k best by cosine in the lists of each query's nearest cells; ties to the lesser doc_id.

    Lists are dealt over tiles, and a query is sent once to each tile, not to each of its cells; there it meets the lists of its cells."""
    asked = _units(queries, "qid", "qid", vector)
    cells, kind = index.cells, queries.schema["qid"].dataType.simpleString()
    dim = cells.shape[1]
    nq, nd = tiles(asked.count() * dim, index.n * dim, index.n, queries.sparkSession.sparkContext.defaultParallelism)
    probes = min(probes, max(1, len(cells)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("db", every(nd))
    d = index.lists.withColumn("db", F.pmod(F.xxhash64("cell", F.element_at("dids", 1)), F.lit(nd)).cast("int")).withColumn("qb", every(nq))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, x = left.column("qid").combine_chunks(), np.array(left.column("v").combine_chunks().flatten(), np.float64).reshape(len(left), -1) if len(left) else np.zeros((0, dim))
        own, names, vectors = np.array(right.column("cell")), right.column("dids").combine_chunks(), right.column("ds").combine_chunks()
        asking, out = plain(qids), []
        step = max(1, PRODUCTS // max(1, len(cells)))
        for low in range(0, len(x), step):
            part = x[low : low + step]
            near = np.argsort(-np.floor(part @ cells.T * 1e9 + 0.5), axis=1, kind="stable")[:, :probes]
            asks = np.zeros((len(part), len(cells)), bool)
            np.put_along_axis(asks, near, True, axis=1)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for i in range(len(right)):
                some = np.flatnonzero(asks[:, own[i]])
                if len(some):
                    first = names.offsets[i].as_py() - names.offsets[0].as_py()
                    docs = np.array(vectors[i].values.flatten(), np.float64).reshape(-1, dim)
                    rows, cols, values = k_best(asking[low + some], (part[some], None), plain(names[i].values), (docs, None), k, False, exclude_self)
                    found.append((some[rows], cols + first, values))
                if sum(len(f[0]) for f in found) > PRODUCTS or i == len(right) - 1:  # the k best so far
                    rows, cols, values = (np.concatenate(f) for f in zip(*found, strict=True))
                    ids = plain(names.flatten().take(pa.array(cols)))
                    at = np.lexsort((ids, -values, rows))
                    rows, cols, values = rows[at], cols[at], values[at]
                    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                    found = [(rows[kept], cols[kept], values[kept])]
            out.append((found[0][0] + low, *found[0][1:]))
        rows, cols, values = (np.concatenate(f) for f in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"qid": qids.take(pa.array(rows)), "doc_id": names.flatten().take(pa.array(cols)), "score": pa.array(values, pa.float64())})

    return best(q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(run, f"qid {kind}, doc_id {index.kind}, score double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """qid, recall: the share of the exact hits of each query that were found."""
    hit = found.select("qid", "doc_id", F.lit(1).alias("hit"))
    return exact.select("qid", "doc_id").join(hit, ["qid", "doc_id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def tuned_probes(queries: DataFrame, index: Index, docs: DataFrame, k: int, target: float = 0.9, sample: int = 64, seed: int = 0, vector: str = "vector", exclude_self: bool = False) -> int:
    """The least number of probes that finds a share `target` of the exact k best, on average over at most `sample` queries of
    least hash: for each exact hit, the place of its document's cell among the query's cells."""
    some = queries.orderBy(draw(seed, "qid"), "qid").limit(sample)
    exact = exact_search(some, docs, k, "cosine", "qid", vector, exclude_self)
    places = nearest_cells(_units(some, "qid", "qid", vector), "qid", index.cells, len(index.cells)).select("qid", "cell", "place")
    where = index.lists.select("cell", F.explode("dids").alias("doc_id"))
    found = exact.select("qid", "doc_id").join(where, "doc_id").join(places, ["qid", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row for each cell
    total = sum(r["n"] for r in found)
    reached = 0
    for r in found:
        reached += r["n"]
        if reached >= target * total:
            return int(r["place"])
    return max(1, len(index.cells))


# --- indexes by signature -------------------------------------------------------------------------------------------
def signature(rows: DataFrame, *columns: str, settings: str = "") -> str:
    """A name of a table's rows, whatever their order and partitions, and of the settings of what is made of them: their number, and sum
    and exclusive or of two hashes of each. Only these few numbers leave the executors."""
    keyed = rows.select(F.xxhash64(F.lit(settings), *columns).alias("a"), F.xxhash64(*columns, F.lit(settings), F.lit(1)).alias("b"))
    got = keyed.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in ("a", "b") for n, f in (("x", F.bit_xor), ("s", lambda c: F.sum(F.col(c).cast("decimal(38,0)"))))]).first()
    parts = [str(got[c]) for c in ("n", "xa", "sa", "xb", "sb")]
    return rows.sparkSession.range(1).select(F.sha2(F.lit("|".join([settings, *parts])), 256)).first()[0]


class Shelf:
    """Tables and small notes kept in folders named by a signature, on any file system that Spark knows.

    `kept` gives what is there, or makes and writes it. A folder counts only once its note is written, which comes last; a
    folder older than `days` is made anew. Two makers of one signature write the same rows."""

    def __init__(self, spark: SparkSession, root: str, days: float | None = None):
        self.spark, self.root, self.days, self.made = spark, root.rstrip("/"), days, 0

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def note(self, name: str) -> dict | None:
        """The note of a folder that is whole and young enough."""
        path, fs = self._path(name, "note")
        if not fs.exists(path):
            return None
        note = json.loads(self.spark.read.text(f"{self.root}/{name}/note").first()[0])
        return note if self.days is None or time.time() - note["at"] < self.days * 86_400 else None

    def drop(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def kept(self, name: str, make: Callable[[], tuple[DataFrame, dict]]) -> tuple[DataFrame, dict]:
        note = self.note(name)
        if note is None:
            self.drop(name)
            table, more = make()
            table.write.parquet(f"{self.root}/{name}/table")
            note = {"at": time.time(), **more}
            self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.text(f"{self.root}/{name}/note")
            self.made += 1
        return self.spark.read.parquet(f"{self.root}/{name}/table"), note


def kept_index(shelf: Shelf, docs: DataFrame, name: str | None = None, cells: int | None = None, rounds: int = 4, seed: int = 0, vector: str = "vector") -> Index:
    """The index of documents from the shelf, built if it is not there. With a `name`, such as a table's version, documents that have
    an index are not read at all; without one they are read once, for their signature."""
    settings = f"{cells}|{rounds}|{seed}|{CELLS}|{SAMPLE}"
    name = signature(docs, "doc_id", vector, settings=settings) if name is None else f"{name}-{settings}".replace("|", "_")

    def make() -> tuple[DataFrame, dict]:
        made = build(docs, cells, rounds, seed, vector)
        return made.lists, {"cells": made.cells.tolist(), "kind": made.kind, "n": made.n}

    lists, note = shelf.kept(name, make)
    n = note["n"] if "n" in note else lists.agg(F.sum(F.size("dids"))).first()[0] or 0  # folders of before have none
    return Index(np.array(note["cells"], np.float64), lists, note["kind"], n)
