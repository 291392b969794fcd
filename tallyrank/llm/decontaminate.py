"""Benchmark decontamination by winnowing.

Of each text's hashed k-grams, the least one in every window of w is kept (k + w - 1 = n words): two texts that share n
words in a row keep one fingerprint in them, at the same place. So each window of n words has a fingerprint, and equal
windows have equal ones. Fingerprints of documents are joined with those of benchmark items; a hit is extended to the
window around it by 128 bits of BLAKE2b over its words, a part of the same join. Items of fewer than n words are one
window of their own length, found in the same way with n set to it.

Both sides stay distributed. Only a filter of BITS bits goes to every task, its size fixed whatever the benchmark's: a
document's fingerprint whose bit no item has set is not sent to the join. What passes wrongly, the join drops. The rows
of windows that very many documents have are dealt over several partitions. Documents are not shuffled, only their
candidate windows, and one number each. The items of one window, and of one document, are held as one list.

Null and empty texts have no words; an item without words has no window. Windows of an item whose item_id is null count
as hits; only the number and the list of items leave it out. Repeated rows each get the same result. Items are told
apart by their ids as strings. Only doc_id, text, item_id are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, spread_join
from .words import ALNUM, LOWER, Words, grams, mix, packed, slices, sliding_argmin, texts, tokenize, word_digests

WINDOW = 10
GRAM = 5
#: Bits of the filter; 32,768 of them make a row of Spark's bitmaps.
BITS = 1 << 24
_ROW = 1 << 15
U = np.uint64
_LAST = 2**63 - 1


def windows(words: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint (the least of its k-grams) of each window of n words."""
    total = len(words.hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = grams(words.hashes, k)
    starts = np.flatnonzero(np.arange(total) + n <= words.last[:total])
    return starts, mix(values[sliding_argmin(values, n - k + 1)[starts]] + U(n))


def _windows_of(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Length, text number, first word, fingerprint and digest of the windows of items."""
    buf, offsets = texts(batch.column("text"))
    words = tokenize(buf, offsets, ALNUM, LOWER)
    text, begins, ends = packed(LOWER[buf], ALNUM, words)
    row_of = np.repeat(np.arange(batch.num_rows), words.counts)
    for size in np.unique(np.minimum(words.counts, n)).tolist():
        if size:
            starts, prints = windows(words, size, min(GRAM, size))
            own = words.counts[row_of[starts]] >= n if size == n else words.counts[row_of[starts]] == size
            starts, prints = starts[own], prints[own]
            yield size, row_of[starts], starts, prints, word_digests(text, begins[starts], ends[starts + size - 1])


def _item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """n, print, window and item of every window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for size, row, _, prints, digests in _windows_of(batch, n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), size), pa.int32()), pa.array(prints.view(np.int64)), pa.array(digests, pa.binary()), batch.column("item").take(pa.array(row))], names=["n", "print", "window", "item"]
                )

    rows = benchmark.where("text is not null").select("text", F.col("item_id").cast("string").alias("item"))
    return rows.mapInArrow(run, "n int, print bigint, window binary, item string")


def _filter(known: DataFrame) -> np.ndarray:
    """Bytes of a bit for each fingerprint modulo BITS."""
    bit = F.pmod("print", F.lit(BITS)) + 1
    rows = known.select(F.bitmap_bucket_number(bit).alias("row"), F.bitmap_bit_position(bit).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.collect():  # BITS / _ROW rows at most
        at = (r["row"] - 1) * _ROW // 8
        out[at : at + _ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _scanned(docs: DataFrame, sizes: list[int], bits) -> DataFrame:
    """doc_id, id, hash, n_words, and those windows of every document that the filter lets through."""
    kind = pa.struct([("n", pa.int32()), ("print", pa.int64()), ("start", pa.int32()), ("window", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offsets = texts(batch.column("text"))
            words = tokenize(buf, offsets, ALNUM, LOWER)
            parts = []
            for size in sizes:
                starts, prints = windows(words, size, min(GRAM, size))
                place = (prints % U(BITS)).astype(np.int64)
                own = np.flatnonzero(bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                parts.append((np.full(len(own), size), starts[own], prints[own]))
            n, starts, prints = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            order = np.argsort(starts, kind="stable")
            n, starts, prints = n[order], starts[order], prints[order].astype(np.uint64)
            digests = []
            if len(n):
                text, begins, ends = packed(LOWER[buf], ALNUM, words)
                digests = word_digests(text, begins[starts], ends[starts + n - 1])
            base = words.first[np.searchsorted(words.first, starts, "right") - 1]
            found = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(prints.view(np.int64)), pa.array(starts - base, pa.int32()), pa.array(digests, pa.binary())], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, words.first), pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "id", "hash")], pa.array(words.counts), lists], names=["doc_id", "id", "hash", "n_words", "found"])

    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, id bigint, hash bigint, n_words bigint, found array<struct<n:int,print:bigint,start:int,window:binary>>")


def _hits(space: Workspace, docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(scanned documents, window hits): id, hash, start, n and items of each window that an item has too."""
    items = space.written(_item_windows(benchmark, n), "items")
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # n at most
    bits = docs.sparkSession.sparkContext.broadcast(_filter(items))
    scanned = space.written(_scanned(docs, sizes, bits), "scanned")
    found = scanned.select("id", "hash", F.explode("found").alias("f")).select("id", "hash", "f.*")
    key = ["n", "print", "window"]
    asked = found.groupBy(*key).agg(F.count("*").alias("times"))
    known = items.groupBy(*key).agg(F.collect_set("item").alias("items"))
    return scanned, spread_join(found, space.written(known.join(asked, key), "known"), key, "times", "id")


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, cleaned: bool = False) -> DataFrame:
    """For each document its words, the words inside windows of benchmark items, and the items with such windows.
    With `cleaned`, instead all columns of the documents that no window was found in."""
    space = Workspace(docs.sparkSession)
    scanned, hits = _hits(space, docs, benchmark, WINDOW)
    if cleaned:
        hit = space.written(hits.select("id", "hash").distinct(), "hit")
        space.keep("hit")
        i, h = fresh(docs, "id", "hash")
        marked = docs.withColumn(i, F.coalesce("doc_id", F.lit(_LAST))).withColumn(h, F.xxhash64("text"))
        return marked.join(hit.select(F.col("id").alias(i), F.col("hash").alias(h)), [i, h], "left_anti").select(*docs.columns)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    told = hits.groupBy("id", "hash").agg(spans.alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    nothing = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("words"))

    def covered(a, s):
        return F.struct(F.greatest(a.upto, s.end).alias("upto"), (a.words + F.greatest(s.end - F.greatest(a.upto, s.start), F.lit(0))).alias("words"))

    told = told.select("id", "hash", F.aggregate("spans", nothing, covered).words.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    told = space.written(told, "told")
    space.keep("scanned", "told")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("items", F.array().cast("array<string>"))
    return scanned.drop("found").join(told, ["id", "hash"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
