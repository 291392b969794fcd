"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds documents in ascending id order: the ids of all documents, one after the other in 2 bytes each (4 when
the vocabulary needs them), then the document ids, then the boundaries (number of token ids before each document) in
Elias-Fano form. For n boundaries up to u, the low floor(log2(u / n)) bits of each are stored as they are, and the
high parts in unary; every 64th one of the unary bits is sampled, so select(i) reads one short run of bits.
That is about 2 + log2(u / n) bits a document, where a plain table takes 64. Readers get offsets by select alone: one at
a time, or those of documents next to each other from the sample before the first to the sample after the last.

Layout (little-endian): magic, token ids, document ids (int64), low bits, high bits, select samples (int64), trailer
of nine int64 (documents, of which without id, tokens, id width, low bits, sizes of the four later sections), magic.

A task starts a new file when one has FILE_BYTES of ids or FILE_DOCS documents, so what a writer or a reader holds is
bounded, and many readers share a large table. Tasks write under a name of their own and rename, so a task that runs
again leaves the same files. A null text is empty; a null doc_id comes first, as Spark sorts; equal doc_ids keep the
order of their texts' hashes. Repeated rows are written as often as they come. The end id follows each document, so no
document is empty.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_folder
from .words import slices

MAGIC = b"EFIDS002"
SAMPLE = 64
#: Words remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 600_000
#: Ids read at once.
BLOCK = 1 << 20
#: Documents whose offsets are read at once.
RUN = 1 << 12
#: Bytes of token ids and documents from which on a file is full.
FILE_BYTES, FILE_DOCS = 64 << 20, 1 << 20
#: Letters of a text that are encoded at once, about.
CHUNK = 1 << 19
#: Bytes of text that are encoded together: words that come again in them are looked up once.
BYTES = 8 << 20


class EliasFano:
    """A non-decreasing list of n integers, at most u."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, n = values.astype(np.int64), len(values)
        u = int(values[-1]) + 1 if n else 1
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        parts = np.empty(n * bits, np.uint8)
        for j in range(bits):
            parts[j::bits] = values >> j & 1
        low = np.packbits(parts, bitorder="little")
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.int64))

    def select(self, i: int) -> int:
        """The i-th value, from the sampled one before it."""
        at = int(self.samples[i // SAMPLE])
        left, place = i % SAMPLE, at
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while True:
            ones = word.bit_count()
            if left < ones:
                for _ in range(left):
                    word &= word - 1
                place = byte * 8 + (word & -word).bit_length() - 1
                break
            left -= ones
            byte += 1
            word = int(self.high[byte])
        first, value = i * self.bits, 0
        for j in range(self.bits):
            value |= (int(self.low[(first + j) >> 3]) >> ((first + j) & 7) & 1) << j
        return (place - i) << self.bits | value

    def range(self, first: int, last: int) -> np.ndarray:
        """The values from the first-th up to the one before the last-th: selects that share their run of bits."""
        if first >= last:
            return np.zeros(0, np.int64)
        sample, after = first // SAMPLE, (last - 1) // SAMPLE + 1
        at = int(self.samples[sample]) >> 3
        stop = (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at:stop], bitorder="little")) + at * 8
        ones = ones[np.searchsorted(ones, int(self.samples[sample])) :][first - sample * SAMPLE : last - sample * SAMPLE]
        begin, end = first * self.bits, last * self.bits
        bits = np.unpackbits(self.low[begin >> 3 : (end + 7) >> 3], bitorder="little")[begin & 7 :][: end - begin]
        low = (bits.reshape(last - first, self.bits).astype(np.int64) << np.arange(self.bits)).sum(axis=1)
        return (ones - np.arange(first, last)) << self.bits | low


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", ""))


class Writer:
    def __init__(self, uri: str, wide: bool):
        self.store, self.path = open_store(uri)
        self.kind = "<u4" if wide else "<u2"
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.docs = self.bytes = self.nameless = 0
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temporary)
        self.out.write(MAGIC)

    def write(self, doc_ids: pa.Array, sizes: np.ndarray, tokens: np.ndarray) -> None:
        """Documents in ascending order, those without an id first."""
        self.ids.append(np.array(doc_ids.fill_null(0), "<i8"))
        self.nameless += doc_ids.null_count
        self.sizes.append(sizes.astype(np.int64))
        data = tokens.astype(self.kind).tobytes()
        self.docs, self.bytes = self.docs + len(sizes), self.bytes + len(data)
        self.out.write(data)

    @property
    def full(self) -> bool:
        return self.bytes >= FILE_BYTES or self.docs >= FILE_DOCS

    def close(self) -> tuple[int, int]:
        ends = np.cumsum(np.concatenate(self.sizes))
        total = int(ends[-1])
        code = EliasFano.of(np.concatenate([[0], ends])[: len(ends)])
        parts = [np.concatenate(self.ids).tobytes(), code.low.tobytes(), code.high.tobytes(), code.samples.astype("<i8").tobytes()]
        for part in parts:
            self.out.write(part)
        self.out.write(np.array([self.docs, self.nameless, total, int(self.kind[-1]), code.bits, *map(len, parts)], "<i8").tobytes() + MAGIC)
        self.out.close()
        self.store.move(self.temporary, self.path)
        return self.docs, total


class Reader:
    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 80)
        tail = self.file.read(80)
        if tail[72:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.n, self.nameless, self.total, self.width, bits, *sizes = np.frombuffer(tail, "<i8", 9).tolist()
        self.file.seek(size - 80 - sum(sizes))
        parts = [self.file.read(x) for x in sizes]
        self.doc_ids = np.frombuffer(parts[0], "<i8")
        self.bounds = EliasFano(self.n, bits, np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], np.uint8), np.frombuffer(parts[3], "<i8"))

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where the documents from first to last - 1 begin, and where the last of them ends."""
        out = self.bounds.range(first, min(last + 1, self.n))
        return out if last < self.n else np.append(out, self.total)

    def tokens(self, start: int, end: int) -> np.ndarray:
        self.file.seek(8 + start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """One document's ids, found through two selects."""
        return self.tokens(self.bounds.select(i), self.bounds.select(i + 1) if i + 1 < self.n else self.total)


class _Words(dict):
    """Ids of words; those of `rest`, which are not kept, where a word is not among them."""

    rest: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.rest[word]


class WordEncoder:
    """The library's ids for whole texts, as little-endian unsigned 32-bit integers.

    No match of the tokenizer's pattern has white space in it and its normaliser works on each side of a space alone,
    so a text goes by the pieces between spaces or line feeds. All pieces go through the whole tokenizer, those met for
    the first time many at once. Pieces of letters, and such with one sign at their end, are joined by spaces: the
    vocabulary marks the last token of each match, and if there are as many matches as such pieces must have at least,
    each has its own. All others are joined by the special end token, which the library takes out before anything
    else. Short pieces are remembered, in bounded memory.
    """

    SHORT = 14
    MARK, LAST = "<|endoftext|>", "</w>"
    #: Pieces in one text for the library.
    TOGETHER = 200
    SIGNS = frozenset(".,;:!?")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Words()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.LAST)]] = True
        self.mark = self.tokenizer.token_to_id(self.MARK)
        if self.mark is not None and self._ids([f"a{self.MARK}b"])[0][len(self._ids(["a"])[0]) :][:1] != [self.mark]:
            self.mark = None

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str], matches: int) -> tuple[dict[str, bytes], list[str]]:
        """Ids of words that have so many matches at least, and the words that may have more."""
        out, others = {}, []
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != matches * len(group) or (len(ends) and ends[-1] != len(ids)):
                others += group
                continue
            data, at = ids.tobytes(), (ends[matches - 1 :: matches] * 4).tolist()
            out |= {w: data[x:y] for w, x, y in zip(group, [0, *at[:-1]], at, strict=True)}
        return out, others

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        plain, closed, others = [], [], []
        for w in words:
            (plain if w.isalpha() else closed if w[-1:] in self.SIGNS and w[:-1].isalpha() else others).append(w)
        out, more = self._spaced(plain, 1)
        others += more
        found, more = self._spaced(closed, 2)
        out |= found
        others += more
        together = [w for w in others if "<" not in w] if self.mark is not None else []
        alone = [w for w in others if "<" in w or self.mark is None]
        out |= {w: np.array(x, "<u4").tobytes() for w, x in zip(alone, self._ids(alone), strict=True)}
        if together:
            ids = np.array(self._ids([self.MARK.join(together)])[0], "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)) * 4
            data = ids.tobytes()
            out |= {w: data[a:b] for w, a, b in zip(together, [0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*pieces)
        # difference() would go over all that is known, as it is no plain dict
        learned = self._learn(set(filterfalse(self.known.__contains__, words)))
        short = {w: x for w, x in learned.items() if len(w) <= self.SHORT}
        known = self.known
        if len(known) + len(short) > REMEMBERED:  # the memory starts anew, from the words of these texts
            self.known = _Words((w, known[w]) for w in words if w in known)
            known = self.known
            known.update(short)
        else:
            known.update(short)
        known.rest = {w: x for w, x in learned.items() if len(w) > self.SHORT}
        out = [b"".join(map(known.__getitem__, p)) for p in pieces]
        known.rest = {}
        return out

    def whole(self, text: str) -> bytes:
        """One text of any length, in parts that end at a space."""
        out, at = [], 0
        while at < len(text):
            to = text.find(" ", at + CHUNK)
            to = len(text) if to < 0 else to
            out += self.encode([text[at:to]])
            at = to
        return b"".join(out)

    def batch(self, texts: list[str]) -> list[bytes]:
        return self.encode(texts) if sum(map(len, texts)) <= 16 * CHUNK else list(map(self.whole, texts))


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """One for each worker process: the tasks that it runs one after the other read the tokenizer and learn words once."""
    return WordEncoder(path)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, wide: bool = False) -> DataFrame:
    """Writes files for each range of doc_id and returns their list: part, file, uri, n_docs, n_tokens."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        out, made, end = None, 0, np.array([end_id], "<u4").tobytes()

        def done() -> pa.RecordBatch:
            n, total = out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([made], pa.int32()), "uri": [uri], "n_docs": [n], "n_tokens": [total]})

        for batch in slices(batches, limit=BYTES):
            codes = [c + end for c in encoder.batch([t or "" for t in batch.column("text").to_pylist()])]
            if out is None:
                uri = f"{folder}/{part:06d}-{made:04d}.efids"
                out = Writer(uri, wide)
            out.write(batch.column("doc_id"), np.array([len(c) // 4 for c in codes]), np.frombuffer(b"".join(codes), "<u4"))
            if out.full:
                yield done()
                out, made = None, made + 1
        if out is not None:
            yield done()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return (
        ordered.repartitionByRange(partitions(spark), "doc_id", "text_hash")
        .sortWithinPartitions("doc_id", "text_hash")
        .select("doc_id", "text")
        .mapInArrow(run, "part int, file int, uri string, n_docs bigint, n_tokens bigint")
    )


def read(spark, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from (uri, ids in the files before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = Reader(uri)
                for first in range(0, file.n, RUN):
                    last = min(file.n, first + RUN)
                    bounds, at = file.offsets(first, last), 0
                    while at < last - first:
                        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1)
                        tokens = file.tokens(int(bounds[at]), int(bounds[to])).astype("<u4")
                        own = bounds[at : to + 1] - bounds[at]
                        crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                        ids = pa.array(file.doc_ids[first + at : first + to], mask=np.arange(first + at, first + to) < file.nameless)
                        yield pa.RecordBatch.from_pydict({"doc_id": ids, "start": pa.array(bounds[at:to] + base), "n_tokens": pa.array(np.diff(own)), "ids_crc32": pa.array(crcs, pa.int64())})
                        at = to

    listed = spark.createDataFrame(files, "uri string, base bigint").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes all documents and reads the files back. The driver holds one row for each file, no more."""
    files, base = [], 0
    for row in sorted(write(docs, tokenizer, end_id).collect(), key=lambda r: (r.part, r.file)):
        files.append((row.uri, base))
        base += row.n_tokens
    return read(docs.sparkSession, files)
