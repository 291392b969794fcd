"""SentencePiece encoding and decoding that keeps byte offsets.

Every text goes through the model's normaliser here: the compiled character map, a double-array trie of prefixes, is
walked from all characters at once, the longest match at each place the normaliser stops at is replaced, spaces become
marks, and each normalised byte records the original byte it came from. The merges are the sentencepiece library's; the
pieces, laid along the normalised bytes, are projected through that record to spans of original bytes. With an empty
map each byte is its own source, and only the marks are added. An alignment that does not come out at the end of the
normalised bytes (a piece outside the vocabulary) takes the library's own.

Null and empty texts give only the end id. Repeated rows, repeated ids and further columns need no care: the
operator works row by row. Very long texts are held whole, with some 40 bytes a byte beside them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

MARK = "▁"
_BYTE, _NORMAL, _USER = 6, 1, 4


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie of prefixes, and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64) if blob else np.zeros(0, np.int64)
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def matches(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest known prefix of raw[start:] for each start, and where its replacement begins."""
        lengths, found = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
        units = self.units
        own, at = np.arange(len(starts)), starts
        node = np.full(len(starts), self._down(units[:1])[0], np.int64)
        while len(own):
            byte = raw[at].astype(np.int64)
            node = node ^ byte
            inside = node < len(units)
            unit = units[np.where(inside, node, 0)]
            inside &= (unit & ((1 << 31) | 0xFF)) == byte
            own, at, node, unit = own[inside], at[inside] + 1, node[inside], unit[inside]
            node = node ^ self._down(unit)
            leaf = np.flatnonzero(unit >> 8 & 1)
            lengths[own[leaf]], found[own[leaf]] = at[leaf] - starts[own[leaf]], units[node[leaf]] & 0x7FFFFFFF
            on = at < len(raw)
            own, at, node = own[on], at[on], node[on]
        return lengths, found

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest known prefix of text[at:]; (0, b"") if none."""
        lengths, found = self.matches(np.frombuffer(text, np.uint8), np.array([at]))
        return (int(lengths[0]), self.replacement(int(found[0]))) if lengths[0] else (0, b"")

    @staticmethod
    def _down(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def replacement(self, at: int) -> bytes:
        return self.replacements[at : self.replacements.index(b"\0", at)]


class Model:
    """A SentencePiece model file: pieces, normaliser settings and the library's processor."""

    def __init__(self, path: str):
        import sentencepiece

        data = open(path, "rb").read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        settings: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b""))
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 3:
                settings = dict(_fields(value))
        self.map = CharacterMap(settings.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(settings.get(k, 1)) for k in (3, 4, 5))
        self.end_id = self.processor.eos_id()
        #: Normalised bytes of each piece; a byte piece stands for one.
        self.sizes = np.array([1 if k == _BYTE else len(p) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        self.decimals = [str(i) for i in range(len(self.pieces))]

    def _replaced(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Bytes after the character map, the original byte of each (that of a replacement is its match's first), and
        where the text begins after what becomes single spaces."""
        every = np.arange(len(raw))
        if not self.map:
            text = np.flatnonzero(raw != 0x20)
            return raw, every, int(text[0]) if len(text) else len(raw)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        lengths, found = self.map.matches(raw, starts)
        begin = 0
        for start, n, at in zip(starts.tolist(), lengths.tolist(), found.tolist(), strict=True):
            if start == begin and (self.map.replacement(at) if n else raw[start : start + 1].tobytes()) == b" ":
                begin += n or 1
            elif start >= begin:
                break
        values, sources, done = [], [], 0
        for i in np.flatnonzero(lengths).tolist():
            at = int(starts[i])
            if at < done:  # inside the match before
                continue
            new = self.map.replacement(int(found[i]))
            values += [raw[done:at], np.frombuffer(new, np.uint8)]
            sources += [every[done:at], np.full(len(new), at)]
            done = at + int(lengths[i])
        return np.concatenate([*values, raw[done:]]), np.concatenate([*sources, every[done:]]), begin

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the original byte offset of each of them and of the end."""
        raw = np.frombuffer(text.encode(), np.uint8)
        value, source, begin = self._replaced(raw)
        end = len(raw)
        space = value == 0x20
        if self.squeeze:  # one of several spaces, and none before the text
            keep = ~space
            keep[1:] |= ~space[:-1]
            inner = np.flatnonzero(~space)
            keep[: inner[0] if len(inner) else len(keep)] = False
            value, source, space = value[keep], source[keep], space[keep]
        if begin == len(raw) if self.squeeze else not len(raw):
            return b"", np.zeros(1, np.int64)
        mark = np.frombuffer(MARK.encode() if self.escape else b" ", np.uint8)
        sizes = np.where(space, len(mark), 1)
        at = np.cumsum(sizes) - sizes
        out, origin = np.empty(int(sizes.sum()), np.uint8), np.repeat(source, sizes)
        out[at[~space]] = value[~space]
        for i, byte in enumerate(mark.tolist()):
            out[at[space] + i] = byte
        if self.prefix:
            out, origin = np.concatenate([mark, out]), np.concatenate([np.full(len(mark), begin if self.squeeze else 0), origin])
        size = len(out)
        if self.squeeze:  # nor marks after it: the first of them is where the text ends
            while size >= len(mark) and (out[size - len(mark) : size] == mark).all():
                size -= len(mark)
                end = int(origin[size])
        return out[:size].tobytes(), np.append(origin[:size], end)

    def pieces_of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the original byte span of each piece."""
        ids = np.array(self.processor.encode(text), np.int64)
        if not len(ids):
            return ids, ids, ids
        normal, origin = self.normalize(text)
        ends = np.cumsum(self.sizes[ids])
        if ends[-1] != len(normal):
            proto = self.processor.encode(text, return_type="proto")
            return ids, np.array([p.begin for p in proto.pieces], np.int64), np.array([p.end for p in proto.pieces], np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return ids, origin[starts], origin[ends]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with the end id), starts and ends: original byte spans of the pieces (the end id has none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in slices(batches):
            rows = [m.pieces_of(t or "") for t in batch.column("text").to_pylist()]
            end = np.array([m.end_id])
            ids, starts, ends = ([end if i % 2 else r[0] for r in rows for i in (0, 1)], [r[1] for r in rows], [r[2] for r in rows])
            sizes = np.cumsum([0, *[len(r[0]) for r in rows]])
            lists = lambda parts, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids, sizes + np.arange(len(sizes))), lists(starts, sizes), lists(ends, sizes)], names=["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the ids with the end id, and n_bytes that the spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches):
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                ids, _, ends = m.pieces_of(text or "")
                every = [*ids.tolist(), m.end_id]
                out.append((len(every), sha(" ".join([m.decimals[i] for i in every])), sha(m.decode(every)), int(ends[-1]) if len(ends) else 0))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")
