"""Vectorised words, word hashes and winnowing over Arrow text columns.

Texts stay as one UTF-8 byte buffer with offsets: no Python string is made for each word. A word is a maximal run
of bytes that a 256-entry table marks. Its 64-bit hash goes through its bytes eight at a time, each step mixed with
the next (words longer than LONG bytes: keyed BLAKE2b). A span of words is hashed from the hashes of its first and its
last 2**k words, and those from halves in the same way. No step is linear in what came before, so no pattern of bytes
or words makes two texts collide. Hashes only say where to look: where equality decides, `word_digests` (BLAKE2b over
the words themselves) or the words are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes looked at together: bounds the working arrays whatever the length of a text.
CHUNK = 1 << 17
#: Bytes of text in one slice of a batch (one text at least).
SLICE = 1 << 20

#: Words of more bytes are hashed one by one.
LONG = 256
_SEED, _STEP, _JOIN = 0x243F6A8885A308D3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_KEY = b"words"
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _fold_table() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


LOWER = _fold_table()
#: Words of `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = texts(batch.column(batch.schema.get_field_index(name)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # first word of each text, and the number of words
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def last(self) -> np.ndarray:
        """For each word, the number of words up to the end of its text."""
        return np.repeat(self.first[1:], self.counts)


def tokenize(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: np.ndarray | None = None) -> Words:
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + CHUNK)
        while to < n and table[buf[to]]:  # up to the next byte outside a word, or the end of the text
            stop = min(n, to + 4096)
            out = np.flatnonzero(~table[buf[to:stop]])
            edge = offsets[np.searchsorted(offsets, to)]
            to = min(int(edge), to + int(out[0]) if len(out) else stop)
            if to == edge:
                break
        parts.append(_chunk(buf, offsets, table, fold, at, to))
        at = to
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts, ends, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Words(starts, ends, np.searchsorted(starts, offsets), hashes)


def _chunk(buf, offsets, table, fold, at, to):
    piece = buf[at:to]
    inside = table[piece]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
    if len(edges):
        opens[edges] = inside[edges]
        edges = edges[edges > 0]
        closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts + at, ends + at, word_hashes(piece if fold is None else fold[piece], starts, ends)


def word_hashes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word."""
    sizes = ends - starts
    padded = np.zeros(len(piece) + 8, np.uint8)
    padded[: len(piece)] = piece
    eights = np.ndarray((len(piece) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(sizes.astype(np.uint64) ^ U(_SEED))
    out = mix((out ^ (eights[starts] & _MASKS[np.minimum(sizes, 8)])) * U(_STEP))
    rest = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    done = 8
    while len(rest):
        left = sizes[rest] - done
        out[rest] = mix((out[rest] ^ (eights[starts[rest] + done] & _MASKS[np.minimum(left, 8)])) * U(_STEP))
        done += 8
        rest = rest[left > 8]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(piece[starts[i] : ends[i]], digest_size=8, key=_KEY).digest(), "little")
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(_JOIN) + b)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; positions less than k from the end are left out."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    whole, n = hashes, 1
    while 2 * n <= k:
        whole, n = _joined(whole[:-n], whole[n:]), 2 * n
    return mix(_joined(whole[: len(hashes) - k + 1], whole[k - n :]) + U(k))


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of hashes[starts:ends], for many spans: as `grams` where these have one length."""
    sizes = ends - starts
    out = np.zeros(len(sizes), np.uint64)
    whole, n, longest = hashes, 1, int(sizes.max(initial=0))
    while n <= longest:
        own = np.flatnonzero((sizes >= n) & (sizes < 2 * n))
        if len(own):
            out[own] = mix(_joined(whole[starts[own]], whole[ends[own] - n]) + sizes[own].astype(np.uint64))
        if 2 * n <= longest:
            whole = _joined(whole[:-n], whole[n:])
        n *= 2
    return out


def packed(buf: np.ndarray, table: np.ndarray, words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words alone, each with a space after it, and where each begins and ends (before its space)."""
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1)
    inside = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    inside[ends - 1] = False
    out = np.full(len(inside), 32, np.uint8)
    out[inside] = buf[table[buf]]
    return out.tobytes(), ends - sizes - 1, ends - 1


def word_digests(text: bytes, starts: np.ndarray, ends: np.ndarray, size: int = 16) -> list[bytes]:
    """`size` bytes of BLAKE2b over each part of what `packed` gives."""
    blake, view = hashlib.blake2b, memoryview(text)
    return [blake(view[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each i, the leftmost position of the least of values[i : i + w]."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    val, idx, width = values, np.arange(len(values)), 1
    while width < w:
        step = min(width, w - width)
        a, b = val[:-step] if step else val, val[step:]
        left = a <= b
        val, idx = np.where(left, a, b), np.where(left, idx[:-step], idx[step:])
        width += step
    return idx[:n]


def runs(sorted_positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal neighbours."""
    if not len(sorted_positions):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_positions[1:] != sorted_positions[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_positions)))
