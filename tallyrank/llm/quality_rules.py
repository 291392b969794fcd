"""Quality rules over whole texts: counts of words, symbols, repeated lines and windows, and bands of compression ratios.

Repetitive text compresses far better than prose, and noise (encoded data, keys, random letters) far worse. Each text is
compressed by zstandard whole, and in CHUNKs of fixed size, each by itself. A ratio is compressed over plain bytes. The
limits depend on the length, as a short text has little to refer back to and the frame's own bytes weigh on it: see
`BANDS`. The whole text must lie in its band, and of its bytes no more than STRAY may lie in chunks outside theirs,
so that a long document is not passed for its good part. A chunk is cut at a byte, wherever that falls.

Words are runs of bytes outside white space, unchanged. A line is a duplicate if an earlier line of its text is the same,
byte for byte, and has a word. A window is WINDOW words in a row; words in windows that come twice or more in their text
are repeated words, those of the first occurrence too. Hashes choose the windows and lines that may be equal; BLAKE2b of
the windows' words and the lines themselves decide.

Null and empty texts have no words and fail the base rule; they have no ratio. Repeated rows are judged alike. Very long
texts are compressed as a stream of the library, with the memory of one text. Only doc_id and text are read, so
other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from .words import SPACED, U, Words, grams, mix, packed, slices, texts, tokenize

WINDOW = 8
#: Base rule: at least so many words, and at most so many per cent of them in repeated windows.
LEAST_WORDS, REPEATED_PERCENT = 20, 30
LEVEL, CHUNK = 3, 4096
#: (bytes below which the band holds, least ratio, greatest ratio). Prose of alphabets and syllabaries has 0.6 to 1 at 200 bytes,
#: 0.45 to 0.65 at 2,000 and 0.3 to 0.5 beyond; a text of lines or words said over and over falls below a third
#: of that, random letters of base 64 stay at 0.75 or more. The limits keep a wide margin to prose on both sides.
BANDS = ((128, 0.0, 2.0), (256, 0.34, 1.05), (512, 0.30, 0.92), (1024, 0.27, 0.82), (2048, 0.25, 0.76), (4096, 0.23, 0.73), (1 << 14, 0.21, 0.71), (1 << 62, 0.18, 0.70))
#: Share of the bytes that may lie in chunks outside their band.
STRAY = 0.3

_EDGES, _LOW, _HIGH = (np.array(x) for x in zip(*BANDS, strict=True))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COLUMNS = {**dict.fromkeys(MEASURES, LongType()), "base_failed": BooleanType(), "ratio": DoubleType(), "stray": DoubleType(), "kept": BooleanType()}


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marked bytes of each text."""
    at = np.flatnonzero(mask)
    return np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])


def _again(keys: np.ndarray) -> np.ndarray:
    """Places whose key comes more than once, in order."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    several = np.zeros(len(keys), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    return np.flatnonzero(several)


def duplicate_lines(buf: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """For each text, the lines with a word that equal an earlier one."""
    lines = tokenize(buf, offsets, _LINE)
    out = np.zeros(len(offsets) - 1, np.int64)
    worded = np.flatnonzero(np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts))
    text_of = np.repeat(np.arange(len(out)), lines.counts)[worded]
    raw, seen, now = memoryview(buf), set(), -1
    for i in _again(mix(lines.hashes[worded] ^ mix(text_of.astype(np.uint64)))).tolist():
        if text_of[i] != now:
            now, seen = text_of[i], set()
        line = bytes(raw[lines.starts[worded[i]] : lines.ends[worded[i]]])
        out[now] += line in seen
        seen.add(line)
    return out


def repeated_words(buf: np.ndarray, words: Words) -> np.ndarray:
    """For each text, the words in windows that come twice or more in it."""
    n = len(words.first) - 1
    hashes = grams(words.hashes, WINDOW)
    text_of = np.repeat(np.arange(n), words.counts)
    whole = np.flatnonzero(words.first[text_of[: len(hashes)] + 1] >= np.arange(len(hashes)) + WINDOW)
    several = whole[_again(mix(hashes[whole] ^ mix(text_of[whole].astype(np.uint64))))]
    if not len(several):
        return np.zeros(n, np.int64)
    text, begins, ends = packed(buf, SPACED, words)
    found: dict[tuple[int, bytes], int] = {}
    twice = []
    view = memoryview(text)
    for i, a, b, of in zip(several.tolist(), begins[several].tolist(), ends[several + WINDOW - 1].tolist(), text_of[several].tolist(), strict=True):
        first = found.setdefault((of, blake2b(view[a:b], digest_size=16).digest()), i)
        if first != i:
            twice += [first, i]
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    at = np.unique(np.array(twice, np.int64))
    cover[at] += 1
    cover[at + WINDOW] -= 1
    return np.bincount(text_of[np.cumsum(cover[:-1]) > 0], minlength=n)


def ratios(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the ratio of the whole (NaN for an empty one), and the share of its bytes in chunks out of band."""
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    raw, n = memoryview(np.ascontiguousarray(buf)), len(offsets) - 1
    whole, stray = np.full(n, np.nan), np.zeros(n)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        whole[i] = len(zstd.compress(raw[a:b])) / (b - a)
        if b - a <= CHUNK:
            stray[i] = not in_band(b - a, whole[i])
            continue
        sizes = np.minimum(CHUNK, b - np.arange(a, b, CHUNK))
        own = np.array([len(zstd.compress(raw[x : min(x + CHUNK, b)])) for x in range(a, b, CHUNK)]) / sizes
        stray[i] = sizes[~in_band(sizes, own)].sum() / (b - a)
    return whole, stray


def in_band(sizes: np.ndarray | int, own: np.ndarray | float) -> np.ndarray:
    band = np.searchsorted(_EDGES, sizes, "right")
    return (own >= _LOW[band]) & (own <= _HIGH[band])


def judged(column: pa.Array) -> list[pa.Array]:
    """The COLUMNS of each text."""
    buf, offsets = texts(column)
    words = tokenize(buf, offsets, SPACED)
    n_words = words.counts.astype(np.int64)
    repeated = repeated_words(buf, words)
    letters = _per_text(SPACED[buf] & ((buf & 0xC0) != 0x80), offsets)
    base = (n_words < LEAST_WORDS) | (100 * repeated > REPEATED_PERCENT * n_words)
    whole, stray = ratios(buf, offsets)
    kept = ~base & in_band(np.diff(offsets), whole) & (stray <= STRAY)
    counts = [n_words, letters, _per_text(_SYMBOL[buf], offsets), duplicate_lines(buf, offsets, words), repeated]
    return [*[pa.array(x, pa.int64()) for x in counts], pa.array(base), pa.array(whole, pa.float64(), mask=np.isnan(whole)), pa.array(stray), pa.array(kept)]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, ratio and stray share of the compression, and kept, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *judged(batch.column("text"))], names=["doc_id", *COLUMNS])

    schema = StructType([docs.schema["doc_id"]])
    for name, kind in COLUMNS.items():
        schema = schema.add(name, kind)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
