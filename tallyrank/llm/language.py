"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER bytes long, with the counts of the bytes that followed each.
A byte is coded in the longest context that the tree has; if it never followed there, an escape is coded and the next
shorter context is tried, down to eight bits for a byte never seen. With n followers of which q differ, a byte seen c
times has the probability c / (n + q) and the escape q / (n + q). The counts are frozen after training, so the exact
code length of a byte depends on the ORDER bytes before it alone: each worker works it out once for every sequence of
ORDER + 1 bytes that it meets and remembers it in a table of fixed size. The shortest code wins.

Letters are lower-cased (A-Z and Latin-1) and other ASCII bytes become spaces. `und` is given to null texts and to
texts without letters (Unicode category L: digits and numerals of any script are none). Ties go to the language first in alphabetical order. Repeated rows are scored alike. Only
doc_id, text and, for training, lang are read. Training takes at most SAMPLE whole texts of
each language, a documented bound; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import mix, slices, texts

ORDER = 4
SAMPLE = 500
#: Slots of the table of remembered code lengths (a power of two).
SLOTS = 1 << 17
UNKNOWN = "und"
U = np.uint64

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123], _FOLD[65:91], _FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def fold(buf: np.ndarray) -> np.ndarray:
    out = _FOLD[buf]
    if len(out) > 1:
        capital = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[capital] += 0x20
    return out


def sequences(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDER bytes before it in its text as one number; spaces come before a text."""
    codes = np.zeros(len(data), np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(ORDER, 0, -1):
        earlier = np.full(len(data), 32, np.uint8)
        earlier[back:] = data[:-back] if back < len(data) else data[:0]
        earlier[place < back] = 32
        codes = codes << U(8) | earlier
    return codes << U(8) | data


@dataclass
class Tree:
    """Counts of one language: for each order the sequences seen with their counts, and the contexts with n and q."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]

    @classmethod
    def of(cls, codes: np.ndarray) -> Tree:
        out = cls([], [], [], [], [])
        for order in range(ORDER + 1):
            grams, counts = np.unique(codes & U((1 << 8 * (order + 1)) - 1), return_counts=True)
            contexts, first = np.unique(grams >> U(8), return_index=True)
            out.grams.append(grams)
            out.counts.append(counts.astype(np.float64))
            out.contexts.append(contexts)
            out.totals.append(np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0))
            out.kinds.append(np.diff(np.append(first, len(grams))).astype(np.float64))
        return out

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of each sequence."""
        out, waiting = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            if not len(self.grams[order]):
                continue
            own = codes[waiting] & U((1 << 8 * (order + 1)) - 1)
            context, at = _find(self.contexts[order], own >> U(8))
            gram, place = _find(self.grams[order], own)
            whole = self.totals[order][at] + self.kinds[order][at]
            coded = context & gram
            out[waiting[coded]] -= np.log2(self.counts[order][place[coded]] / whole[coded])
            escaped = context & ~gram
            out[waiting[escaped]] -= np.log2(self.kinds[order][at[escaped]] / whole[escaped])
            waiting = waiting[~coded]
        out[waiting] += 8
        return out


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return known[at] == wanted, at


class Lengths:
    """Code lengths in all languages, remembered in a table of fixed size."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.keys = np.full(SLOTS, 2**64 - 1, np.uint64)
        self.values = np.zeros((SLOTS, len(trees)), np.float32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        slots = (mix(codes) >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = self.values[slots]
        missed = np.flatnonzero(self.keys[slots] != codes)
        if len(missed):
            new, back = np.unique(codes[missed], return_inverse=True)
            values = np.stack([t.bits(new) for t in self.trees], axis=1).astype(np.float32)
            out[missed] = values[back]
            place = (mix(new) >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)
            self.keys[place], self.values[place] = new, values
            # of sequences that share a slot the last stays, with its own values
            last = np.zeros(SLOTS, np.int64)
            last[place] = np.arange(len(new))
            self.keys[place], self.values[place] = new[last[place]], values[last[place]]
        return out


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]


def train(samples: dict[str, list[str]]) -> Model:
    languages = sorted(k for k, v in samples.items() if any(v))
    trees = []
    for language in languages:
        buf, offsets = texts(pa.array(samples[language], pa.large_string()))
        trees.append(Tree.of(sequences(fold(buf), offsets)))
    return Model(languages, trees)


def predict(column: pa.Array, model: Model, lengths: Lengths) -> tuple[list[str], np.ndarray]:
    buf, offsets = texts(column)
    n = len(offsets) - 1
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    bits = np.zeros((n, len(model.languages)))
    block = 1 << 18  # bytes at once
    data, lettered = fold(buf), np.zeros(n, bool)
    for at in range(0, len(data), block):
        to, lead = min(len(data), at + block), min(at, ORDER)
        inner = np.clip(offsets, at - lead, to) - (at - lead)
        cost = lengths(sequences(data[at - lead : to], inner)[lead:])
        # whose text each byte is in
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to, "left")
        cuts = np.clip(offsets[first : last + 1], at, to) - at
        sums = np.zeros((len(cost) + 1, cost.shape[1]))
        np.cumsum(cost, axis=0, out=sums[1:])
        bits[first:last] += sums[cuts[1:]] - sums[cuts[:-1]]
        plain = data[at:to]
        letters = np.concatenate([[0], np.cumsum((plain >= 97) & (plain < 123))])
        lettered[first:last] |= letters[cuts[1:]] > letters[cuts[:-1]]
    for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
        lettered[i] = bool(_LETTER.search(buf[offsets[i] : offsets[i + 1]].tobytes().decode()))
    best = bits.argmin(axis=1)
    extra = bits - bits.min(axis=1, keepdims=True)
    sure = 1 / np.exp2(-extra / np.sqrt(np.maximum(np.diff(offsets), 1))[:, None]).sum(axis=1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, sure, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model.trees)
        for batch in slices(batches):
            names, scores = predict(batch.column("text"), model, lengths)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": scores})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
