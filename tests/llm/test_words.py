"""The vectorised tokenizer and the FM-index against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from tallyrank.llm import words as W
from tallyrank.llm.fm_index import DEPTH, FMIndex

TEXTS = ["a b  c", "", None, "héllo\nwörld x", "  ", "ABC-def 9", "x" * 50, "ab c" * 300, "\x00\x7f日本 é"]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 17])
@pytest.mark.parametrize("kind", ["spaced", "alnum"])
def test_words(monkeypatch, chunk, kind):
    monkeypatch.setattr(W, "CHUNK", chunk)
    table, fold, pattern = {"spaced": (W.SPACED, None, rb"[^\x20\x09-\x0D]+"), "alnum": (W.ALNUM, W.LOWER, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}[kind]
    buf, offsets = W.texts(pa.array(TEXTS))
    found, seen = W.tokenize(buf, offsets, table, fold), {}
    shown = buf if fold is None else fold[buf]
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        raw = raw if fold is None else fold[np.frombuffer(raw, np.uint8)].tobytes()
        own = range(int(found.first[i]), int(found.first[i + 1]))
        assert [shown[found.starts[j] : found.ends[j]].tobytes() for j in own] == re.findall(pattern, raw)
        for j in own:
            word = shown[found.starts[j] : found.ends[j]].tobytes()
            assert seen.setdefault(word, int(found.hashes[j])) == int(found.hashes[j])
    assert len(set(seen.values())) == len(seen)


def test_sliding_minimum():
    values = np.random.default_rng(1).integers(0, 5, 100)
    for w in (1, 2, 7, 41, 100):
        assert W.sliding_argmin(values, w).tolist() == [i + int(np.argmin(values[i : i + w])) for i in range(101 - w)]
    assert len(W.sliding_argmin(values, 101)) == 0


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS), "i": list(range(len(TEXTS)))})
    parts = list(W.slices(iter([batch]), limit=10))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(len(TEXTS)))
    assert len(parts) > 1


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for sigma, n in ((4, 60), (3, 150), (9, 200), (2, 700), (30, 900)):
        text = rng.integers(1, sigma, n)
        text[rng.integers(0, n, 6)] = 0
        owners, window = rng.integers(0, 50, n), int(rng.integers(1, 6))
        index = FMIndex(text, sigma, owners, window)
        patterns = [np.concatenate([rng.integers(1, sigma, rng.integers(0, 20)), text[i : i + 25][text[i : i + 25] > 0]]) for i in rng.integers(0, n - 25, 8)]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in patterns])])
        lengths, least = index.matching_statistics(np.concatenate(patterns), bounds)
        for p, at in zip(patterns, bounds, strict=False):
            for i in range(len(p)):
                best = max(next((k for k in range(len(p) - i) if j + k >= n or text[j + k] != p[i + k]), len(p) - i) for j in range(n))
                assert lengths[at + i] == best
                having = [owners[j] for j in range(n - window + 1) if text[j : j + window].tolist() == p[i : i + window].tolist()]
                assert least[at + i] == (min(having) if len(p) - i >= window and having else 2**63 - 1)


def test_matches_longer_than_the_order_of_suffixes():
    rng = np.random.default_rng(4)
    for sigma, n in ((900, 400), (3, 500)):
        text = rng.integers(1, sigma, n)
        text[n // 2] = 0
        owners = np.repeat([3, 5], [n // 2, n - n // 2])
        index = FMIndex(text, sigma, owners, 50)
        for k in (125, 126, 127, 128, 130, 150, 199):
            pattern = np.concatenate([rng.integers(1, sigma, 9), text[:k], text[n // 2 + 1 :][:k]])
            lengths, least = index.matching_statistics(pattern, np.array([0, len(pattern)]))
            for i in range(len(pattern)):
                best = max(next((m for m in range(len(pattern) - i) if j + m >= n or text[j + m] != pattern[i + m]), len(pattern) - i) for j in range(n))
                assert lengths[i] == min(best, DEPTH - 2)
                having = [owners[j] for j in range(n - 49) if text[j : j + 50].tolist() == pattern[i : i + 50].tolist()]
                assert least[i] == (min(having) if having else 2**63 - 1)


def complements(n):
    """A sequence of two letters and its complement that any sum over powers of an odd number modulo 2**64 confuses."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_patterned_words_and_texts_differ(n):
    a, b = complements(n)
    found = W.tokenize(*W.texts(pa.array([a, b])), W.SPACED)
    assert found.hashes[0] != found.hashes[1]
    for text in (a, b):
        assert W.tokenize(*W.texts(pa.array([f" {text}\n", text])), W.SPACED).hashes.tolist() in ([found.hashes[0]] * 2, [found.hashes[1]] * 2)
    rows = [W.tokenize(*W.texts(pa.array([" ".join(x)])), W.SPACED).hashes for x in (a, b)]
    ends = [W.spans(x, np.array([0, 1]), np.array([n, n])) for x in rows]
    assert not set(ends[0].tolist()) & set(ends[1].tolist())


def test_spans_are_grams():
    hashes = np.random.default_rng(2).integers(0, 2**63, 90, dtype=np.uint64)
    for k in (1, 2, 5, 10, 50, 64):
        at = np.arange(len(hashes) - k + 1)
        assert W.grams(hashes, k).tolist() == W.spans(hashes, at, at + k).tolist()
        assert len(set(W.grams(hashes, k).tolist())) == len(at)


def test_packed_words():
    buf, offsets = W.texts(pa.array([*TEXTS, "end", "begin", "a\t \nb"]))
    found = W.tokenize(buf, offsets, W.SPACED)
    text, starts, ends = W.packed(buf, W.SPACED, found)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [buf[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)]
    assert W.word_digests(text, starts[:2], ends[:2])[0] != W.word_digests(text, starts[:2], ends[:2])[1]
