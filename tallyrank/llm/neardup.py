"""Near-duplicate classes by DartMinHash.

A text is the multiset of its five-word shingles (words of letters, digits and bytes beyond ASCII, in lower case); the
similarity of two texts is the weighted Jaccard index of their counts. For a signature, hashed darts are thrown at
the plane of elements, weights and ranks: each element's weight axis is cut into regions of doubling width, and darts
land in a region at hashed exponential distances in rank. Those under the element's weight count, up to the rank where
about T (ln T + 3) have come; every dart belongs to a hashed coordinate and the earliest of each coordinate is kept.
The work is the number of shingles plus the number of darts, whatever T. Two texts agree in a coordinate with
a probability of exactly their similarity.

Texts with the same words (by 128 bits of BLAKE2b over them) are one class from the start, and only one of them, the one
with the least id, goes on.
ROWS coordinates make a band. In each bucket of a band all are compared with the bucket's least member, on their
whole texts; a pair at THRESHOLD or more is a link, and links are closed to classes. At similarity 0.8 a pair shares a
bucket with probability 1 - (1 - 0.8^5)^24 = 0.99993. A bucket that still holds several classes is then compared
whole: its members are dealt into blocks of bounded size, and each block is compared with itself and with every other
block of the bucket, all members of different classes against each other, on their whole texts. So every two texts
that share a bucket are compared or already in one class, however large the bucket, and only what shares none of the
24 buckets can be missed. Blocks bound the rows and the memory of a task; the work in a bucket of many texts that are
not alike grows with the square of their number, as it must where each pair is to be told. The rows of frequent buckets,
leads, labels and contents are dealt over several partitions in every join (`spread_join`).

Texts of fewer than five words are one shingle of all their words. Texts without a word, the empty one among them, are
only grouped with equal texts. Null texts are classes of their own. Repeated rows are in one class; a class is named
by its least doc_id (rows with a null doc_id count as largest). Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, spread_join
from .words import ALNUM, LOWER, Words, mix, packed, slices, spans, texts, tokenize, word_digests

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Members and bytes of text in a block of a bucket, about; elements compared at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 8 << 20, 4096
#: Rounds of labelling before buckets are compared whole.
ROUGH = 2
#: Elements that darts are thrown at at once.
HELD = 1 << 18
U = np.uint64
_LAST = 2**63 - 1


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle."""
    counts = words.counts
    n = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    text_of = np.repeat(np.arange(len(counts)), n)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + words.first[:-1][text_of]
    hashes = spans(words.hashes, starts, np.minimum(starts + SHINGLE, words.first[1:][text_of]))
    order = np.lexsort((hashes, text_of))
    text_of, hashes = text_of[order], hashes[order]
    if not len(hashes):
        return text_of, hashes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])]))
    return text_of[first], hashes[first], np.diff(np.append(first, len(hashes)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(text_of: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """For each of n weighted sets, the earliest dart of each of `size` coordinates (0 throughout for an empty set)."""
    out = np.zeros((n, size), np.uint64)
    total = np.bincount(text_of, weights=weights, minlength=n)
    reach = np.divide(size * (np.log(size) + 3), total, out=np.zeros(n), where=total > 0)
    left = total > 0
    while left.any():
        own = np.flatnonzero(left[text_of])
        filled, found = _throw(text_of[own], elements[own], weights[own].astype(np.float64), reach, n, size)
        whole = left & filled.all(axis=1)
        out[whole] = found[whole]
        left &= ~whole
        reach = reach * 2
    return out


def _thrown(s, e, w, reach, size, level) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slot, rank and number of the darts that hit these elements in a region of weights."""
    parts = []
    rank, throw = np.zeros(len(e)), 0
    limit = reach[s]
    while len(e):  # as many throws at once as keep the arrays small
        many = min(64, max(1, 1 + 50_000 // len(e)))
        h = mix(e[:, None] ^ mix(np.arange(throw, throw + many, dtype=np.uint64) + U(level * 1_000_003 + 1)))
        gaps = np.empty((len(e), many + 1))
        gaps[:, 0], gaps[:, 1:] = rank, np.log(_uniform(h)) / -(2.0**level)
        ranks = np.cumsum(gaps, axis=1)[:, 1:]
        near = ranks <= limit[:, None]
        row, turn = np.nonzero(near)
        own = h[row, turn]
        g = mix(own + U(0x9E3779B97F4A7C15))
        under = np.flatnonzero(2.0**level * (1 + _uniform(g)) - 1 < w[row])
        coordinate = (mix(g[under]) >> U(33)).astype(np.int64) % size
        parts.append((s[row[under]] * size + coordinate, ranks[row[under], turn[under]], own[under]))
        on = near[:, -1]
        e, s, w, rank, limit = e[on], s[on], w[on], ranks[on, -1], limit[on]
        throw += many
    return parts


def _throw(text_of, elements, weights, reach, n, size):
    """All darts up to each set's reach in rank, and of them the earliest of each coordinate."""
    parts = []
    level = 0
    while True:  # region `level` has weights from 2**level - 1 to 2**(level + 1) - 1
        inside = np.flatnonzero(weights > 2.0**level - 1)
        if not len(inside):
            break
        for first in range(0, len(inside), HELD):  # so many elements at once: a text may be very long
            own = inside[first : first + HELD]
            parts += _thrown(text_of[own], elements[own], weights[own], reach, size, level)
        level += 1
    slots, ranks, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, ranks, slots))
    slots, ids = slots[order], ids[order]
    first = np.concatenate([[True], slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, bool)
    filled, found = np.zeros(n * size, bool), np.zeros(n * size, np.uint64)
    filled[slots[first]], found[slots[first]] = True, ids[first]
    return filled.reshape(n, size), found.reshape(n, size)


def bands(found: np.ndarray) -> np.ndarray:
    """One number for each band of a signature."""
    rows = found.reshape(len(found), BANDS, ROWS)
    out = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(found), 1))
    for i in range(ROWS):
        out = mix(out * U(0xD6E8FEB86659FD93) + rows[:, :, i])
    return out


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard index of the shingle counts of each pair of texts."""
    n = len(left)
    sides = [shingles(tokenize(*texts(x), ALNUM, LOWER)) for x in (left, right)]
    pair, value, weight, side = (np.concatenate(x) for x in zip(*[(*s, np.full(len(s[0]), i)) for i, s in enumerate(sides)], strict=True))
    order = np.lexsort((side, value, pair))
    pair, value, weight = pair[order], value[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))
    shared = np.bincount(pair[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=n)
    whole = np.bincount(pair, weights=weight, minlength=n) - shared
    return np.divide(shared, whole, out=np.zeros(n), where=whole > 0)


def _signed(docs: DataFrame) -> DataFrame:
    """key (doc_id and a hash of the text), content (a digest of the words) and bands of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offsets = texts(batch.column("text"))
            words = tokenize(buf, offsets, ALNUM, LOWER)
            n = batch.num_rows
            text, begins, ends = packed(LOWER[buf], ALNUM, words)
            some = np.flatnonzero(words.counts)
            content = [b""] * n
            for i, digest in zip(some.tolist(), word_digests(text, begins[words.first[some]], ends[words.first[some + 1] - 1]), strict=True):
                content[i] = digest
            for i in np.flatnonzero(words.counts == 0).tolist():  # by the text itself
                content[i] = hashlib.blake2b(buf[offsets[i] : offsets[i + 1]], digest_size=16, key=b"no words").digest()
            found = bands(signatures(*shingles(words), n, BANDS * ROWS)).view(np.int64)
            at = np.concatenate([[0], np.cumsum(np.where(words.counts > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(found[words.counts > 0].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(content, pa.binary()), lists], names=["doc_id", "text_hash", "content", "bands"]
            )

    rows = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    out = rows.mapInArrow(run, "doc_id bigint, text_hash bigint, content binary, bands array<bigint>")
    return out.select(F.struct("doc_id", "text_hash").alias("key"), "content", "bands")


def _compared(space: Workspace, pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """The pairs (left, right) whose texts are similar enough. A right text goes to the partitions of its pairs, not to
    each pair; a left one has a pair for each band at most."""
    left = kept.select(F.col("key").alias("left"), F.col("text").alias("left_text"))
    times = pairs.groupBy(F.col("right").alias("key")).agg(F.count("*").alias("times"))
    right = space.written(kept.join(times, "key").select(F.col("key").alias("right"), F.col("text").alias("right_text"), "times"), "leads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left_text"):
            alike = similarity(batch.column("left_text"), batch.column("right_text")) >= THRESHOLD
            yield batch.select(["left", "right"]).filter(pa.array(alike))

    kind = pairs.schema["left"].dataType.simpleString()
    return spread_join(pairs.join(left, "left"), right, ["right"], "times", "left").select("left", "right", "left_text", "right_text").mapInArrow(run, f"left {kind}, right {kind}")


def components(space: Workspace, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, label: the least node that links lead to, for each node of a link (left, right).

    With `rounds`, no more than so many: nodes of one component may then still have several labels."""
    ends = links.unionByName(links.select(F.col("right").alias("left"), F.col("left").alias("right")))
    # how many links each node has: those of one with very many are dealt out
    labels = ends.groupBy(F.col("left").alias("node")).agg(F.least(F.min("right"), F.col("left")).alias("label"), F.count("*").alias("links"))
    labels = space.written(labels, "labels")
    total, many = links.count(), labels.count()
    while True:
        met = links
        for side, label in (("left", "x"), ("right", "y")):
            met = spread_join(met, labels.select(F.col("node").alias(side), F.col("label").alias(label), F.col("links").alias("times")), [side], "times", "right" if side == "left" else "left", total).drop("times")
        # a label that a link joins to a lesser one gives way to it; so does a label whose own node has a lesser one
        hooks = met.where("x != y").select(F.greatest("x", "y").alias("label"), F.least("x", "y").alias("to"))
        chains = labels.where("node != label").select(F.col("node").alias("label"), F.col("label").alias("to"))
        lower = hooks.unionByName(chains).groupBy("label").agg(F.min("to").alias("to")).where("to < label")
        nodes = labels.groupBy("label").agg(F.count("*").alias("times"))
        lower = space.written(nodes.join(lower, "label", "left"), "lower")  # every label, with what it gives way to
        moved = lower.where("to is not null").limit(1).count()
        if moved:
            labels = space.written(spread_join(labels, lower, ["label"], "times", "node", many).select("node", F.coalesce("to", "label").alias("label"), "links"), "labels")
        rounds = rounds and rounds - 1
        if rounds == 0 or not moved:
            return labels.drop("links")


def overlaps(column: pa.Array, n: int | None = None) -> np.ndarray:
    """Weighted Jaccard indices of the first n texts with the others, or of all with all."""
    count = len(column)
    text_of, hashes, weights = shingles(tokenize(*texts(column), ALNUM, LOWER))
    total = np.bincount(text_of, weights=weights, minlength=count)
    # a shingle that comes w times is w elements, so that the shared ones are a product of matrices of 0 and 1
    text_of, hashes = np.repeat(text_of, weights), np.repeat(hashes, weights)
    turn = np.arange(len(hashes)) - np.repeat(np.cumsum(weights) - weights, weights)
    order = np.lexsort((turn, hashes))
    text_of, hashes, turn = text_of[order], hashes[order], turn[order]
    element = np.cumsum(np.concatenate([[0], (hashes[1:] != hashes[:-1]) | (turn[1:] != turn[:-1])])[: len(hashes)])
    common = np.bincount(element) > 1
    text_of, element = text_of[common[element]], (np.cumsum(common) - 1)[element[common[element]]]
    a, b = (slice(None), slice(None)) if n is None else (slice(0, n), slice(n, None))
    shared = np.zeros((len(total[a]), len(total[b])))
    for low in range(0, int(common.sum()), COLUMNS):
        i, j = np.searchsorted(element, [low, low + COLUMNS])
        inside = np.zeros((count, min(COLUMNS, int(common.sum()) - low)), np.float32)
        inside[text_of[i:j], element[i:j] - low] = 1
        shared += inside[a] @ inside[b].T
    whole = total[a][:, None] + total[b][None] - shared
    return np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)


def _joined(left: pa.StructArray, right: pa.StructArray | None) -> tuple[list[int], list[int]]:
    """Links of one block, or of two, that join all classes that their similar members join: at most one a member."""
    both = left if right is None else pa.concat_arrays([left, right])
    alike = overlaps(both.field("text"), None if right is None else len(left)) >= THRESHOLD
    label = list(zip(*[both.field("label").field(x).to_pylist() for x in ("doc_id", "text_hash")], strict=True))
    least: dict = {}

    def find(x):
        while least.get(x, x) != x:
            x = least[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True):
        j += 0 if right is None else len(left)
        if i < j and (a := find(label[i])) != (b := find(label[j])):
            least[max(a, b)] = min(a, b)
            out.append((i, j))
    return [i for i, _ in out], [j for _, j in out]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links in each row's block `members`, or between it and the block `others`."""
    for batch in batches:
        sides = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in ("members", "others")]
        for row in range(batch.num_rows):
            blocks = [x.slice(row, 1).flatten() for x in sides]
            i, j = _joined(blocks[0], blocks[1] if len(blocks) > 1 else None)
            keys = pa.concat_arrays([x.field("key") for x in blocks])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(x, pa.int64())) for x in (i, j)], names=["left", "right"])


def _blocks(space: Workspace, shared: DataFrame, labels: DataFrame, kept: DataFrame) -> DataFrame:
    """Buckets of three or more that hold several classes, in blocks; of buckets with the same members, one."""
    named = shared.select("band", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    named = space.written(named.join(kept.select("key", F.octet_length("text").alias("bytes")), "key"), "named")
    found = named.groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum("bytes").alias("bytes"),
        *[F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"h{i}") for i in range(2)],
    ).where("low != high and size > 2")
    one = found.groupBy("size", "bytes", "h0", "h1").agg(F.min("band").alias("band"))
    sized = space.written(one.select("band", "size", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("blocks")), "sized")
    dealt = spread_join(named.drop("bytes"), sized, ["band"], "size", "key").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "key"), "blocks")).join(kept, "key")
    return dealt.groupBy("band", "blocks", "block").agg(F.collect_list(F.struct("key", "label", "text")).alias("members"))


def _whole(space: Workspace, shared: DataFrame, labels: DataFrame, kept: DataFrame) -> DataFrame:
    """Links (left, right) that join the classes of all similar texts that share a bucket."""
    blocks = space.written(_blocks(space, shared, labels, kept), "blocks")
    kind = blocks.schema["members"].dataType.elementType["key"].dataType.simpleString()
    schema = f"left {kind}, right {kind}"
    inner = blocks.select("members").mapInArrow(_linked, schema)
    large = blocks.where("blocks > 1")
    turns = large.where("block < blocks - 1").select("band", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), "members")
    met = turns.join(large.select("band", "block", F.col("members").alias("others")), ["band", "block"])
    return inner.unionByName(met.select("members", "others").mapInArrow(_linked, schema))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every text's key and content, and every content's class: (signed rows), (content, key, n, class)."""
    space = Workspace(docs.sparkSession)
    rows = space.written(_signed(docs), "signed")
    same = space.written(rows.groupBy("content").agg(F.min(F.struct("key", "bands")).alias("least"), F.count("*").alias("n")).select("content", "least.key", "least.bands", "n"), "same")
    placed = same.select("key", F.explode("bands").alias("band"))
    buckets = space.written(placed.groupBy("band").agg(F.min("key").alias("lead"), F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = space.written(spread_join(placed, buckets, ["band"], "size", "key"), "shared")  # every member of a bucket of two or more
    needed = shared.select("key").distinct()
    texts_of = docs.where("text is not null").select(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash")).alias("key"), "text")
    kept = space.written(texts_of.join(needed, "key").dropDuplicates(["key"]), "texts")

    pairs = space.written(shared.where("key != lead").select(F.col("key").alias("left"), F.col("lead").alias("right")).distinct(), "pairs")
    links = space.written(_compared(space, pairs, kept), "links")
    # labels need not be final yet: two labels in one class only cost comparisons
    links = space.written(links.unionByName(_whole(space, shared, components(space, links, ROUGH), kept)), "links")
    labels = components(space, links)
    named = same.drop("bands").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("label", "key")).drop("label")
    named = space.written(named, "classes")
    space.keep("signed", "classes")
    return rows.drop("bands"), named


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_size, one row for each row of the documents."""
    space = Workspace(docs.sparkSession)
    rows, named = classes(docs)
    sizes = space.written(named.groupBy("class").agg(F.sum("n").alias("class_size"), F.count("*").alias("kinds")), "sizes")
    sized = space.written(spread_join(named, sizes, ["class"], "kinds", "key").select("content", "n", F.col("class.doc_id").alias("class_id"), "class_size"), "sized")
    space.keep("sized")
    back = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c.split(".")[-1])
    out = spread_join(rows, sized, ["content"], "n", "key").select(back("key.doc_id"), back("class_id"), "class_size")
    nulls = docs.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return out.unionByName(nulls)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without those in a class with a lesser one; null texts stay."""
    _, named = classes(docs)
    i, h = fresh(docs, "id", "hash")
    keep = named.select(F.col("class.doc_id").alias(i), F.col("class.text_hash").alias(h)).distinct()
    marked = docs.where("text is not null").withColumn(i, F.coalesce("doc_id", F.lit(_LAST))).withColumn(h, F.xxhash64("text"))
    best = marked.join(keep, [i, h], "left_semi").dropDuplicates([i, h]).select(*docs.columns)
    return best.unionByName(docs.where("text is null"))
