"""Removal of repeated word passages, found with a compressed FM-index for each shard.

A window is WINDOW words in a row, words being runs of bytes outside white space. A window is removed in every
document but the one with the least id that has it; a word goes if any removed window covers it.

Windows are sorted into shards by content, so that equal windows meet: each window is named by the least hash among
its grams of GRAMS[0] words, its anchor. The windows next to each other with one anchor make a stretch of text, a
passage. A passage alone under its anchor needs no more work. Of each other passage, the words are taken from the document
with the least id that has it, once however many have it, and streamed through its shard's FM-index, which holds the
passages of the shard's anchors: backward search over the wavelet matrix gives matching statistics, and where a match
is WINDOW words or longer, the least document id among the equal windows is that window's owner. A document loses the
windows of its passages whose owner is less than its own id. So every removal comes from the index; equal passages are
only put into it, and asked of it, once.

A shard takes whole anchors, SHARD passages on average. An anchor with more than HOT different passages does not fit
one shard: those passages, each once, are cut anew by the longer grams of the next of GRAMS, which split them
further, and what is found for the parts is handed back. The last grams are whole windows, of which no two
differ under one anchor. So shards are bounded and the work grows with the passages, not with pairs of them.

Hashes only choose shards. Passages of one anchor are told apart by 64 bits of BLAKE2b over their words, and windows in a
shard by the words themselves. Windows are judged on the input. A null text has no words; a null doc_id counts as larger than
all others. Rows with one doc_id do not remove from each other; repeated rows are looked at once and each get the
result. Only doc_id and text are read; `cleaned` keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Workspace, fresh, partitions, release, spread_join
from .fm_index import SEPARATOR, FMIndex
from .words import SPACED, grams, packed, slices, sliding_argmin, texts, tokenize, word_digests

WINDOW = 50
GRAMS = (10, 25, WINDOW)
#: Windows in one passage, at most; longer stretches are cut.
STRETCH = 150
#: Different passages of one anchor in a shard at most, and passages in a shard on average, at most.
HOT, SHARD = 1_000, 3_000
_LAST = 2**63 - 1


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.coalesce("doc_id", F.lit(_LAST)).alias("__id"), F.xxhash64("text").alias("__hash"))


def passages(hashes: np.ndarray, first: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """text number, first window (a word's place), windows and anchor of each passage."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    values = grams(hashes, gram)
    anchors = values[sliding_argmin(values, WINDOW - gram + 1)]
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + WINDOW <= first[text_of + 1]
    starts = np.flatnonzero(inside)
    anchors, text_of = anchors[starts], text_of[starts]
    if not len(starts):
        return starts, starts, starts, anchors
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text_of[1:] != text_of[:-1])])
    run = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
    cut = np.flatnonzero(place % STRETCH == 0)
    return text_of[cut], starts[cut], np.diff(np.append(cut, len(starts))), anchors[cut]


def contents(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b over each passage's words."""
    return np.frombuffer(b"".join(word_digests(text, starts, ends, 8)), "<i8")


def _scan(docs: DataFrame) -> DataFrame:
    """id, hash, anchor, content, start and size of every passage; start counts the document's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offsets = texts(batch.column("text"))
            words = tokenize(buf, offsets, SPACED)
            row, start, size, anchor = passages(words.hashes, words.first)
            text, begins, ends = packed(buf, SPACED, words)
            content = contents(text, begins[start], ends[start + size + WINDOW - 2])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)), batch.column("hash").take(pa.array(row)), pa.array(anchor.view(np.int64)), pa.array(content),
                    pa.array(start - words.first[row], pa.int32()), pa.array(size, pa.int32()),
                ],
                names=["id", "hash", "anchor", "content", "start", "size"],
            )

    return _texts(docs).mapInArrow(run, "id bigint, hash bigint, anchor bigint, content bigint, start int, size int")


def _texts(docs: DataFrame) -> DataFrame:
    return _keyed(docs.where("text is not null"), "text").select(F.col("__id").alias("id"), F.col("__hash").alias("hash"), "text")


CUT = "anchor bigint, content bigint, n bigint, kinds bigint, id bigint, words string"
_CUT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted passages, joined by spaces."""
    names = [x.split()[0] for x in CUT.split(", ")]
    for batch in slices(batches):
        buf, offsets = texts(batch.column("text"))
        words = tokenize(buf, offsets, SPACED)
        text, begins, ends = packed(buf, SPACED, words)
        out: list[tuple] = []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            base, id_ = int(words.first[i]), batch.column("id")[i].as_py()
            for w in wanted:
                a = base + w["start"]
                b = a + w["size"] + WINDOW - 2
                out.append((w["anchor"], w["content"], w["n"], w["kinds"], id_, text[begins[a] : ends[b]].decode()))
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000], strict=True), _CUT, strict=True)], names=names)


def _cut_finer(gram: int) -> Callable:
    """The same passages in parts, by longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            buf, offsets = texts(batch.column("words"))
            words = tokenize(buf, offsets, SPACED)
            row, start, size, anchor = passages(words.hashes, words.first, gram)
            text, begins, ends = packed(buf, SPACED, words)
            a, b = begins[start], ends[start + size + WINDOW - 2]
            for at in range(0, len(row), 10_000):
                part = slice(at, at + 10_000)
                own = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("anchor").take(own), batch.column("content").take(own), batch.column("n").take(own), batch.column("id").take(own), pa.array((start - words.first[row])[part], pa.int32()),
                        pa.array(anchor[part].view(np.int64)), pa.array(contents(text, a[part], b[part])), pa.array([text[x:y].decode() for x, y in zip(a[part].tolist(), b[part].tolist(), strict=True)], pa.string()),
                    ],
                    names=["of_anchor", "of_content", "n", "id", "at", "anchor", "content", "words"],
                )

    return run


RUNS = "array<struct<start:int,size:int,owner:bigint>>"
_RUN = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("owner", pa.int64())])


def search_shard(ids: np.ndarray, counts: np.ndarray, words: pa.Array) -> pa.ListArray:
    """For each passage, the runs of its windows with their owners, if it is in several documents; of a passage in one
    document only the windows that others own."""
    lists = pc.split_pattern(words, " ")
    sizes = np.diff(np.array(lists.offsets))
    symbols = np.array(lists.flatten().dictionary_encode().indices).astype(np.int64) + 1
    sigma, n = int(symbols.max(initial=0)) + 1, len(ids)
    passage = np.repeat(np.arange(n), sizes)
    whole, owners = np.full(len(symbols) + n, SEPARATOR, np.int64), np.zeros(len(symbols) + n, np.int64)  # a separator after each passage
    whole[np.arange(len(symbols)) + passage] = symbols
    owners[:] = np.repeat(ids, sizes + 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    lengths, found = FMIndex(whole, sigma, owners, WINDOW).matching_statistics(symbols, bounds)
    known = (lengths >= WINDOW) & ((found < ids[passage]) | (counts[passage] > 1))
    place = np.flatnonzero(known)
    new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (found[place[1:]] != found[place[:-1]]) | (passage[place[1:]] != passage[place[:-1]])])[: len(place)]
    run = np.flatnonzero(new)
    first = place[run]
    structs = pa.StructArray.from_arrays(
        [pa.array(first - bounds[passage[first]], pa.int32()), pa.array(np.diff(np.append(run, len(place))), pa.int32()), pa.array(found[first], pa.int64())], fields=list(_RUN)
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(passage[first], np.arange(n + 1)), pa.int32()), structs)


def _shard(table: pa.Table) -> pa.Table:
    runs = search_shard(np.array(table.column("id")), np.array(table.column("n")), table.column("words").combine_chunks())
    out = table.select(["anchor", "content", "n"]).append_column("runs", runs)
    return out.filter(pc.greater(pc.list_value_length(runs), 0))


def _counted(same: DataFrame) -> DataFrame:
    """anchor, kinds: the anchors of more than one passage, and how many different ones each has."""
    return same.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")


def _answers(space: Workspace, cut: DataFrame, level: int) -> DataFrame:
    """anchor, content, n and runs of the passages in `cut` that have any."""
    spark, last = cut.sparkSession, level == len(GRAMS) - 1
    cold = F.lit(True) if last else F.col("kinds") <= HOT
    some, hot = cut.agg(F.count_if(cold), F.count_if(~cold)).first()
    shards = max(partitions(spark), some // SHARD)
    sharded = cut.where(cold).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    runs = space.written(sharded.groupBy("shard").applyInArrow(_shard, f"anchor bigint, content bigint, n bigint, runs {RUNS}"), f"runs{level}")
    if not hot:
        return runs
    # dealt out evenly: the passages of one anchor lie together in few files
    finer = cut.where(~cold).repartition(partitions(spark), "content").mapInArrow(_cut_finer(GRAMS[level + 1]), "of_anchor bigint, of_content bigint, n bigint, id bigint, at int, anchor bigint, content bigint, words string")
    finer = space.written(finer, f"finer{level}")
    same = space.written(finer.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.min("id").alias("id"), F.first("words").alias("words")), f"same{level}")
    kinds = space.written(_counted(same), f"kinds{level}")
    below = space.written(spread_join(same, kinds, ["anchor"], "kinds", "content").select(*[x.split()[0] for x in CUT.split(", ")], "parts"), f"cut{level}")
    told = space.written(below.select("anchor", "content", "parts").join(_answers(space, below, level + 1).drop("n"), ["anchor", "content"]), f"told{level}")
    parts = spread_join(finer.drop("words"), told, ["anchor", "content"], "parts", "of_content")
    moved = parts.select(F.col("of_anchor").alias("anchor"), F.col("of_content").alias("content"), "n", "id", "at", F.explode("runs").alias("run")).where("n > 1 or run.owner < id")
    run = F.struct((F.col("at") + F.col("run.start")).alias("start"), F.col("run.size").alias("size"), F.col("run.owner").alias("owner"))
    whole = moved.groupBy("anchor", "content", "n").agg(F.collect_list(run).alias("runs"))
    return space.written(runs.unionByName(whole), f"all{level}")


def repeated(docs: DataFrame) -> DataFrame:
    """id, hash and spans (first word, words) of the repeated windows of each document that has some."""
    spark = docs.sparkSession
    space = Workspace(spark)
    every = space.written(_scan(docs), "every")
    anchors = space.written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    found = space.written(spread_join(every, anchors, ["anchor"], "n", "id").drop("n"), "passages")
    space.drop("every", "anchors")
    release(spark)
    least = F.min(F.struct("id", "hash", "start", "size")).alias("least")
    same = space.written(found.groupBy("anchor", "content").agg(least, F.count("*").alias("n")), "same")
    release(spark)
    kinds = space.written(_counted(same), "kinds")
    several = spread_join(same, kinds, ["anchor"], "kinds", "content")
    wanted = several.groupBy("least.id", "least.hash").agg(F.collect_list(F.struct("anchor", "content", "n", "kinds", "least.start", "least.size")).alias("wanted"))
    text = _texts(docs).dropDuplicates(["id", "hash"])  # rows that repeat id and text are one document here
    cut = space.written(text.join(wanted, ["id", "hash"]).mapInArrow(_cut_out, CUT), "cut")
    space.drop("same", "kinds")
    release(spark)
    told = _answers(space, cut, 0)
    release(spark)
    hits = spread_join(found, told, ["anchor", "content"], "n", "id").select("id", "hash", F.col("start").alias("at"), F.explode("runs").alias("run")).where("run.owner < id")
    span = F.struct((F.col("at") + F.col("run.start")).alias("start"), (F.col("run.size") + (WINDOW - 1)).alias("size"))
    out = space.written(hits.groupBy("id", "hash").agg(F.collect_list(span).alias("spans")), "spans")
    space.keep("spans")
    release(spark)
    return out


def _kept(words, row: int, wanted: list[dict] | None) -> np.ndarray:
    n = int(words.counts[row])
    cover = np.zeros(n + 1, np.int64)
    for s in wanted or ():
        cover[s["start"]] += 1
        cover[s["start"] + s["size"]] -= 1
    return np.cumsum(cover[:n]) == 0


def _with_spans(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """These columns and the spans to remove, and the name of the column that has them."""
    i, h, spans = fresh(docs, "id", "hash", "spans")
    own = repeated(docs).select(F.col("id").alias(i), F.col("hash").alias(h), F.col("spans").alias(spans))
    keyed = docs.select(*columns, F.coalesce("doc_id", F.lit(_LAST)).alias(i), F.xxhash64("text").alias(h))
    return keyed.join(own, [i, h], "left").select(*columns, spans), spans


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offsets = texts(batch.column("text"))
            words = tokenize(buf, offsets, SPACED)
            raw, removed, sums = buf.tobytes(), [], []
            starts, ends = words.starts.tolist(), words.ends.tolist()
            for i, wanted in enumerate(batch.column(spans).to_pylist()):
                keep = _kept(words, i, wanted)
                at = (np.flatnonzero(keep) + int(words.first[i])).tolist()
                removed.append(len(keep) - len(at))
                sums.append(hashlib.sha256(b" ".join([raw[starts[j] : ends[j]] for j in at])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined, spans = _with_spans(docs, "doc_id", "text")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """All columns of the documents with the repeated passages taken out of their texts. Where something goes, what
    is left is joined by single spaces; a document that nothing is left of goes. Other texts stay as they are."""
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            place = batch.schema.get_field_index("text")
            spans_ = batch.column(batch.schema.get_field_index(spans)).to_pylist()
            new, stays = batch.column(place).to_pylist(), [True] * batch.num_rows
            own = [i for i, s in enumerate(spans_) if s]
            if own:
                buf, offsets = texts(batch.column(place).take(pa.array(own)))
                words, raw = tokenize(buf, offsets, SPACED), buf.tobytes()
                for j, i in enumerate(own):
                    at = np.flatnonzero(_kept(words, j, spans_[i])) + int(words.first[j])
                    new[i] = b" ".join([raw[words.starts[k] : words.ends[k]] for k in at.tolist()]).decode()
                    stays[i] = bool(len(at))
            columns = [batch.column(i) for i in range(len(names))]
            columns[names.index("text")] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    joined, spans = _with_spans(docs, *names)
    out = joined.mapInArrow(run, schema)
    if "n_chars" in names and isinstance(schema["n_chars"].dataType, LongType):
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*names)
    return out
