"""The corpus operators against brute force, round trips and held-out labels."""

import collections
import fractions
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from cases import ODD, documents, passages
from oracle import SMALL
from pyspark.sql import functions as F
from test_words import complements

from tallyrank.llm import decontaminate, exact_topk, language, licenses, neardup, quality, queries, sampling, sentence_pieces, substrings, token_files, toxicity
from tallyrank.llm.words import LOWER

PIECES, WORDS = (public_tokenizers.path(x) for x in (queries.PIECE_MODEL, queries.WORD_TOKENIZER))


def by_id(df):
    return {r[0]: tuple(r) for r in df.collect()}


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# --- 1, 2, 4: classifiers -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name,label,threshold,recall,precision", [("op1_quality", "quality", 0.95, 0.95, 0.95), ("op2_toxicity", "toxic", 0.85, 0.55, 0.7)])
def test_held_out_labels(spark, name, label, threshold, recall, precision):
    """At this size there are some 30 toxic texts to learn from; the README has the figures of larger tables."""
    folder = SMALL.replace("0.001", "0.01")
    out = queries.queries()[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) / len(held) >= threshold
    hits = sum(r["predicted"] == 1 == r[label] for r in held)
    assert hits >= recall * sum(r[label] == 1 for r in held) and hits >= precision * sum(r["predicted"] for r in held)
    limit = 0.3 if label == "quality" else 0.7
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit) for r in out)


def test_ranking_learns_order():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, quality.FEATURES)), rng.normal(0, 1, (100, quality.FEATURES))
    model = quality.fit(good, bad, 0.3)
    assert (model.strength(good)[:, None] > model.strength(bad)[None, :]).mean() > 0.9


def test_ranking_is_fitted_on_whole_texts(spark, monkeypatch):
    rng = random.Random(4)
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    # good and bad alike begin with plain text of more than 4,000 characters
    rows = [(i, plain(900) + (" " + plain(600) if i % 3 else " BUY!! NOW!!" * 300), int(i % 3 > 0)) for i in range(90)]
    docs = documents(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, label int")
    for sample in (quality.SAMPLE, 10):  # the cut is that of all labelled rows, whatever the sample
        monkeypatch.setattr(quality, "SAMPLE", sample)
        out = quality.score(docs, quality.fitted(docs, labels, 0.3)).collect()
        assert all((r[quality.SCORE] >= 0.3) == (r["doc_id"] % 3 > 0) for r in out)


def test_nth_least_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "HELD", 10)
    monkeypatch.setattr(quality, "BINS", 4)
    rng = random.Random(5)
    values = [rng.choice([0.5, rng.gauss(0, 1), 1e6 * rng.random()]) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    assert [quality.nth(df, n) for n in (0, 7, 150, 299)] == [sorted(values)[n] for n in (0, 7, 150, 299)]


def test_toxicity_is_fitted_on_whole_texts(spark):
    rng = random.Random(6)
    plain = lambda n: " ".join(f"{rng.choice('bcdfgh')}a{rng.choice('lmnprst')}e{rng.choice('kvz')}o" for _ in range(n))
    rows = [(i, plain(900) + (" you grumblewort" if i % 2 else " you neighbour"), i % 2) for i in range(80)]
    docs = documents(spark, [t for _, t, _ in rows])
    found, _ = sampling.labelled(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, label int"), toxicity.SAMPLE)
    out = toxicity.score(docs, toxicity.train(found[1], found[0])).collect()
    assert all((r[toxicity.SCORE] >= 0.7) == (r["doc_id"] % 2 == 1) for r in out)


def test_toxic_dictionaries_are_trained_and_told_apart():
    rng = random.Random(7)
    plain = lambda n: " ".join(f"{rng.choice('bcdfgh')}a{rng.choice('lmnprst')}e{rng.choice('kvz')}o" for _ in range(n))
    insults = ["you grumblewort", "what a snivelcrank", "such flabberscum"]
    toxic = [" ".join(f"{plain(30)} {rng.choice(insults)}" for _ in range(3)) + " " + plain(20) for _ in range(150)]
    ordinary = [plain(rng.choice([5, 100, 150])) for _ in range(300)]
    model = toxicity.train(toxic[:100], ordinary[:200])
    own = b"".join(x for x, _ in model.pairs)
    assert all(w in own for w in (b"grumblewort", b"snivelcrank", b"flabberscum")) and b"grumblewort" not in model.common
    both = model.compressors()
    caught = [model.probability(model.features(toxicity.fold(t), both)) >= 0.7 for t in toxic[100:] + ordinary[200:]]
    assert sum(caught[:50]) >= 45 and sum(caught[50:]) <= 5


def test_word_memory_outlasts_tasks_and_restarts(monkeypatch):
    encoder = token_files.worker_encoder(WORDS)
    assert token_files.worker_encoder(WORDS) is encoder
    monkeypatch.setattr(token_files, "REMEMBERED", 30)
    encoder, learned = token_files.WordEncoder(WORDS), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: learned.extend(words) or learn(words))
    texts = [" ".join(["the", "sea", "extraordinarinesses", *(f"w{i}x{j}" for j in range(20))]) for i in range(6)]
    for text in texts:
        assert encoder.encode([text]) == [np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(encoder.known) <= 30
    assert learned.count("the") == learned.count("sea") == 1  # met in all texts, so kept when the memory starts anew
    assert learned.count("extraordinarinesses") == 6


def test_windows_are_compressed_only_where_a_dictionary_has_a_new_run():
    rng = random.Random(8)
    plain = lambda n: " ".join(f"{rng.choice('bcdfgh')}a{rng.choice('lmnprst')}e{rng.choice('kvz')}o" for _ in range(n))
    insults, kind = ["you grumblewort", "what a snivelcrank"], ["dear neighbour", "thank you very"]
    common = toxicity.fold(plain(2_000))
    pairs = [tuple(toxicity.fold(f"{plain(20)} {x[i]} {plain(20)} {x[i][4:]}").ljust(400) for x in (insults, kind)) for i in (0, 1)]
    model = toxicity.Model(pairs, common, np.zeros(14))
    # the runs lie at any place of a window, over its borders, and in the last, shorter windows
    texts = [toxicity.fold(f"{plain(60)} {'x' * (i % 40)} {rng.choice(insults + kind)} {plain(i % 7)}") for i in range(300)]
    pieces = [w for t in texts for w in toxicity.windows(t)] + toxicity.windows(pairs[0][0] + common[:60])
    compress = []
    for pair in pairs:
        known = [zstandard.ZstdCompressionDict(own + common, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for own in pair]
        compress.append([zstandard.ZstdCompressor(dict_data=x, compression_params=toxicity.SETTINGS).compress for x in known])
    expected = [sum(len(ordinary(w)) - len(toxic(w)) for toxic, ordinary in compress) / len(pairs) for w in pieces]
    both, calls = model.compressors(), []
    both.pairs = [tuple((lambda w, f=f: calls.append(w) or f(w)) for f in pair) for pair in both.pairs]
    assert model.evidence(pieces, both).tolist() == expected
    assert max(expected) > 3 and min(expected) < -3 and 0 < len(calls) < len(pieces)
    assert [x.tolist() for x in model.evidences([toxicity.windows(t) for t in texts[:9]], both)] == [model.evidence(toxicity.windows(t), both).tolist() for t in texts[:9]]


def test_classifiers_take_odd_texts(spark):
    docs = documents(spark, ODD)
    plain, junk = ["A quiet day by the sea. It was fine and they went home."] * 5, ["BUY!! NOW!! BUY!! NOW!!"] * 5
    for module, model in ((quality, quality.train(plain, junk, 0.5, 0.3)), (toxicity, toxicity.train(["you idiot fool idiot"] * 6, plain)), (quality, quality.train([], [], 0.0, 0.3)), (toxicity, toxicity.train([], []))):
        out = module.score(docs, model).collect()
        assert len(out) == len(ODD) and all(0 <= r[module.SCORE] <= 1 for r in out)
        assert module.score(docs.limit(0), model).count() == 0


def test_language_is_exact(spark):
    samples = {"en": ["the cat and the dog in the house"] * 3, "de": ["der Hund und die Katze im Haus"] * 3}
    model = language.train(samples)
    docs = documents(spark, [*ODD, "the dog and the cat", "die Katze und der Hund"])
    got = by_id(language.identify(docs, model))
    assert got[len(ODD)][1] == "en" and got[len(ODD) + 1][1] == "de"
    assert [got[i][1] for i in (0, 1, 2, 3, 5)] == ["und"] * 5 and got[7][1] != "und"
    assert language.identify(docs, language.train({})).collect()[0]["lang_pred"] == "und"
    # code lengths against the definition
    text = "Die ÉTÉ katze 日 zz"
    data = language.fold(np.frombuffer(text.encode(), np.uint8))
    bits = language.Lengths(model.trees)(language.sequences(data, np.array([0, len(data)]))).sum(axis=0)
    for tree, found in zip(model.trees, bits, strict=True):
        counts = [dict(zip(g.tolist(), c.tolist(), strict=True)) for g, c in zip(tree.grams, tree.counts, strict=True)]
        follow = [collections.defaultdict(list) for _ in counts]
        for k, c in enumerate(counts):
            for g, n in c.items():
                follow[k][g >> 8].append(n)
        padded, total = b" " * language.ORDER + data.tobytes(), 0.0
        for i in range(language.ORDER, len(padded)):
            for k in range(language.ORDER, -1, -1):
                context = int.from_bytes(padded[i - k : i], "big")
                if context in follow[k]:
                    whole = sum(follow[k][context]) + len(follow[k][context])
                    if (context << 8 | padded[i]) in counts[k]:
                        total -= np.log2(counts[k][context << 8 | padded[i]] / whole)
                        break
                    total -= np.log2(len(follow[k][context]) / whole)
            else:
                total += 8
        assert found == pytest.approx(total, rel=1e-5)


def test_language_needs_a_letter(spark):
    model = language.train({"en": ["the cat"] * 3})
    signs = ["½ ²", "①", "١٢٣", "Ⅷ 四"[:1], "12 3.", "_ __", "\u0301", "日"]
    got = by_id(language.identify(documents(spark, signs), model))
    assert [got[i][1] for i in range(len(signs))] == ["und"] * 7 + ["en"]
    assert language.identify(documents(spark, signs).limit(0), model).count() == 0


def test_samples_keep_their_bound(spark):
    docs = documents(spark, [f"text {i}" for i in range(500)] + ["same"] * 500 + ["other", None], [3] * 500 + [5] * 500 + [7, 9])
    labels = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in (3, 5, 7, 9)], "doc_id long, label string")
    found, counts = sampling.labelled(docs, labels, 10)
    assert counts == {"a": 2, "b": 2} and len(found["a"]) <= 10 and found["b"] == ["other"]
    again, _ = sampling.labelled(docs.repartition(7), labels, 10)
    assert again == found
    model = quality.fitted(docs, labels.select("doc_id", (labels["label"] == "a").cast("int").alias("label")), 0.3)
    assert quality.score(docs, model).count() == 1002
    assert sampling.labelled(docs, labels.limit(0), 10) == ({}, {})


@pytest.mark.parametrize("name", ["op1_quality", "op2_toxicity", "op4_language", "op9_sentence_pieces", "op6_license_scan", "op5_token_files"])
def test_empty_tables_and_repeated_rows(spark, tmp_path, name):
    folder = f"file://{tmp_path}"
    docs = table(spark, "documents")
    odd = spark.createDataFrame([(None, "no id"), (10**9, None), (10**9, "")], "doc_id long, text string")
    for at, (some, marks) in enumerate([(docs.limit(0), table(spark, "labels").limit(0)), (docs.unionByName(docs.limit(20)).unionByName(odd, allowMissingColumns=True), table(spark, "labels"))]):
        some.withColumn("score", F.lit("clash")).write.parquet(f"{folder}/{at}/documents.parquet")
        marks.write.parquet(f"{folder}/{at}/labels.parquet")
        out = queries.queries()[name](spark, f"{folder}/{at}").collect()
        assert len(out) == some.count()
    if name != "op5_token_files":  # there a start differs
        seen = {}
        for r in out:
            if r["doc_id"] is not None and r["doc_id"] < 10**9:
                assert seen.setdefault(r["doc_id"], r) == r


# --- 3: near duplicates ---------------------------------------------------------------------------------------------
def shingled(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes())
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter({("text", text): 1})


def classes_by_force(rows):
    sets = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((sets[i] & sets[j]).values())
            if rows[i][1] is not None and rows[j][1] is not None and shared >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - shared) > 0:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {d: (min(c), len(c)) for c in least.values() for d in c}


def edited(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(" ".join(own))
    return out


def test_near_duplicates(spark):
    texts = [*edited(1, 110), *ODD, "a b c", "A  b, c!", None, "", "", "??", *["q r " * 200] * 2, "q r " * 190]
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    assert {k: v[1:] for k, v in by_id(neardup.duplicates(docs)).items()} == classes_by_force(sorted(rows))
    kept = neardup.deduplicated(docs)
    want = {c for c, _ in classes_by_force(sorted(rows)).values()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    assert neardup.duplicates(docs.limit(0)).count() == 0


def crowd(seed, n, planted):
    """Texts of one template a little below the threshold to each other, and for some a text a little above it to them alone."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(600)]

    def changed(words, k, name):
        spots = set(rng.sample(range(0, 600, 5), k))
        return [f"{name}.{i}" if i in spots else w for i, w in enumerate(words)]

    out = [changed(base, 9, f"b{d}") for d in range(n)]
    return [" ".join(x) for x in out + [changed(out[d], 12, f"c{d}") for d in range(planted)]]


@pytest.mark.parametrize("block", [neardup.BLOCK, 20])
def test_near_duplicates_in_a_crowd(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = crowd(3, 300, 80)
    rows = list(enumerate(texts))
    want = classes_by_force(rows)
    assert len(set(want.values())) > 100
    assert {k: v[1:] for k, v in by_id(neardup.duplicates(documents(spark, texts))).items()} == want


def test_repeated_ids_keep_apart(spark):
    docs = documents(spark, ["one two three four five six"] * 2 + ["quite another text that is here now", None], [1, 1, 1, None])
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"]) for r in neardup.duplicates(docs).collect()) == [(0, 0, 1), (1, 1, 1), (1, 1, 2), (1, 1, 2)]
    assert neardup.deduplicated(docs).count() == 3


def test_signatures_estimate_weighted_similarity():
    texts = pa.array(edited(3, 8) + ["p q r s t " * 30, "p q r s t " * 25])
    words = neardup.tokenize(*neardup.texts(texts), neardup.ALNUM, neardup.LOWER)
    found = neardup.signatures(*neardup.shingles(words), len(texts), 4000)
    for i, j in ((0, 1), (2, 5), (8, 9), (0, 9)):
        exact = neardup.similarity(texts.take(pa.array([i])), texts.take(pa.array([j])))[0]
        assert (found[i] == found[j]).mean() == pytest.approx(exact, abs=0.05)


# --- 5, 9: tokens ---------------------------------------------------------------------------------------------------
def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer, base = Tokenizer.from_file(WORDS), 0
    docs = documents(spark, [*ODD, "Straße ÉTÉ, abc. Don't!! x,y"])
    got = by_id(token_files.round_trip(docs, WORDS, 2))
    for i, text in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        base += len(ids)
    assert token_files.round_trip(docs.limit(0), WORDS, 2).count() == 0


def test_token_files_of_a_whole_table(spark, monkeypatch):
    """The registered query over all documents, against the library text by text; small files, no shortcuts."""
    from tokenizers import Tokenizer

    for name, value in (("FILE_DOCS", 7), ("RUN", 3), ("CHUNK", 50), ("REMEMBERED", 100)):
        monkeypatch.setattr(token_files, name, value)
    tokenizer, base = Tokenizer.from_file(WORDS), 0
    got = by_id(queries.op5_token_files(spark, SMALL))
    for i, text in sorted(rows_of(table(spark, "documents"))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        base += len(ids)


def test_token_files_of_odd_ids(spark):
    docs = documents(spark, ["one two", None, "three <|endoftext|> a<b", "x"], [None, -(2**63), 2**63 - 1, -(2**63)])
    got = sorted(map(tuple, token_files.round_trip(docs, WORDS, 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, -(2**63), -(2**63), 2**63 - 1]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_elias_fano():
    rng = np.random.default_rng(5)
    for values in (np.cumsum(rng.integers(0, 900, 1000)), np.zeros(10, np.int64), np.array([0]), np.array([0, 10**12]), np.cumsum(rng.integers(0, 2, 500))):
        code = token_files.EliasFano.of(values)
        n = len(values)
        assert code.range(0, n).tolist() == values.tolist() == [code.select(i) for i in range(n)]
        for a, b in ((0, 0), (0, 1), (n // 3, n // 2), (63, 65), (64, 128), (n - 1, n)):
            assert code.range(min(a, n), min(b, n)).tolist() == values[a:b].tolist()
    dense = token_files.EliasFano.of(np.cumsum(rng.integers(200, 400, 10_000)))
    assert (len(dense.low) + len(dense.high)) * 8 / 10_000 < 2 + np.log2(400) + 1


def test_one_document_is_found(spark, tmp_path):
    docs = documents(spark, ["first text", "second one", "third"])
    files = sorted(r["uri"] for r in token_files.write(docs, WORDS, 2, f"file://{tmp_path}").collect())
    found = {}
    for uri in files:
        reader = token_files.Reader(uri)
        found |= {int(d): reader.document(i).tolist() for i, d in enumerate(reader.doc_ids)}
    from tokenizers import Tokenizer

    assert found[1] == [*Tokenizer.from_file(WORDS).encode("second one", add_special_tokens=False).ids, 2]


def test_sentence_pieces(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark, ODD)
    got, spans = by_id(sentence_pieces.digests(docs, PIECES)), {r["doc_id"]: r for r in sentence_pieces.encode(docs, PIECES).collect()}
    for i, text in rows_of(docs):
        ids = library.encode(text or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode()))
        raw = (text or "").encode()
        row = spans[i]
        assert row["ids"] == ids and b"".join(raw[a:b] for a, b in zip(row["starts"], row["ends"], strict=True)) == raw
        for piece, a, b in zip(ids, row["starts"], row["ends"], strict=False):
            name = library.id_to_piece(piece)
            if not library.is_byte(piece):
                assert raw[a:b].decode().replace(" ", "▁") in (name, name[1:])


def test_character_map():
    """A hand-made double array: "ab" becomes "x", "a" becomes "yy"."""
    units = [0] * 1024
    at = lambda offset: offset << 10
    units[0] = at(256)
    a = 256 ^ ord("a")
    units[a] = at(512) | 1 << 8 | ord("a")
    leaf_a = a ^ 512
    units[leaf_a] = 1 << 31 | 0
    b = a ^ 512 ^ ord("b")
    units[b] = at(64) | 1 << 8 | ord("b")
    units[b ^ 64] = 1 << 31 | 3
    blob = np.array(units, "<u4").tobytes()
    found = sentence_pieces.CharacterMap(len(blob).to_bytes(4, "little") + blob + b"yy\0x\0")
    assert found.longest(b"abc", 0) == (2, b"x") and found.longest(b"ac", 0) == (1, b"yy") and found.longest(b"ca", 0) == (0, b"")
    model = sentence_pieces.Model(PIECES)
    model.map, model.squeeze = found, True
    normal, origin = model.normalize("  abc  a ")
    assert normal.decode() == "▁xc▁yy"
    assert origin.tolist() == [2, 2, 2, 2, 4, 5, 5, 5, 7, 7, 8]


def with_map(rules, prefix, squeeze):
    """The public model with a character map of its own (a double array in blocks of 256 units) and other settings."""
    trie = {}
    for source, target in rules.items():
        node = trie
        for byte in source.encode():
            node = node.setdefault(byte, {})
        node[None] = target
    units, texts, todo = [0] * 256, b"", [(trie, 0, None)]
    while todo:
        node, place, label = todo.pop()
        base = len(units)
        units += [1] * 256  # no byte has this label in these blocks
        units[place] = (place ^ base) << 10 | (1 << 8 if None in node else 0) | (label or 0)
        if None in node:
            units[base] = 1 << 31 | len(texts)
            texts += node[None].encode() + b"\0"
        todo += [(child, base + byte, byte) for byte, child in node.items() if byte is not None]
    array = np.array(units, "<u4").tobytes()
    varint = lambda n: bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
    field = lambda number, data: varint(number << 3 | 2) + varint(len(data)) + data
    normalizer = field(2, len(array).to_bytes(4, "little") + array + texts) + b"".join(varint(k << 3) + varint(int(v)) for k, v in ((3, prefix), (4, squeeze), (5, True)))
    out = b""
    for number, value in sentence_pieces._fields(open(PIECES, "rb").read()):
        out += field(number, normalizer if number == 3 else value)
    return out


@pytest.mark.parametrize("prefix,squeeze", [(True, True), (True, False), (False, True), (False, False)])
def test_alignment_through_a_character_map(spark, tmp_path, prefix, squeeze):
    import sentencepiece

    rules = {"ab": "x", "a": "yy", "abcd": "q r", "é": "e", "ﬁ": "fi", "\t": " ", "\n": " ", "日本": "J", "日": "", "z": "", "É": "é"}
    path = tmp_path / "own.model"
    path.write_bytes(with_map(rules, prefix, squeeze))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [t or "" for t in ODD] + ["  abc  abcd abcab\t\tﬁn é É 日本日 語 zz z", "z", " z ", "a" * 300, "\t", "tail z  "]
    model = sentence_pieces.Model(str(path))
    for text in texts:
        normal, origin = model.normalize(text)
        want, offsets = library.Normalize(text, with_offsets=True)
        assert normal.decode() == want
        char = {b: i for i, b in enumerate(np.cumsum([0, *[len(c.encode()) for c in text]]).tolist())}
        heads = [i for i, b in enumerate(normal) if b & 0xC0 != 0x80]
        if text:
            assert [char[int(origin[i])] for i in heads] == offsets[:-1]
    got = {r["doc_id"]: r for r in sentence_pieces.encode(documents(spark, texts), str(path)).collect()}
    for i, text in enumerate(texts):
        assert got[i]["ids"] == library.encode(text, add_eos=True)
        raw = text.encode()
        for piece, a, b in zip(got[i]["ids"], got[i]["starts"], got[i]["ends"], strict=False):
            # what the span holds normalises to the piece, but for marks
            if not library.is_byte(piece) and not library.is_unknown(piece):
                assert 0 <= a <= b <= len(raw)
        assert all(x <= y for x, y in zip(got[i]["ends"], got[i]["starts"][1:], strict=False))


def test_sentence_pieces_of_a_whole_table(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(queries.op9_sentence_pieces(spark, SMALL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in rows_of(table(spark, "documents")):
        ids = library.encode(text or "", add_eos=True)
        assert got[i] == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode()))


# --- 6: licences ----------------------------------------------------------------------------------------------------
def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    varied = "Copyright (c) 2020 Some One\n" + mit.upper().replace(",", " ,").replace("LICENSE", "LICENCE", 1) + "\n"
    texts = [varied, mit + " more", "text\nReleased under the MIT Licence\nLicensed under CC BY 4.0!\nLicensed under CC BY 4.0.", None, "", "no permission at all"]
    got = by_id(licenses.scan(documents(spark, [*texts, *ODD])))
    assert got[0][1:] == ("MIT", 1, True) or got[0][1:] == ("MIT", 0, True)
    assert got[1][1:] == ("", 0, False) and got[2][1:] == ("CC-BY-4.0,MIT", 3, False)
    assert all(got[i][1:] == ("", 0, False) for i in range(3, len(texts) + len(ODD)))
    assert all(re.search(licenses.TRIGGER, text.lower()) for _, text in licenses.KNOWN)
    assert len(licenses.scan(documents(spark, ["x"] * 2, [1, 1])).collect()) == 2


def test_words_that_the_canonical_form_joins(spark):
    texts = ["Released under the MIT Licall rights reservedense.", "Released under the MIT Lichttp://ense.", "Released under the MIT Li cense.", None]
    assert [x[1:3] for _, x in sorted(by_id(licenses.scan(documents(spark, texts))).items())] == [("MIT", 1), ("MIT", 1), ("", 0), ("", 0)]


def test_licenses_of_a_given_table(spark):
    known = spark.createDataFrame([("GPL-2.0", "GNU General Public License,\nversion 2"), ("Own", "Free to use."), ("None", " ")], "license string, text string")
    texts = ["gnu general public license version 2", "a\nFREE to use\n\nReleased under the MIT License", " ", None]
    assert [x[1:] for _, x in sorted(by_id(licenses.scan(documents(spark, texts), known)).items())] == [("GPL-2.0", 1, True), ("Own", 1, False), ("", 0, False), ("", 0, False)]


# --- 7: repeated passages -------------------------------------------------------------------------------------------
def removed_by_force(rows):
    window, first, split = substrings.WINDOW, {}, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    key = lambda d: 2**63 if d is None else d
    for d, t in rows:
        words = split(t)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, 2**64), key(d))
    out = []
    for d, t in rows:
        words = split(t)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < key(d):
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((d, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,grams", [(substrings.HOT, substrings.GRAMS), (3, substrings.GRAMS), (1, (2, 4, 50))])
def test_repeated_passages(spark, monkeypatch, hot, grams):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "GRAMS", grams)
    texts = passages(5) + ODD
    texts += [texts[3], texts[3], texts[7]]
    ids = [i if i % 4 else 7 for i in range(len(texts) - 1)] + [None]
    docs = documents(spark, texts, ids)
    assert sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str) == removed_by_force(rows_of(docs))


@pytest.mark.parametrize("n", [126, 127, 130, 150, 199])
def test_a_shard_finds_long_passages_whole(n):
    shared = " ".join(f"w{i}" for i in range(n))
    words = pa.array([shared, f"x {shared} y", f"z {shared}"])
    runs = substrings.search_shard(np.array([4, 2, 9]), np.array([1, 1, 1]), words).to_pylist()
    assert runs[0] == [{"start": 0, "size": n - 49, "owner": 2}] and runs[1] == [] and runs[2] == [{"start": 1, "size": n - 49, "owner": 2}]


def test_passages_beyond_the_order_of_suffixes(spark):
    """Lines that come again every 40 words keep one anchor over long stretches, which documents share."""
    rng = random.Random(12)
    line = [f"line{i}" for i in range(12)]

    def stretch(k):
        return [w for _ in range(k) for w in [*line, *(f"v{rng.randrange(10**6)}" for _ in range(28))]]

    shared = [stretch(k) for k in (4, 5, 12)] + [[f"u{i}" for i in range(199)]]
    texts = [" ".join([*stretch(rng.randrange(3)), *rng.choice(shared), *(f"t{rng.randrange(9)}" for _ in range(rng.randrange(60)))]) for _ in range(40)]
    docs = documents(spark, texts)
    assert sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str) == removed_by_force(rows_of(docs))


def test_words_of_one_pattern_are_not_confused(spark):
    a, b = (x for x in complements(1024))
    start = " ".join(f"w{i}" for i in range(49))
    docs = documents(spark, [f"{start} {a}", f"{start} {b}", " ".join(a), " ".join(b), f"x {start} {a}"])
    got = [r["n_removed"] for r in sorted(substrings.digests(docs).collect())]
    assert got == [r[2] for r in sorted(removed_by_force(rows_of(docs)))] and got[:2] == [0, 0]
    assert {k: v[1:] for k, v in by_id(neardup.duplicates(docs)).items()} == classes_by_force(sorted(rows_of(docs)))


def test_passages_of_repeated_rows(spark):
    rng = random.Random(8)
    some = lambda k: " ".join(rng.choices([f"w{i}" for i in range(900)], k=k))
    shared = some(70)
    texts = [f"{some(20)} {shared} {some(30)}"] * 50 + [f"{some(10)} {shared}"] * 50
    docs = documents(spark, texts, [4] * 50 + [9] * 50)
    assert sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str) == removed_by_force(rows_of(docs))


def test_cleaned_texts(spark):
    texts = passages(9, 40) + ODD
    docs = documents(spark, texts)
    out = substrings.cleaned(docs)
    assert out.columns == docs.columns
    want = {d: n for d, n, gone, _ in removed_by_force(rows_of(docs)) if not (gone and gone == n)}
    got = {r["doc_id"]: r for r in out.collect()}
    assert got.keys() == want.keys()
    for d, _, gone, sha in removed_by_force(rows_of(docs)):
        if d in got:
            text = got[d]["text"]
            assert text == texts[d] if not gone else hashlib.sha256(text.encode()).hexdigest() == sha
    assert substrings.digests(docs.limit(0)).count() == 0


# --- 8: decontamination ---------------------------------------------------------------------------------------------
def hits_by_force(docs, items, n=decontaminate.WINDOW):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOWER[np.frombuffer((t or "").encode(), np.uint8)].tobytes())
    windows = collections.defaultdict(set)
    for i, t in items:
        words = split(t)
        size = min(n, len(words))
        for s in range(len(words) - size + 1) if size else ():
            windows[tuple(words[s : s + size])].add(str(i))
    out = {}
    for d, t in docs:
        words, hit, found = split(t), set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(words) - size + 1):
                if own := windows.get(tuple(words[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= own
        out[d] = (d, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("bits", [decontaminate.BITS, 1 << 15])
def test_decontamination(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS", bits)
    rng = random.Random(1)
    some = lambda sizes: " ".join(rng.choices("a b c dé E".split(), k=rng.choice(sizes)))
    docs = documents(spark, [some([0, 1, 5, 12, 40, 300]) for _ in range(60)] + ODD)
    items = [(i, some([0, 1, 2, 3, 5, 9, 10, 11, 30])) for i in range(25)] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = hits_by_force(rows_of(docs), items)
    assert by_id(decontaminate.decontaminate(docs, bench)) == want
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, cleaned=True).collect()} == {d for d, w in want.items() if not w[-1]}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_items_without_an_id_count_as_hits(spark):
    words = " ".join(f"word{i}" for i in range(12))
    bench = spark.createDataFrame([(None, words), (7, "other words")], "item_id long, text string")
    docs = documents(spark, [f"before {words} after", "nothing here", f"other words {words}"])
    out = {d: x for d, (_, _, *x) in by_id(decontaminate.decontaminate(docs, bench)).items()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    assert out == {0: [12, 0, digest(b""), True], 1: [0, 0, digest(b""), False], 2: [14, 1, digest(b"7"), True]}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench, cleaned=True).collect()] == [1]


def test_every_shared_span_is_found(spark):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    want = hits_by_force(rows_of(docs), [(r["item_id"], r["text"]) for r in bench.collect()])
    assert by_id(decontaminate.decontaminate(docs, bench)) == want


# --- 10: search -----------------------------------------------------------------------------------------------------
def best_by_force(rows, k, every):
    usable = [(i, [math.floor(fractions.Fraction(float(x)) * 256) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1), i) for i, b in usable if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def searched(spark, rows, every=50):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, block int")
    return sorted(map(tuple, exact_topk.search(df, F.col("vec_id") % every == 0, 5).collect()))


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 64)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 1.0, 1.0] if i % 2 else (rng.integers(-3, 4, 3) / 256).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [float("nan"), 1.0, 2.0]), (1002, [None, 1.0, 1.0]), (1003, [float("inf"), 1.0, 1.0]), (1050, []), (1051, []), (1100, [5.0])]
    assert searched(spark, rows) == best_by_force(rows, 5, 50)
    assert searched(spark, []) == []


def test_search_of_wide_components(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 4)
    wide = [1e30, -1e30, 1e308, -1e308, 2.0**44, 2.0**53 + 2, 3e9, 0.1, -0.0, 5e-324, 1e17, -1e17]
    rng = random.Random(3)
    rows = [(i, [rng.choice(wide), rng.choice(wide)]) for i in range(60)] + [(100 + i, [rng.choice(wide[4:8]), 0.5]) for i in range(20)]
    assert searched(spark, rows, 10) == best_by_force(rows, 5, 10)


def test_search_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 4)
    rows = [(0, [1.0, 0.0])] * 3 + [(0, [0.0, 1.0])] + [(7, [2.0, 1.0])] * 40 + [(8, [2.0, 1.0])] * 2 + [(9, [0.0, 9.0])] * 2 + [(i, [0.1 * i, 1.0]) for i in range(10, 40)]
    assert searched(spark, rows) == best_by_force(rows, 5, 50)


# --- very long texts ------------------------------------------------------------------------------------------------
def test_a_very_long_text():
    """16 MB in one row: work in pieces gives what work at once gives, and no operator is quadratic."""
    rng = random.Random(12)
    line = " ".join(rng.choices([f"word{i}" for i in range(5000)] + ["idiot", "BUY!!", "das", "the"], k=4000)) + "\n"
    text = line * (16_000_000 // len(line))
    column = pa.array([text])
    words = substrings.tokenize(*substrings.texts(column), substrings.SPACED)
    assert words.counts[0] == len(text.split())
    assert np.isfinite(quality.features(column)).all()
    model = toxicity.Model([(b"idiot", b"other")], b"word", np.zeros(14))
    both = model.compressors()
    data = toxicity.fold(line * 200)
    assert model.features(data, both).tolist() == toxicity.summary(model.evidence(toxicity.windows(data), both)).tolist()
    trees = language.train({"en": ["the word"], "de": ["das Wort"]})
    assert language.predict(column, trees, language.Lengths(trees.trees))[0][0] in ("en", "de")
    alnum = neardup.tokenize(*neardup.texts(column), neardup.ALNUM, LOWER)
    shingles = neardup.shingles(alnum)
    found = neardup.signatures(*shingles, 1, 120)
    assert (found != 0).all()
    starts, _ = decontaminate.windows(alnum, 10, 5)
    assert len(starts) == alnum.counts[0] - 9


def test_darts_in_pieces_are_the_same(monkeypatch):
    words = neardup.tokenize(*neardup.texts(pa.array([*edited(4, 5), "p q r s t " * 90])), neardup.ALNUM, LOWER)
    whole = neardup.signatures(*neardup.shingles(words), 6, 120)
    monkeypatch.setattr(neardup, "HELD", 7)
    assert (neardup.signatures(*neardup.shingles(words), 6, 120) == whole).all()
