"""Small documents with what real ones have: copies, passages, odd texts, nulls, repeated ids, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, id long, hash long"


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None if n % 5 == 0 else "en", "s", len(t) if t is not None else None, None, 0.5, 7, 8) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", " ", "\n\n", "a", "!!! ???", "É", "日本語 テキスト", "x" * 3000, "a " * 4000, "\x00 b", "ends with space ", "  two  spaces", "▁ mark ▁▁", "𝔘𝔫𝔦 é́ ﬁ", "Σίσυφος ΣΑΣ İx", "don't we'll 12 345", "<|endoftext|> <s> </s>"]


def passages(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [some(80) for _ in range(4)] + [["a"] * 200, ["a", "b"] * 100, some(49), some(50), some(51)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.choice([0, 1, 2, 3])):
            p = list(rng.choice(shared))[rng.choice([0, 0, 5, 20]) :]
            if rng.random() < 0.4 and p:
                p[rng.randrange(len(p))] = f"edit{rng.randrange(3)}"
            words += some(rng.choice([0, 1, 10, 60])) + p
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return out
