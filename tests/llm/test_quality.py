import math
import random
import zlib

import numpy as np

from sonoshelf.llm import quality


def _texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["on", "ti", "ea", "ou", "st"]) for _ in range(r.randint(1, 4)))
    good = [" ".join(word() for _ in range(r.randint(20, 80))).capitalize() + "." for _ in range(n)]
    kinds = [lambda: " ".join(word().upper() + "!!" for _ in range(40)), lambda: " ".join([word()] * 40), lambda: " ".join(word() + "###" for _ in range(40))]
    bad = [r.choice(kinds)() for _ in range(n)]
    return good, bad


def test_held_out_rows_are_told_apart(spark):
    good, bad = _texts(1, 240)
    rows = [(i, t, "en", 1 if i % 2 else 0) for i, t in enumerate(x for p in zip(bad, good, strict=True) for x in p)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows] + [(None, 1), (9999, None)], "doc_id long, quality int")
    w = quality.fit(docs, labels)
    assert np.array_equal(w, quality.fit(docs, labels))
    got = {r.doc_id: r for r in quality.classify(docs, w).collect()}
    held = [(i, q) for i, _, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    kept = quality.keep_good(docs, w)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_sample_is_bounded_and_ignores_labels_held_out(spark):
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) as quality")
    assert np.array_equal(quality.fit(docs, labels, 20), quality.fit(docs, flipped, 20))


def test_empty_texts_and_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 50_000), (3, "a " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    w = quality.fit(docs, none)
    assert [r.score for r in quality.classify(docs, w).collect()] == [0.5] * 4
    assert quality.classify(docs.limit(0), w).collect() == []


def plain_features(text):
    """Shares of the places of a text's n-grams, word by word."""
    mixed = lambda x: (x * 0x9E3779B97F4A7C15 % 2**64) >> 46
    counts, before, words = {}, (7, 7), (text or "").encode().split()
    for k, raw in enumerate(words):
        w = raw.decode()
        letters = "".join(c for c in w if c.isalpha())
        case = ("u" if len(letters) > 1 and letters.isupper() else "l" if letters.islower() else "c") if letters else "-"
        marks = "".join("0" if c.isdigit() else c for c in w if c.isdigit() or not c.isalnum())
        word, form = zlib.crc32(raw), zlib.crc32(f"{case}{1 if letters else 0}{marks[:4]}".encode(), 1) + (k > 0 and raw == words[k - 1])
        for place in (mixed(word), mixed(form * 3 + 1), mixed((before[0] * 1_000_003 + word) % 2**64), mixed((before[1] * 998_244_353 + form) % 2**64)):
            counts[place] = counts.get(place, 0) + 1
        before = word, form
    n = sum(counts.values())
    return {p: quality.SCALE * c / n for p, c in counts.items()}


def plain_ftrl(rows):
    """Weights by place after FTRL-proximal updates, coordinate by coordinate; the bias is None."""
    z, n = {}, {}

    def weight(p):
        a = z.get(p, 0.0)
        return 0.0 if abs(a) <= quality.L1 else -(a - math.copysign(quality.L1, a)) / ((quality.BETA + math.sqrt(n.get(p, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for text, y in rows:
            x = plain_features(text) | {None: 1.0}
            w = {p: weight(p) for p in x}
            miss = 1 / (1 + math.exp(-sum(w[p] * x[p] for p in x))) - y
            for p, v in x.items():
                g, old = miss * v, n.get(p, 0.0)
                z[p] = z.get(p, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w[p]
                n[p] = old + g * g
    return {p: weight(p) for p in z}


def test_weights_and_scores_are_those_of_plain_updates(spark):
    good, bad = _texts(5, 30)
    texts = [t for pair in zip(bad, good, strict=True) for t in pair] + ["", "12 12 ab! ÄÖ x", "word"]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)] + [(0, "!", "x", 7)], "doc_id long, text string, label string, h int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    chosen = sorted(((r.h, texts[r.doc_id], r.doc_id % 2) for r in labels.selectExpr("doc_id", "xxhash64(doc_id) as h").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2))
    w, want = quality.fit(docs, labels), plain_ftrl([(t, y) for _, t, y in chosen])
    assert {p for p in range(quality.PLACES) if w[p]} == {p for p, v in want.items() if v and p is not None}
    assert all(math.isclose(w[quality.PLACES if p is None else p], v, rel_tol=1e-4, abs_tol=1e-6) for p, v in want.items())
    got = {(r.doc_id): r.score for r in quality.classify(docs.where("text <> '!'"), w).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i], 1 / (1 + math.exp(-sum(want.get(p, 0.0) * v for p, v in plain_features(t).items()) - want[None])), rel_tol=1e-4)


def test_rows_that_repeat_an_id_dont_make_the_sample_larger(spark):
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(20)] + [(1, f"more{k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    single = docs.groupBy("doc_id").agg({"text": "max"}).withColumnRenamed("max(text)", "text")
    assert np.array_equal(quality.fit(docs, labels, 10), quality.fit(single, labels, 10))
