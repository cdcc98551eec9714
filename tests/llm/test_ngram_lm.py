import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sonoshelf.llm import ngram_lm
from sonoshelf.llm.elias_fano import EliasFano, pack, unpack


def brute(rows):
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b"\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            x = tokens(t)
            one.update(x)
            two.update(zip([b"", *x], x, strict=False))
    n, v = sum(one.values()), len(one)
    context, kinds = Counter(), Counter()
    for (a, _), c in two.items():
        context[a] += c
        kinds[a] += 1
    uni = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    out = {}
    for i, t in rows:
        x, s = tokens(t), 0.0
        for a, w in zip([b"", *x], x, strict=False):
            p = uni(w)
            if context[a]:
                p = (max(two[a, w] - 0.75, 0) + 0.75 * kinds[a] * p) / context[a]
            s += math.log10(p)
        out[i] = (held(i), len(x), sum(one[w] > 0 for w in x), n, sum(math.log10(uni(w)) for w in x), s)
    return out


def brute_order(rows, order, cutoff):
    """log10 scores of every text by an order and a cut-off, over tuples of words."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = {i: [b"", *re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b"\n"] for i, t in rows}
    one, grams = Counter(), {k: Counter() for k in range(2, order + 1)}
    for i, _ in rows:
        if not held(i):
            x = texts[i]
            one.update(x[1:])
            for k in grams:
                grams[k].update(tuple(x[j - k + 1 : j + 1]) for j in range(k - 1, len(x)))
    for k in range(3, order + 1):
        grams[k] = Counter({g: c for g, c in grams[k].items() if c >= cutoff})
    count, kinds = Counter(), Counter()
    for g, c in ((g, c) for x in grams.values() for g, c in x.items()):
        count[g[:-1]] += c
        kinds[g[:-1]] += 1
    n, v, out = sum(one.values()), len(one), {}
    for i, x in texts.items():
        s = 0.0
        for j in range(1, len(x)):
            p = (one[x[j]] + 0.1) / (n + 0.1 * (v + 1))
            for k in range(2, order + 1):
                g = tuple(x[j - k + 1 : j + 1]) if j - k + 1 >= 0 else None
                if g and count[g[:-1]]:
                    p = (max(grams[k][g] - 0.75, 0) + 0.75 * kinds[g[:-1]] * p) / count[g[:-1]]
            s += math.log10(p)
        out[i] = s
    return out


@pytest.mark.parametrize(("order", "cutoff"), [(3, 1), (4, 2)])
def test_higher_orders_are_those_of_brute_force(spark, monkeypatch, order, cutoff):
    monkeypatch.setattr(ngram_lm, "TOKENS_A_SHARD", 400)
    monkeypatch.setattr(ngram_lm, "TOKENS_A_BATCH", 300)
    rows = rows_of(5) + [(300 + k, "the same five words again and again") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_order(rows, order, cutoff)
    got = {r.doc_id: (r.score, r.n_tokens) for r in ngram_lm.score_held_out(docs, order=order, cutoff=cutoff).collect()}
    assert got.keys() == want.keys()
    assert all(abs(s - want[i]) <= n * ngram_lm.CODE_STEP * order + 1e-6 for i, (s, n) in got.items())


def rows_of(seed):
    r = random.Random(seed)
    words = [f"W{i % 50}x{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(300)], k=r.randint(0, 60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "\t new\x0bUNSEEN é x "), (203, "the " * 40_000), (204, "same"), (205, "same")]


def test_scores_are_those_of_brute_force(spark, monkeypatch):
    for shard, batch in ((4_000_000, 1_500_000), (300, 200)):
        monkeypatch.setattr(ngram_lm, "TOKENS_A_SHARD", shard)
        monkeypatch.setattr(ngram_lm, "TOKENS_A_BATCH", batch)
        rows = rows_of(batch)
        docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, tokens string, score double")
        want = brute(rows)
        for r in ngram_lm.score_held_out(docs).collect():
            held, n, known, train, base, score = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
            assert math.isclose(r.base_score, base, rel_tol=1e-9)
            assert abs(r.score - score) <= n * ngram_lm.CODE_STEP / 2 + 1e-6


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b") for i in range(1, 30)] + [(50, "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_lm.build(docs)
    a = ngram_lm._hash([b"a"])[0]
    words = np.append(ngram_lm._hash([b"a", b"b", b"c", ngram_lm.END]), np.uint64(12345))
    seen = model.codes(np.full(5, a), words)
    count, kinds = model.counts(np.array([a]))
    base = model.unigram(model.counts(ngram_lm._as_end(words))[0])
    p = np.where(seen >= 0, 10.0 ** (-seen * ngram_lm.CODE_STEP), 0.75 * kinds[0] / count[0] * base)
    assert abs(p.sum() - 1) < 1e-3


def test_empty_table_and_no_training_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.score_held_out(none).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = ngram_lm.score_held_out(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    (r,) = ngram_lm.score_held_out(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert r.n_tokens == 3


def test_sequences_find_what_they_hold():
    r = np.random.default_rng(0)
    for n, bits in ((0, 20), (1, 56), (1000, 12), (5000, 54), (3, 1)):
        v = np.unique(r.integers(0, 1 << bits, n, np.uint64))
        e = EliasFano(EliasFano.build(v, bits, "x"), "x")
        assert np.array_equal(e.get(np.arange(len(v))), v)
        x = np.concatenate([v, r.integers(0, 1 << bits, 200, np.uint64)])
        want = np.where(np.isin(x, v), np.searchsorted(v, x), -1)
        assert np.array_equal(e.find(x), want)
    for bits in (1, 7, 33, 56):
        v = r.integers(0, 1 << bits, 777, np.uint64)
        assert np.array_equal(unpack(pack(v, bits), bits, np.arange(777)), v)
