import random

import numpy as np
import pytest

from sonoshelf.llm import jaccard_join
from sonoshelf.llm.components import components


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(grams(t), []).append(i)
    keys = list(sets)
    links = {k: set() for k in keys}
    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if keys[a] and keys[b] and 5 * both >= 4 * len(keys[a] | keys[b]):
                links[keys[a]].add(keys[b])
                links[keys[b]].add(keys[a])
    group = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        group[k] = min(min(i for i in sets[x] if i is not None) for x in seen)
    return sorted((i, min(j for j in sets[grams(t)] if j is not None), len(links[grams(t)]), group[grams(t)]) for i, t in rows)


def corpus(seed, n=120, words=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], [" ".join(r.choices(vocab, k=r.randint(1, words))) for _ in range(n)]
    for t in base:
        rows.append(t)
        if r.random() < 0.4:
            for _ in range(r.randint(1, 4)):
                w = t.split()
                w[r.randrange(len(w))] = r.choice(vocab)
                rows.append(" ".join(w))
        if r.random() < 0.2:
            rows += [t.upper()] * 2
    passage = " ".join(r.choices(vocab, k=40))
    rows += [passage + " " + " ".join(r.choices(vocab, k=k)) for k in range(1, 14)]
    rows += ["", None, "  ", "one", "One", "one two", "x" * 30_000, "y " * 20_000]
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bucket", [512, 4])
def test_links_and_groups_are_those_of_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    rows = corpus(bucket)
    docs = spark.createDataFrame([(i, t, i, 0) for i, t in rows], "doc_id long, text string, node long, size int")
    got = [(r.doc_id, r.class_id, r.n_links, r.group_id) for r in jaccard_join.join_similar(docs).collect()]
    assert sorted(got) == brute(rows)
    clash = docs.withColumnsRenamed({"size": "_gone"}).withColumn("_node", docs.node)
    kept = jaccard_join.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for *_, g in got})


def test_nulls_repeated_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "solo")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.group_id) for r in jaccard_join.join_similar(docs).collect()), key=repr)
    assert got == [(7, 7, 0, 7), (7, 7, 0, 7), (None, 7, 0, 7), (None, None, 0, None)]
    assert jaccard_join.join_similar(docs.limit(0)).collect() == []


def test_runs_give_the_target_recall_with_shared_places_and_the_cut():
    r = np.random.default_rng(3)
    agree = r.binomial(jaccard_join.PLACES, 0.8, 400_000)
    found = np.zeros(len(agree), bool)
    for _ in range(jaccard_join.runs_needed()):
        shared = np.ones(len(agree), int)  # buckets that hold both classes
        for _ in range(jaccard_join.DEPTH):
            shared = r.binomial(shared + r.binomial(shared, jaccard_join.SECOND), agree / jaccard_join.PLACES)
        found |= shared > 0
    share = (found & (agree >= jaccard_join.CANDIDATE * jaccard_join.PLACES)).mean()
    assert share >= 1 - 1.2 * (1 - jaccard_join.TARGET_RECALL)
    assert jaccard_join.recall_after(jaccard_join.runs_needed()) >= jaccard_join.TARGET_RECALL > jaccard_join.recall_after(jaccard_join.runs_needed() - 1)
    with pytest.raises(ValueError):
        jaccard_join.runs_needed(0.9999999)


def test_a_large_bucket_splits_until_it_is_small(spark):
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))  # so many texts share it, in buckets that one split leaves large
    rows = [(i, f"{passage} " + " ".join(r.choices("abcdefghij", k=40))) for i in range(1500)]
    sketched = jaccard_join.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    met = jaccard_join.buckets(sketched.select("node", "sig"), 2)
    assert met.agg({"size": "max"}).first()[0] <= jaccard_join.BUCKET
    assert met.groupBy("bucket", "size").count().where("size <> count").isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
