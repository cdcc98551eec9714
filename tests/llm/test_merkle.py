"""The manifest against a plain tree, and its edges."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sonoshelf.llm import merkle
from sonoshelf.llm.positions import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout, keep):
    """The root, and for each node the siblings and places on its way up."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % fanout
            paths[k].append((nodes[run:i], nodes[i + 1 : run + fanout]))
            at[k] = i // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout=3):
    by = {}
    for doc_id, text, lang, source, n in rows:
        cut = text.replace("\n", "") if text is not None and zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 2 == 0 else text
        leaf, claimed = (H(*[field(v) for v in (doc_id, source, lang, n, t)]) for t in (text, cut))
        by.setdefault(source, []).append(((doc_id is not None, doc_id or 0), leaf, doc_id, claimed))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:2])
        trees[s] = climb([x[1] for x in by[s]], fanout, True)
    root, above = climb([trees[s][0] for s in order], fanout, True)
    out = []
    for s, up in zip(order, above):
        for (_, leaf, doc_id, claimed), path in zip(by[s], trees[s][1]):
            node = claimed
            for left, right in path + up:
                node = H(*left, node, *right)
            proof = H(*[x for left, right in path + up for x in left + right])
            out.append((doc_id, leaf, trees[s][0], root, proof, node, node == root))
    return out


def told(df):
    return sorted(map(tuple, df.drop("path").collect()), key=repr)


@pytest.mark.parametrize(("fanout", "levels"), [(3, 1), (3, 7), (2, 2)])
def test_manifest_is_that_of_a_plain_tree(spark, fanout, levels):
    r = random.Random(levels)
    rows = []
    for s, n in [("a", 1), ("hot", 100), (None, 28), ("b", 3), ("c", 4), ("", 2), ("é", 27), ("z", 10), ("zz", 9), ("y", 13)]:
        rows += [(r.randrange(10**6), r.choice([None, "", "x\ny", "plain", "é\n" * 9]), r.choice([None, "en"]), s, r.choice([None, 5])) for _ in range(n)]
    rows += [(None, "no id\n", "en", "a", 1), (5, "twice\n", None, "b", 2), (5, "twice\n", None, "b", 2), (5, "other", None, "b", 2)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "extra") for x in rows], SCHEMA + ", subroot string").repartition(6)
    assert told(merkle.manifest(df, fanout=fanout, block_levels=levels)) == sorted(brute(rows, fanout), key=repr)


@pytest.mark.parametrize("n", range(1, 30))
def test_every_size_of_the_last_run(n):
    nodes = [H(str(i)) for i in range(n)]
    levels = merkle.levels_of(nodes, 3, None)
    root, paths = climb(nodes, 3, True)
    assert levels[-1] == [root]
    for k, node in enumerate(nodes):
        assert merkle.path_in(levels, k, 3) == [("".join(a), "".join(b)) for a, b in paths[k]]
        assert merkle.fold(node, merkle.path_in(levels, k, 3)) == root


@pytest.mark.parametrize("parts", [1, 2, 4, 9, 14, 28, 40])
def test_butterfly_brings_each_block_its_upper_proof(spark, parts):
    nodes = [H(str(i)) for i in range(parts)]
    df = spark.createDataFrame([("s", i, parts, x) for i, x in enumerate(nodes)] + [("one", 0, 1, nodes[0])], "tree string, part long, parts long, root string")
    got = {(r.tree, r.part): (r.top, [(s.left, s.right) for s in r.path]) for r in merkle.butterfly(df, 3).collect()}
    root, paths = climb(nodes, 3, True)
    assert got == {("s", i): (root, [("".join(a), "".join(b)) for a, b in p]) for i, p in enumerate(paths)} | {("one", 0): (nodes[0], [])}


def test_an_altered_row_is_found_and_only_that(spark):
    df = spark.createDataFrame([(i, f"line\n{i}" if i % 3 else "plain", None, "s", 1) for i in range(40)], SCHEMA)
    for r in merkle.manifest(df, block_levels=1).collect():
        altered = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.doc_id % 3 != 0
        assert r.verified != altered
        assert merkle.fold(r.leaf, [(s.left, s.right) for s in r.path]) == r.root


def test_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df).collect() == []


def test_places_of_a_group_over_many_tasks(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).otherwise("hot").alias("g"), (-F.col("id")).alias("o")).repartition(7)
    rows = numbered(df, "g", ["o"]).collect()
    for g in (None, "hot"):
        mine = sorted((r.o, r.pos, r.size) for r in rows if r.g == g)
        assert [p for _, p, _ in mine] == list(range(len(mine))) and {s for _, _, s in mine} == {len(mine)}
