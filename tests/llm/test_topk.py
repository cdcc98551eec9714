import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoshelf.llm import topk


def brute(rows, every, k):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in fine:
        if i % every == 0:
            asks[i] = max(asks.get(i, v), v)
    out = []
    for q, a in asks.items():
        s = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in fine if i != q and len(v) == len(a))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 512), (16, 4)])
def test_all_scores_and_ties_are_those_of_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES_A_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", blocks[1])
    r = np.random.default_rng(blocks[0])
    rows = [(i, [float(x) for x in np.round(r.normal(0, 0.3, 8), 1)]) for i in range(200)]
    rows += [(i, [0.5] * 8) for i in range(200, 260)]  # a common vector, so many ties
    rows += [(300, None), (301, [None] * 8), (302, [math.inf] * 8), (303, [math.nan] * 8), (None, [0.1] * 8), (320, [1.0, 2.0]), (321, [0.5, 0.5]), (340, [])]
    rows += [(20, [0.9] * 8), (20, [0.9] * 8), (5, [0.25] * 8), (5, [0.25] * 8)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, block string")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df).collect())
    assert got == brute(rows, 20, 20)


def test_large_values_stay_exact(spark):
    rows = [(i, [float(1 << 24), float(i)]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, k=3).collect())
    assert got == brute(rows, 20, 3)


def test_reading_stops_before_the_lists_end():
    r = np.random.default_rng(1)
    values = r.integers(-3, 4, (4000, 4))
    values[:5] = 60
    for floors in (None, np.array([1000.0])):
        read = []
        q, i, s = topk.nra(np.array([[5, 5, 5, 5]]), np.array([-1]), values, np.arange(4000), 5, floors, read)
        assert sorted(i) == [0, 1, 2, 3, 4] and set(s) == {1200}
        assert len(read) == 1 and read[0] <= 0.25


def test_a_block_below_the_floor_is_not_read():
    values, read = np.ones((100, 4), int), []
    q, i, s = topk.nra(np.array([[5, 5, 5, 5]]), np.array([-1]), values, np.arange(100), 5, np.array([21.0]), read)
    assert (list(q), list(i), s, read) == ([], [], [], [])
    q, i, s = topk.nra(np.array([[5, 5, 5, 5]]), np.array([-1]), values, np.arange(100), 5, np.array([20.0]), read)
    assert list(i) == [0, 1, 2, 3, 4] and s == [20] * 5


def test_scores_beyond_a_long_stand_at_its_ends(spark):
    rows = [(i, [float(i % 3 - 1) * 1e30, 1e30]) for i in range(0, 30)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert {(r.query_id, r.rank, r.score) for r in got} == {(q, r, (1 << 63) - 1) for q in (0, 20) for r in (1, 2, 3)}


def test_first_floors_are_dealt_over_all_blocks(spark):
    df = spark.range(400).selectExpr("id << 32 as q_block", "array(5L, 6L, 7L, 8L, 1L << 32, 2L << 32, 3L << 32, 9L) as blocks")
    got = [r["n"] for r in df.groupBy(topk.floor_block("q_block", "blocks").alias("block")).agg(F.count("*").alias("n")).collect()]
    assert len(got) == 8 and max(got) < 100


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
