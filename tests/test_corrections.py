import pytest
from pyspark.sql import functions as F

from sonoshelf.operators.corrections import anchor, corrections

KIND = "id long, chunk_id long, transcript_id long, chunk_index int, start_sec double, original_text string, patch_state string, confidence double, anchor_offset int"


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame([(1, 10, 0, "the fox ran and the fox sat"), (2, 10, 1, "é世 " + "x" * 700 + " end")], "id long, transcript_id long, chunk_index int, text string")
    found = spark.createDataFrame(
        [(1, None, 10, 0, 0.0, "fox", "proposed", 0.9, 20), (2, 1, 10, 0, 1.0, "ran", "accepted", 0.8, 3), (3, 1, 10, 0, 2.0, "fox", "proposed", 0.7, None),
         (4, None, 10, 1, 0.0, "end", "proposed", 0.6, None), (5, None, 99, 0, 0.0, "x", "proposed", 0.5, None), (6, 1, 10, 0, 3.0, "cat", "rejected", 0.4, None)],
        KIND,
    )
    return found, chunks


def test_places_and_contexts(tables):
    got = {r.id: r for r in corrections(*tables).collect()}
    assert [(got[i].start, got[i].status) for i in range(1, 7)] == [(20, "offset"), (8, "unique"), (None, "ambiguous"), (704, "unique"), (None, "no chunk"), (None, "not found")]
    assert got[4].context.endswith(" end") and got[4].truncated and not got[1].truncated
    assert got[2].may_become == ["applied", "rejected", "stale"]


def test_filters_and_pages(tables):
    assert sorted(r.id for r in corrections(*tables, states=["proposed"], floor=0.6, limit=2, offset=1).collect()) == [3, 4]
    for bad in ({"floor": 1.5}, {"states": ["lost"]}):
        with pytest.raises(ValueError):
            corrections(*tables, **bad)


def test_occurrences_count_from_nothing_and_may_overlap(spark):
    df = spark.createDataFrame([("aaab", "aa", None, 1), ("aaab", "aa", None, None), ("aaab", "aa", 1, 0), ("aaab", "", None, 0), (None, "x", None, None), ("é世a", "a", -1, -1)], "t string, s string, o int, n int")
    got = [tuple(r.a) for r in df.select(anchor(F.col("t"), F.col("s"), F.col("o"), F.col("n")).alias("a")).collect()]
    assert got == [(1, "occurrence"), (None, "ambiguous"), (1, "offset"), (None, "not found"), (None, "no chunk"), (2, "unique")]
