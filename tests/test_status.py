import pytest
from pyspark.sql import functions as F

from sonoshelf.functions.bias import bias_terms
from sonoshelf.operators import status


def test_percents_sum_to_a_hundred():
    for counts in ([1, 1, 1], [1000, 1, 0, 3], [0, 0], [7], [1, 0, 99999], [3, 3, 3, 3, 3, 3, 3]):
        p = status.percents(counts)
        assert sum(p) == (100 if sum(counts) else 0)
        assert all((x >= 2) == (c > 0) for x, c in zip(p, counts, strict=True) if sum(counts))
    assert status.percents([996, 1, 1, 1, 1]) == [92, 2, 2, 2, 2] and status.percents([1, 1, 1]) == [34, 33, 33]


CASES = [
    # paused, phase, pending, claimed, done, backlog, evaluated, evaluates, probed, active: coverage, committed, fully done, activity
    ((True, "transcribe", 5, 1, 2, 0, 1, True, False, False), (0.5, True, False, "paused")),
    ((False, "idle", 5, 1, 2, 0, 1, True, False, False), (0.5, False, False, "transcribing")),
    ((False, "idle", 0, 1, 2, 0, 2, True, True, True), (1.0, True, False, "transcribing")),
    ((False, "transcribe", 0, 0, 2, 0, 2, True, False, False), (1.0, True, True, "transcribing")),
    ((False, "analyze", 3, 0, 2, 4, 0, True, False, False), (0.0, True, False, "evaluating")),
    ((False, "idle", 0, 0, 4, 4, 0, True, False, False), (0.0, False, False, "embedding")),
    ((False, "idle", 0, 0, 4, 0, 1, True, False, False), (0.25, False, False, "evaluating")),
    ((False, "idle", 2, 0, 4, 0, 4, True, False, False), (1.0, False, False, "winding-down")),
    ((False, "idle", 2, 0, 4, 0, 0, False, False, False), (-1.0, False, False, "winding-down")),
    ((False, "idle", 0, 0, 4, 0, 0, False, False, False), (-1.0, False, True, "idle")),
    ((False, "idle", 0, 0, 4, 0, 4, True, True, True), (1.0, False, True, "idle")),
    ((False, "idle", 0, 0, 0, 0, 0, True, False, False), (0.0, False, False, "evaluating")),
]


@pytest.mark.parametrize(("given", "want"), CASES)
def test_lifecycle(spark, given, want):
    df = spark.createDataFrame([given], "paused boolean, phase string, pending int, claimed int, done int, embed_backlog int, evaluated int, evaluates boolean, probed boolean, probe_active boolean")
    r = status.lifecycle(df).first()
    assert (r.coverage, r.committed, r.fully_done, r.activity) == want


def test_bias_terms(spark):
    rows = [
        ("Ann Leckie", "Adjoa Andoh", "Imperial Radch", "The Ancillary's Justice of Ann"), (None, "", None, "the book"), ("Plato", None, "The End of Ed", "1984: NINETEEN (Eighty-Four)"), ("ursula k. le guin", "O'Brien", None, "War and PEACE, war"),
    ]
    df = spark.createDataFrame(rows, "a string, n string, s string, t string")
    got = [r.b for r in df.select(bias_terms(*map(F.col, "anst")).alias("b")).collect()]
    assert got == [
        ["Ann", "Leckie", "Ann Leckie", "Adjoa", "Andoh", "Adjoa Andoh", "Imperial", "Radch", "Imperial Radch", "Ancillary", "Justice"], [],
        ["Plato", "End", "The End of Ed", "NINETEEN", "Eighty", "Four"], ["Brien", "O Brien", "War", "PEACE"],
    ]


def test_servers_take_turns(spark):
    from sonoshelf.operators.pipeline import matched_servers

    live = [("runner-gpu-1", 5), ("runner-gpu-2", 9), ("runner-mini", 3)]
    hosts = [("gpu-1", 10, 2), ("gpu-2", 20, 7), ("mini", 4, None), ("old", 1, 1)]
    # the first token takes the freshest runner and all its hosts; the second what is left
    assert matched_servers(["GPU", "gpu-1", "none"], live, hosts) == [
        ("GPU", True, "runner-gpu-2", "gpu-2", 30, 9), ("gpu-1", True, "runner-gpu-1", None, 0, 5), ("none", True, None, None, 0, None),
        ("runner-mini", False, "runner-mini", "mini", 4, 3), ("old", False, None, "old", 1, 1),
    ]
    assert matched_servers([], live[:1], [("gpu", 1, 5), ("gpu-1", 2, 6)]) == [("runner-gpu-1", False, "runner-gpu-1", "gpu-1", 3, 5), ("gpu", False, None, "gpu", 1, 5)]
    assert matched_servers([], [], []) == []
