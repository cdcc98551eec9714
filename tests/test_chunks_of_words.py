"""Chunks made of words at once are those made by way of segments, and batches are bounded whoever asks."""

import random
import threading

from pyspark.sql import functions as F

import __spark_entry__
from sonoshelf.operators import chunking, evaluation

from .test_segment_batches import transcript

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
WORDS = "array<struct<word:string,start:double,end:double,speaker:string>>"


def spoken(spark):
    r = random.Random(3)
    rows = [(k, [tuple(w.values()) for w in transcript(r, r.randrange(1, 500))]) for k in range(30)]
    return spark.createDataFrame([*rows, (30, []), (31, None), (None, [("a", 0.0, 1.0, "x")])], f"id long, words {WORDS}")


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_chunks_of_words_are_those_of_segments(spark):
    t = spoken(spark)
    for size in (1, 40):
        got = chunking.chunk_rows(t, size)
        want = chunking.chunk_rows(t.select("id", chunking.to_segments("words").alias("segments")), size)
        assert got.schema == want.schema and got.count() > 30
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert python_steps(got) == 1  # segments and ids aren't fetched by workers of their own


def test_ids_of_chunks_are_those_of_the_kernel(spark):
    rows = [(t, i) for t in ("0", "7", "-3", "ä/é", "9" * 30, "") for i in (0, 1, 250)]
    got = spark.createDataFrame(rows, "t string, i int").select("t", "i", chunking.chunk_id(F.col("t"), "i").alias("id")).collect()
    assert [r.id for r in got] == [chunking.chunk_uuid(t, i) for t, i in rows]


def test_batches_are_bounded_in_a_thread_and_in_another_session(spark):
    """A thread of Python has no active session in the JVM; rows may be of another session than the active one."""
    rows = "transcript_id long, chunk_index int, id string, start_sec double, text string"
    segments = f"id long, segments array<struct<words:{WORDS}>>"
    steps = [
        lambda s: chunking.chunk_rows(s.createDataFrame([], f"id long, words {WORDS}"), 40),
        lambda s: evaluation.resegmented(s.createDataFrame([], segments)),
        lambda s: evaluation.judge(s.createDataFrame([], rows)),
        lambda s: evaluation.embedded(s.createDataFrame([], rows)),
        lambda s: __spark_entry__.queries()["words_to_segments"](s, "/root/testdata/sf0.001"),
        lambda s: __spark_entry__.queries()["segment_chunks"](s, "/root/testdata/sf0.001"),
        lambda s: __spark_entry__.queries()["resegment_backfill"](s, "/root/testdata/sf0.001"),
    ]
    failed = []

    def run(step, other):
        try:
            if other:
                spark.newSession()  # is this thread's active one
            spark.conf.unset(BOUND)
            step(spark)
        except Exception as e:
            failed.append(e)

    for step in steps:
        for other in (False, True):
            t = threading.Thread(target=run, args=(step, other))
            t.start()
            t.join()
            assert not failed and spark.conf.get(BOUND) == str(2 << 20)


def test_chunks_and_findings_are_made_once_for_all_steps(spark):
    """No step of process_transcripts asks for chunks or judgements again: what is left in Python are the vectors."""
    df = __spark_entry__.queries()["process_transcripts"](spark, "/root/testdata/sf0.001")
    assert python_steps(df) <= 1 and df.count() > 0
