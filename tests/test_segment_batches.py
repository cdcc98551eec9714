"""Segments made on Arrow's columns are those of the rules, and batches are bounded by bytes."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sonoshelf.operators import chunking


def transcript(r, n):
    out, t = [], 0.0
    for _ in range(n):
        t = max(0.0, t + r.choice([0.3, 0.3, 0.3, 0.1, 0.7, -0.2, 5.0 if r.random() < 0.02 else 0.3]))
        out.append({"word": r.choice(["a", " b", "c ", "a", ""]), "start": round(t, 2), "end": round(t + r.choice([0.25, 0.5, 1.0]), 2), "speaker": r.choice(["x"] * 30 + ["y", None, ""])})
    r.shuffle(out)
    return out


def test_segments_of_a_batch_are_those_of_each_transcript():
    r = random.Random(7)
    kind = to_arrow_type(chunking.T.ArrayType(chunking.WORD))
    rows = [[], None, *[transcript(r, r.randrange(1, 400)) for _ in range(40)], [], [{"word": "w", "start": 0.3 * k, "end": 0.3 * k + 0.25, "speaker": None} for k in range(500)]]
    found = pa.array([None, [], *rows], kind)
    want = [chunking.segments_of(x) if x else [] for x in rows]
    assert chunking.segment_lists(found.slice(2)).to_pylist() == want and max(map(len, want)) > 5
    assert chunking.segment_lists(pa.array([], kind)).to_pylist() == [] and chunking.segment_lists(pa.array([None, []], kind)).to_pylist() == [[], []]


def test_batches_of_words_are_bounded_by_bytes(spark, monkeypatch):
    """30 transcripts of 4000 words, over 5 MB, don't come in one batch."""
    w = F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.struct(F.concat(F.lit("word"), i).alias("word"), (i * 0.3).alias("start"), (i * 0.3 + 0.25).alias("end"), F.lit(None).cast("string").alias("speaker")))
    words = spark.range(30).coalesce(1).select("id", w.alias("words")).localCheckpoint()
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert words.select(F.size(chunking.to_segments("words")).alias("n")).distinct().collect() == [(50,)]

    @F.arrow_udf("long")
    def rows_of_batch(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int64())

    assert words.select(rows_of_batch("words").alias("n")).agg(F.max("n")).first()[0] < 30


def test_chunks_need_no_words(spark):
    kind = "id long, segments array<struct<id:int,start:double,end:double,text:string,speaker:string,words:array<struct<word:string,start:double,end:double,speaker:string>>>>"
    df = spark.createDataFrame([(1, [(0, 0.0, 1.0, "a b", "x", None), (1, 1.0, 2.0, "c", "y", None), (2, 2.0, 3.0, "d e f", "y", None)]), (2, []), (3, None)], kind)
    got = chunking.chunk_rows(df, 3).orderBy("transcript_id", "chunk_index").select("transcript_id", "chunk_index", "start", "end", "text", "speaker").collect()
    assert got == [(1, 0, 0.0, 2.0, "a b c", "y"), (1, 1, 2.0, 3.0, "d e f", "y")]
