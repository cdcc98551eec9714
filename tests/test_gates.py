"""Sources and streams: what is walked, what has settled, gates and side writes."""

import pytest

from sonoshelf.sources import readers
from sonoshelf.streaming import jobs


def test_a_scan_counts_what_it_walks(spark, tmp_path):
    for name in ("a.mp3", "b.M4B", "._a.mp3", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert readers.scan_counts(spark, str(tmp_path)).first().asDict() == {"walked": 3, "audio": 2, "skipped": 1}  # hidden files are not listed
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_counts(spark, str(tmp_path / "none")).collect()


def test_a_file_has_settled_when_its_size_stays(spark):
    old = spark.createDataFrame([("a", 5, 2), ("b", 5, 2)], "path string, length long, seen int")
    new = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "path string, length long")
    assert {r.path: r.seen for r in readers.settled(old, new).collect()} == {"a": 3, "b": 1, "c": 1}


def test_providers():
    assert readers.providers("abs") == ["abs"] and readers.providers("chain: abs , path,abs") == ["abs", "path"]
    assert readers.providers("who") == readers.providers("") == readers.providers("chain:x") == ["path"]
    assert set(readers.SCHEMAS) == {"jobs", "transcripts", "chunks", "book_metadata", "run_metrics", "findings", "events", "control"}


def stream(spark, tmp_path, rows):
    at = str(tmp_path / "in")
    spark.createDataFrame(rows, "transcript_id long").write.mode("append").parquet(at)
    return spark.readStream.schema("transcript_id long").parquet(at)


def test_a_pause_starts_nothing_and_fails_nothing(spark, tmp_path):
    s, got = stream(spark, tmp_path, [(1,), (2,)]), []
    take = lambda df, batch: got.extend(r.transcript_id for r in df.collect())
    for row, runs in (((True, "transcribe"), False), ((False, "analyze"), False), ((False, "transcribe"), True)):
        control = spark.createDataFrame([row], "paused boolean, phase string")
        assert jobs.drain_while_open(lambda c=control: c, lambda: s, take, str(tmp_path / "c"), "transcribe") == runs
        assert sorted(got) == ([1, 2] if runs else [])
    assert jobs.drain_while_open(lambda: control.limit(0), lambda: s, take, str(tmp_path / "c"))  # without a row it is open
    assert sorted(got) == [1, 2]


def test_side_writes_never_fail_a_stream(spark, tmp_path):
    told = []
    jobs.drain(stream(spark, tmp_path, [(1,)]), jobs.best_effort(lambda df, batch: 1 / 0, told.append), str(tmp_path / "c"))
    assert [type(e) for e in told] == [ZeroDivisionError]


def test_decisions_rebuild_what_they_touch(spark, tmp_path):
    got = []
    chunks = lambda sp: sp.createDataFrame([(1, 0), (1, 1), (2, 0)], "transcript_id long, chunk_index int")
    jobs.rebuilt(stream(spark, tmp_path, [(1,), (1,)]), chunks, lambda df, batch: got.extend(map(tuple, df.collect())), str(tmp_path / "c"))
    assert sorted(got) == [(1, 0), (1, 1)]
    q = jobs.every(stream(spark, tmp_path, [(2,)]), lambda df, batch: None, str(tmp_path / "d"), 0)
    assert q.awaitTermination(60)
