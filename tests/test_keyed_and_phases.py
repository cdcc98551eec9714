"""Keyed tables, retention by days, guarded rebuilds, phases and the control row."""

import os
import random
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sonoshelf.operators import retention
from sonoshelf.streaming import jobs, keyed_table, stateful

from .test_stateful import Stream, at

CHUNK = "transcript_id long, chunk_index int, id string, text string, speaker string, embedding_stale boolean, created_at string"


def told(table, spark):
    return sorted(map(tuple, table.read(spark).collect()))


def files(path):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def chunks(spark, tmp_path):
    t = keyed_table.KeyedTable(str(tmp_path / "chunks"), ["transcript_id", "chunk_index"], replace=["text"], keep_if_null=["speaker"], buckets=8)
    t.create(spark.createDataFrame([(i, k, f"id{i}{k}", f"t{i}{k}", "s", i % 2 == 0, "then") for i in range(6) for k in range(2)], CHUNK))
    return t


def test_a_merge_touches_what_it_may_and_only_once(spark, tmp_path, chunks):
    before = told(chunks, spark)
    new = [(1, 0, "other", "new", None, True, "now"), (2, 1, "other", "new2", "x", False, "now"), (9, 0, "id9", "fresh", None, True, "now"), (None, 0, "z", "z", None, None, None)]
    batch = spark.createDataFrame(new, CHUNK)
    want = [r for r in before if r[:2] not in ((1, 0), (2, 1))] + [(1, 0, "id10", "new", "s", False, "then"), (2, 1, "id21", "new2", "x", True, "then"), (9, 0, "id9", "fresh", None, True, "now")]
    for _ in range(2):
        chunks.merge(batch)
        assert told(chunks, spark) == sorted(want)


def test_a_merge_overwrites_the_buckets_of_its_keys(spark, chunks):
    at = f"{chunks.path}/rows"
    before = files(at)
    chunks.merge(spark.createDataFrame([(3, 1, "q", "changed", None, None, None)], CHUNK))
    after = files(at)
    kept, gone = before.keys() & after.keys(), before.keys() - after.keys()
    assert len({p.split("bucket=")[1][:1] for p in gone}) == 1 and all(before[p] == after[p] for p in kept) and len(kept) >= len(before) - 1
    assert (3, 1, "id31", "changed", "s", False, "then") in told(chunks, spark)


def test_the_last_row_of_a_key_counts_and_nothing_is_inserted_unasked(spark, chunks):
    rows = [(1, 0, "a", "late", None, None, "2"), (1, 0, "a", "early", None, None, "1"), (77, 0, "a", "x", None, None, "1")]
    n = chunks.read(spark).count()
    chunks.merge(spark.createDataFrame(rows, CHUNK), ["created_at"], insert=False)
    assert chunks.read(spark).where("transcript_id = 1 and chunk_index = 0").first().text == "late" and chunks.read(spark).count() == n
    chunks.merge(spark.createDataFrame([], CHUNK))
    assert chunks.read(spark).count() == n


def test_finished_transcripts_end_their_jobs(spark, tmp_path):
    t = keyed_table.KeyedTable(str(tmp_path / "t"), ["job_id"], buckets=4)
    j = keyed_table.KeyedTable(str(tmp_path / "j"), ["id"], replace=["status", "completed_at", "updated_at", "error"], buckets=4)
    t.create(spark.createDataFrame([], "job_id long, text string, finished_at string"))
    j.create(spark.createDataFrame([(1, "claimed", "r", None, "u", "e"), (2, "claimed", "r", None, "u", None)], "id long, status string, claimed_by string, completed_at string, updated_at string, error string"))
    done = spark.createDataFrame([(1, "said", "t1"), (8, "no job", "t1")], "job_id long, text string, finished_at string")
    done.write.parquet(str(tmp_path / "in"))
    for run in "ab":  # the same batch again
        jobs.drain(spark.readStream.schema(done.schema).parquet(str(tmp_path / "in")), keyed_table.finish_jobs(t, j), str(tmp_path / run))
    assert told(j, spark) == [(1, "done", "r", "t1", "t1", None), (2, "claimed", "r", None, "u", None)]
    assert told(t, spark) == [(1, "said", "t1"), (8, "no job", "t1")]


def test_a_decision_between_reading_and_clearing_keeps_a_chunk_stale(spark, tmp_path):
    t = keyed_table.KeyedTable(str(tmp_path / "chunks"), ["transcript_id", "chunk_index"], replace=["embedding_stale"], buckets=4)
    t.create(spark.createDataFrame([(i, k, "x") for i in (1, 2, 3) for k in (0, 1, 2)], "transcript_id long, chunk_index int, text string").withColumn("embedding_stale", F.lit(True)))
    decided = [(1, 0, "applied", 5), (1, 1, "accepted", 5), (2, 0, "rejected", 9)]
    seen = []

    def rebuild(mine, found, batch):
        seen.append((mine.count(), found.count()))
        decided.append((1, 2, "rejected", 11))  # after the time that was taken

    sink = keyed_table.rebuild_stale(t, lambda s: s.createDataFrame(decided, "transcript_id long, chunk_index int, patch_state string, decided_at long"), rebuild, lambda s: 10)
    spark.createDataFrame([(1,), (2,), (1,)], "transcript_id long").write.parquet(str(tmp_path / "in"))
    jobs.drain(spark.readStream.schema("transcript_id long").parquet(str(tmp_path / "in")), sink, str(tmp_path / "c"))
    stale = {(r.transcript_id, r.chunk_index) for r in t.read(spark).where("embedding_stale").collect()}
    assert seen == [(6, 3)] and stale == {(1, 1), (1, 2), (3, 0), (3, 1), (3, 2)}


EVENTS = "id long, stage string, created_at timestamp_ntz"


def test_pruning_drops_days_and_rewrites_one(spark, tmp_path):
    path, day = str(tmp_path), datetime(2024, 3, 10)
    stages = ["heartbeat", "runner_availability", "done", None]
    rows = [(n, stages[n % 4], day + timedelta(hours=5 * k)) for n, k in enumerate(k for k in range(-30, 30) for _ in range(4))] + [(999, "heartbeat", None)]
    df = spark.createDataFrame(rows, EVENTS)
    retention.append_events(df.where("id % 8 < 4"), path)
    retention.append_events(df.where("id % 8 >= 4"), path)
    before, now = files(path), day + timedelta(days=2, hours=7)
    want = [r for r in rows if not (r[1] in retention.PRUNED and r[2] is not None and r[2] < now - timedelta(days=2))]
    assert retention.prune(spark, path, EVENTS, now, 2) == len(rows) - len(want)
    after = files(path)
    left = [tuple(r)[:3] for r in retention.read_events(spark, path, EVENTS).collect()]
    assert sorted(left) == sorted(want)
    edge = f"prunable=true/day={day.date()}"
    assert all(before[p] == after[p] for p in before if "prunable=false" in p or (p in after and edge not in p))
    assert not [p for p in after if "prunable=true" in p and "day=20" in p and p.split("day=")[1][:10] < str(day.date())]
    assert retention.prune(spark, path, EVENTS, now, 2) == 0 and files(path) == after


def test_a_log_without_heartbeats_and_an_edge_that_empties(spark, tmp_path):
    assert retention.prune(spark, str(tmp_path / "none"), EVENTS, datetime(2024, 1, 1)) == 0
    path = str(tmp_path / "log")
    retention.append_events(spark.createDataFrame([(1, "heartbeat", datetime(2024, 1, 1, 1)), (2, "done", datetime(2024, 1, 1, 1))], EVENTS), path)
    assert retention.prune(spark, path, EVENTS, datetime(2024, 1, 3, 2), 2) == 1
    assert [r.id for r in retention.read_events(spark, path, EVENTS).collect()] == [2]


LOG = "service string, at timestamp, seq long, kind string, phase string, pending long, claimed long, run_limit long, embed_backlog long, eval_backlog long"


def status(t, pending, claimed, limit, embed, judge=0, service="s"):
    return (service, at(t), t, "status", None, pending, claimed, limit, embed, judge)


def test_phases_from_idle_to_idle(spark, tmp_path):
    s = Stream(spark, tmp_path, LOG, lambda log: stateful.phases(log, 3, judges_first=True))
    s.give([("s", at(0), 0, "start", None, *[None] * 5), status(1, 5, 0, 0, 0)], [status(2, 4, 1, 2, 0), status(3, 2, 1, 0, 1), status(4, 2, 0, 0, 3, 2)])
    got = s.give([status(5, 2, 0, 0, 0, 1), status(6, 2, 0, 0, 0)], [status(7, 0, 1, 1, 0), status(8, 0, 0, 1, 2)], [status(9, 0, 0, 1, 0), status(10, 9, 0, 1, 0)])
    assert sorted((r.at.astimezone(UTC), r.phase, r.run_limit, r.batch) for r in got) == [
        (at(1), "transcribe", 3, 1), (at(4), "analyze", None, 1), (at(6), "transcribe", 3, 2), (at(8), "analyze", None, 2), (at(9), "idle", 0, 2),
    ]


def test_resumed_stopped_and_bounded_runs(spark, tmp_path):
    s = Stream(spark, tmp_path, LOG, lambda log: stateful.phases(log, 2, 1))
    start = lambda name, phase=None: (name, at(0), 0, "start", phase, *[None] * 5)
    rows = [start("resumed", "analyze"), status(1, 3, 0, 0, 2, service="resumed"), status(2, 3, 0, 0, 0, 9, service="resumed")]
    rows += [start("stopped"), status(1, 3, 0, 0, 0, service="stopped"), ("stopped", at(2), 2, "stop", *[None] * 6), status(3, 3, 0, 0, 0, service="stopped")]
    rows += [start("bounded"), status(1, 3, 0, 0, 0, service="bounded"), status(2, 3, 0, 0, 0, service="bounded"), status(3, 3, 0, 0, 0, service="bounded"), status(1, 1, 0, 0, 0, service="never started")]
    random.Random(0).shuffle(rows)
    got = sorted((r.service, r.at.astimezone(UTC), r.phase, r.run_limit) for r in s.give(rows))
    assert got == [
        ("bounded", at(1), "transcribe", 2), ("bounded", at(2), "analyze", None), ("bounded", at(3), "idle", 0),
        ("resumed", at(0), "analyze", 0), ("resumed", at(2), "transcribe", 2), ("stopped", at(1), "transcribe", 2), ("stopped", at(2), "idle", 0),
    ]


def test_the_control_row_is_the_last_of_each_setting(spark):
    rows = [("a", 1, 0, "paused", "true"), ("a", 2, 0, "run_limit", "5"), ("a", 3, 1, "phase", "analyze"), ("a", 3, 0, "phase", "transcribe"), ("a", 4, 0, "run_limit", None), ("b", 1, 0, "phase", ""), ("b", 1, 1, "run_limit", "0"), ("b", 2, 0, "runner_version", "v2")]
    df = spark.createDataFrame(rows, "service string, at int, seq int, name string, value string")
    got = {r.service: tuple(r)[1:] for r in stateful.control_row(df).collect()}
    assert got == {"a": (True, None, "analyze", None), "b": (False, 0, "idle", "v2")}
    with pytest.raises(Exception, match="no such phase"):
        stateful.control_row(df.where("name = 'phase'").withColumn("value", F.lit("busy"))).collect()
