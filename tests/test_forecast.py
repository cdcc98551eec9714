"""Forecasts, server states, monitors, applied corrections and track details on small tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sonoshelf.operators import findings, forecast, servers, service, status

T0 = datetime(2024, 1, 20)
LOG = "event_id long, created_at timestamp_ntz, stage string, reason string, detail string"


def ts(v):
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def test_idle_share_is_that_of_one_sequence(spark):
    r = random.Random(2)
    rows, at = [], T0 - timedelta(days=20)
    for k in range(80):
        at += timedelta(seconds=r.choice([0, 60, 3600, 90_000]))
        rows.append((k, at, r.choice(["runner_availability"] * 4 + ["heartbeat"]), r.choice(["idle", "busy", None]), r.choice([None, '{"reason": "idle"}', '{"k": 1}'])))
    df = spark.createDataFrame(r.sample(rows, len(rows)), LOG)
    now = max(x[1] for x in rows)
    seen = [(t, "idle" if d and "idle" in d else why or "") for _, t, stage, why, d in rows if stage == "runner_availability" and t > now - timedelta(days=14)]
    gaps = [((b - a).total_seconds(), why == "idle") for (a, why), (b, _) in zip(seen, seen[1:], strict=False)]
    assert forecast.idle_share(df, ts(now)).first().available == pytest.approx(sum(g for g, idle in gaps if idle) / sum(g for g, _ in gaps))
    for few in (df.limit(0), df.where("event_id = 3")):
        assert forecast.idle_share(few, ts(now)).first().available == 0


RUN = "job_id long, transcribe_started_at timestamp_ntz, transcribe_finished_at timestamp_ntz, embed_started_at timestamp_ntz, embed_finished_at timestamp_ntz, eval_started_at timestamp_ntz, eval_finished_at timestamp_ntz, embed_chunk_count int, eval_chunks int"
JOB = "id long, status string, completed_at timestamp_ntz, updated_at timestamp_ntz"


def test_rates_are_of_the_jobs_done_last(spark):
    run = lambda i, s, n, judged=False: (i, T0, T0 + timedelta(seconds=s * (n or 1)), T0, T0 + timedelta(seconds=n or 1), T0 if judged else None, T0 + timedelta(seconds=6) if judged else None, n, 2 if judged else None)
    m = spark.createDataFrame([run(1, 100, 10), run(2, 2, 10), run(3, 4, 5), run(4, 9, None), run(5, 1000, 1, True)], RUN)
    j = spark.createDataFrame([(1, "done", T0, T0), (2, "done", None, T0 + timedelta(1)), (3, "done", T0 + timedelta(2), T0), (4, "done", T0 + timedelta(3), T0), (5, "pending", None, T0 + timedelta(9)), (6, "claimed", None, T0)], JOB)
    assert tuple(forecast.cohort_rates(j, m, 3).first()) == (3.0, 1.0, 0.0, False)
    assert tuple(forecast.cohort_rates(j, m).first()) == (4.0, 1.0, 0.0, False)
    assert forecast.chunks_left(j, m).first().chunks == 15  # two jobs of 7.5 chunks
    none = forecast.forecast(j.limit(0), m.limit(0), spark.createDataFrame([], LOG), ts(T0)).first()
    assert (none.chunks, none.work, none.calendar, none.has_work) == (0, 0.0, None, False)


def test_states_in_their_order(spark):
    now = T0
    rows = [
        ("a", now - timedelta(minutes=5), "lib/x.mp3", True, False, None, 3, None), ("b", now - timedelta(hours=2), None, True, True, True, 0, None), ("c", None, None, True, False, None, 3, None),
        ("d", None, None, True, True, True, 0, None), ("e", None, None, True, True, False, 9, None), ("f", None, None, None, None, None, 2, now - timedelta(days=3, hours=5)), ("g", None, None, False, None, None, 2, None),
        ("h", None, None, None, None, None, 0, None), ("i", now + timedelta(1), "", None, None, None, 0, None), ("j", now - timedelta(seconds=1800), ".", None, None, None, 0, None),
    ]
    df = spark.createDataFrame(rows, "server string, beat timestamp_ntz, current_file string, probed boolean, reachable boolean, ready boolean, jobs long, last_finished timestamp_ntz")
    got = {r.server: (r.state, r.detail) for r in servers.with_state(df, ts(now)).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(zip("abcdefghij", ["transcribing", "stalled", "offline", "ready", "busy", "idle", "idle", "not_seen", "transcribing", "transcribing"], strict=True))
    assert got["a"][1] == "transcribing x.mp3" and "2h ago" in got["b"][1] and got["f"][1] == "idle — last active 3d ago" and got["g"][1] == "idle — no live claim" and got["i"][1] == got["j"][1] == "transcribing"


def test_what_was_seen_comes_before_what_was_meant(spark):
    df = spark.createDataFrame([("m1", "m2"), ("", "m2"), (None, ""), (None, None)], "observed_model string, configured_model string")
    assert [(r.model, r.model_source) for r in servers.with_models(df, ("model",)).collect()] == [("m1", "observed"), ("m2", "configured"), ("", ""), ("", "")]


def test_a_gauge_that_cannot_be_told_has_no_row(spark):
    snap = "pending long, claimed long, done long, failed long, embed_backlog long, eval_coverage_done long, latest_activity timestamp_ntz, runner_available_known boolean, runner_available boolean"
    eta = "work double, calendar double, has_work boolean"
    none = status.monitor(spark.createDataFrame([(0, 0, 0, 0, 0, 0, None, False, False)], snap), spark.createDataFrame([(0.0, None, False)], eta), ts(T0))
    assert {r.metric for r in none.collect()} == {"jobs", "embed_backlog", "eval_coverage"}
    some = status.monitor(spark.createDataFrame([(1, 2, 4, 0, 5, 1, T0 + timedelta(1), True, False)], snap), spark.createDataFrame([(8.0, 16.0, True)], eta), ts(T0), ts(T0 - timedelta(seconds=30)))
    assert {(r.metric, r.label): r.value for r in some.collect()} == {
        ("jobs", "pending"): 1, ("jobs", "claimed"): 2, ("jobs", "done"): 4, ("jobs", "failed"): 0, ("embed_backlog", ""): 5, ("eval_coverage", ""): 0.25, ("heartbeat_age_seconds", ""): 0,
        ("alive_age_seconds", ""): 30, ("runner_available", ""): 0, ("eta_work_seconds", ""): 8, ("eta_calendar_seconds", ""): 16,
    }


def test_applied_corrections_keep_both_texts(spark):
    f = spark.createDataFrame([(i, s) for i, s in enumerate(["proposed", "accepted", "applied", "rejected", "stale", "accepted"])], "id long, patch_state string")
    told = spark.createDataFrame([(i, "x", "y") for i in range(5)] + [(1, "a", "b")], "id long, before string, after string")
    got = {r.id: (r.patch_state, r.applied_before_text, r.applied_after_text, r.applied_at is not None) for r in findings.mark_applied(f, told, ts(T0)).collect()}
    none = (None, None, False)
    assert got == {0: ("proposed", *none), 1: ("applied", "x", "y", True), 2: ("applied", "x", "y", True), 3: ("rejected", *none), 4: ("stale", *none), 5: ("accepted", *none)}


def test_findings_are_cut_before_jobs_are_joined(spark):
    f = spark.createDataFrame([(i, f"lib/b{i % 3}/t.mp3", i / 10, 1.0) for i in range(9)] + [(99, "lib/b1x/t.mp3", 1.0, 1.0)], "id long, file_path string, confidence double, start_sec double")
    j = spark.createDataFrame([(7, "lib/b1/t.mp3")], "id long, file_path string")
    got = findings.listed(f, j, "lib/b1/", 2)
    assert [(r.id, r.job_id, r.book_dir) for r in got.collect()] == [(7, 7, "lib/b1"), (4, 7, "lib/b1")]
    assert [r.id for r in findings.listed(f, j, limit=3).collect()] == [99, 8, 7] and findings.listed(f, j, limit=-1).count() == 10
    assert "StartsWith(file_path" in findings.listed(f, j, "lib/b1")._jdf.queryExecution().optimizedPlan().toString()


def test_a_track_without_transcript_and_no_track(spark):
    j = spark.createDataFrame([(1, "p", "done"), (2, "q", "pending")], "id long, file_path string, status string")
    t = spark.createDataFrame([(10, 1, "p", "en")], "id long, job_id long, file_path string, language string")
    m = spark.createDataFrame([(1, T0, T0 + timedelta(seconds=5), 3)], "job_id long, transcribe_started_at timestamp_ntz, transcribe_finished_at timestamp_ntz, word_count int")
    c = spark.createDataFrame([(10, 1, 2.0, 3.0, None, "more", True), (10, 0, 0.0, 2.0, "s", "some", None), (11, 0, 0.0, 1.0, "s", "x", None)], "transcript_id long, chunk_index int, start_sec double, end_sec double, speaker string, text string, embedding_stale boolean")
    d = service.track_detail(j, t, m, c, 1).first()
    assert (d.file_path, d.has_transcript, d.language, d.word_count, d.processing_seconds, [(x.chunk_index, x.chars, x.stale) for x in d.chunks]) == ("p", True, "en", 3, 5.0, [(0, 4, None), (1, 4, True)])
    d = service.track_detail(j, t, m, c, 2).first()
    assert (d.has_transcript, d.chunks, d.language, d.processing_seconds) == (False, [], None, None)
    assert service.track_detail(j, t, m, c, 3).collect() == []
