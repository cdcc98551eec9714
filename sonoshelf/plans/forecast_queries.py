"""Registered queries of forecasts, servers, monitors and single tracks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoshelf.functions import text as tx
from sonoshelf.operators import findings, forecast, servers, service, status

from . import roles
from .catalogue import query, table
from .roles import EVENTS, FINDINGS, JOBS
from .service_queries import SNAPSHOT, _snapshot

#: Run metrics with times of all three stages and chunk counts; the availability log; its end.
RUNS = """runs AS (SELECT l_orderkey AS job_id, min(l_shipdate)::TIMESTAMP AS transcribe_started_at, max(l_shipdate)::TIMESTAMP AS transcribe_finished_at, min(l_shipdate)::TIMESTAMP AS embed_started_at,
  min(l_shipdate)::TIMESTAMP + to_seconds(sum(l_quantity)::BIGINT) AS embed_finished_at, CASE WHEN max(l_returnflag) = 'R' THEN min(l_shipdate)::TIMESTAMP END AS eval_started_at,
  CASE WHEN max(l_returnflag) = 'R' THEN min(l_shipdate)::TIMESTAMP + to_seconds(count(*) * 7) END AS eval_finished_at, count(*) FILTER (WHERE l_discount > 0.02) AS embed_chunk_count, count(*) FILTER (WHERE l_discount > 0.05) AS eval_chunks
  FROM lineitem GROUP BY 1)"""
FORECAST = f"""{JOBS}, {EVENTS}, {RUNS}, recent AS (SELECT runs.* FROM runs JOIN jobs ON job_id = id WHERE status = 'done' ORDER BY updated_at DESC, job_id LIMIT 50),
rate AS (SELECT coalesce(quantile_cont((epoch_us(transcribe_finished_at) - epoch_us(transcribe_started_at)) / 1e6 / embed_chunk_count, 0.5) FILTER (WHERE embed_chunk_count > 0), 0) AS transcribe,
  coalesce(quantile_cont((epoch_us(embed_finished_at) - epoch_us(embed_started_at)) / 1e6 / embed_chunk_count, 0.5) FILTER (WHERE embed_chunk_count > 0), 0) AS embed,
  coalesce(quantile_cont((epoch_us(eval_finished_at) - epoch_us(eval_started_at)) / 1e6 / eval_chunks, 0.5) FILTER (WHERE eval_chunks > 0 AND eval_finished_at IS NOT NULL), 0) AS evaluate,
  count(eval_finished_at) > 0 AS evaluated FROM recent),
lefts AS (SELECT round_even((SELECT count(*) FROM jobs WHERE status IN ('pending', 'claimed')) * (SELECT quantile_cont(embed_chunk_count, 0.5) FROM runs WHERE embed_chunk_count > 0), 0)::BIGINT AS chunks),
av AS (SELECT created_at, CASE WHEN stage = 'view' THEN 'idle' ELSE stage END AS reason, epoch_us(lead(created_at) OVER (ORDER BY created_at, event_id)) - epoch_us(created_at) AS gap FROM log WHERE created_at > TIMESTAMP '2024-01-28' - INTERVAL 14 DAY),
share AS (SELECT coalesce(sum(CASE WHEN reason = 'idle' THEN gap ELSE 0 END) / sum(gap), 0) AS available FROM av WHERE gap > 0),
fc AS (SELECT *, chunks * (transcribe + embed + evaluate) AS work, chunks * (transcribe + embed + evaluate) / nullif(least(available, 1), 0) AS calendar FROM rate, lefts, share)"""


def _now():
    return F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")


def _forecast(spark, sf):
    line = table(spark, sf, "lineitem")
    first = F.min("l_shipdate").cast("timestamp_ntz")
    later = lambda n: first + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18, 6)"))
    judged = F.max("l_returnflag") == "R"
    runs = line.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        first.alias("transcribe_started_at"), F.max("l_shipdate").cast("timestamp_ntz").alias("transcribe_finished_at"), first.alias("embed_started_at"), later(F.sum("l_quantity").cast("long")).alias("embed_finished_at"),
        F.when(judged, first).alias("eval_started_at"), F.when(judged, later(F.count("*") * 7)).alias("eval_finished_at"), F.count_if(F.col("l_discount") > 0.02).alias("embed_chunk_count"), F.count_if(F.col("l_discount") > 0.05).alias("eval_chunks"),
    )
    jobs = roles.jobs(spark, sf).withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))
    e = roles.pipeline_events(spark, sf)
    log = e.select("event_id", "created_at", F.lit("runner_availability").alias("stage"), F.when(F.col("stage") == "view", "idle").otherwise(F.col("stage")).alias("reason"), F.lit(None).cast("string").alias("detail"))
    return forecast.forecast(jobs, runs, log, _now())


@query(f"""WITH {FORECAST} SELECT round(transcribe, 6) AS transcribe, round(embed, 6) AS embed, round(evaluate, 6) AS evaluate, evaluated, chunks, round(available, 6) AS available,
round(work, 2) AS work, round(calendar, 2) AS calendar, work > 0 AS has_work FROM fc""")
def forecast_cohort(spark, sf):
    """Rates of the fifty jobs done last, and availability over two weeks."""
    out = _forecast(spark, sf)
    return out.select(*[F.round(c, 6).alias(c) for c in ("transcribe", "embed", "evaluate", "available")], "evaluated", "chunks", F.round("work", 2).alias("work"), F.round("calendar", 2).alias("calendar"), "has_work")


#: Hosts as servers: claims of the last week, arbiters of every third host, finished jobs of some.
HOSTS = """hosts AS (SELECT 'host' || user_id AS server, user_id, max(ts) FILTER (WHERE event_type = 'view' AND user_id % 2 = 0) AS beat, arg_max('lib/b1/t' || event_id || '.mp3', ts) FILTER (WHERE event_type = 'view') AS current_file,
  user_id % 3 = 0 AS probed, user_id % 9 > 0 AS reachable, user_id % 6 = 3 AS ready, count(*) FILTER (WHERE event_type = 'purchase' AND user_id % 5 > 0) AS jobs, max(ts) FILTER (WHERE event_type = 'purchase' AND user_id % 7 > 0) AS last_finished,
  CASE WHEN user_id % 4 > 0 THEN 'asr-' || user_id % 4 || '.5b' END AS observed_model, CASE WHEN user_id % 8 > 0 THEN 'asr' ELSE '' END AS configured_model FROM events GROUP BY user_id)"""


def _hosts(spark, sf):
    e, u = table(spark, sf, "events"), F.col("user_id")
    kind = lambda k: F.col("event_type") == k
    path = F.concat(F.lit("lib/b1/t"), "event_id", F.lit(".mp3"))
    h = e.groupBy("user_id").agg(F.max(F.when(kind("view") & (u % 2 == 0), F.col("ts"))).alias("beat"), F.max_by(path, F.when(kind("view"), F.col("ts"))).alias("current_file"), F.count_if(kind("purchase") & (u % 5 > 0)).alias("jobs"), F.max(F.when(kind("purchase") & (u % 7 > 0), F.col("ts"))).alias("last_finished"))
    return h.select(F.concat(F.lit("host"), "user_id").alias("server"), "beat", "current_file", "jobs", "last_finished", (u % 3 == 0).alias("probed"), (u % 9 > 0).alias("reachable"), (u % 6 == 3).alias("ready"),
                    F.when(u % 4 > 0, F.concat(F.lit("asr-"), u % 4, F.lit(".5b"))).alias("observed_model"), F.when(u % 8 > 0, "asr").otherwise("").alias("configured_model"))


def _ago(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 'just now' WHEN {x} < 60 THEN floor({x})::BIGINT || 's ago' WHEN {x} < 3600 THEN floor({x} / 60)::BIGINT || 'm ago' WHEN {x} < 86400 THEN floor({x} / 3600)::BIGINT || 'h ago' ELSE floor({x} / 86400)::BIGINT || 'd ago' END"


STATES = f"""{HOSTS}, g AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(beat)) / 1e6 AS b, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last_finished)) / 1e6 AS f FROM hosts),
states AS (SELECT server, jobs, CASE WHEN b <= 43200 THEN 'transcribing' WHEN b IS NOT NULL THEN 'stalled' WHEN probed AND NOT reachable THEN 'offline' WHEN probed AND ready THEN 'ready' WHEN probed THEN 'busy' WHEN jobs > 0 THEN 'idle' ELSE 'not_seen' END AS state,
  CASE WHEN b <= 43200 THEN 'transcribing ' || regexp_extract(current_file, '[^/]*$') WHEN b IS NOT NULL THEN 'claim heartbeat stale (' || {_ago("b")} || ') — runner may have crashed'
    WHEN probed AND NOT reachable THEN 'host unreachable (gpu-arbiter not responding)' WHEN probed AND ready THEN 'connected — GPU available' WHEN probed THEN 'GPU busy'
    WHEN jobs > 0 THEN CASE WHEN f IS NULL THEN 'idle — no live claim' ELSE 'idle — last active ' || {_ago("f")} END ELSE 'configured — no activity observed yet' END AS detail,
  coalesce(observed_model, nullif(configured_model, ''), '') AS model, CASE WHEN observed_model IS NOT NULL THEN 'observed' WHEN configured_model <> '' THEN 'configured' ELSE '' END AS model_source FROM g)"""


def _states(spark, sf):
    out = servers.with_models(servers.with_state(_hosts(spark, sf), F.lit("2024-01-30").cast("timestamp_ntz"), 43_200), ("model",))
    return out.select("server", "jobs", "state", "detail", "model", "model_source")


@query(f"WITH {STATES} SELECT * FROM states")
def server_states(spark, sf):
    return _states(spark, sf)


@query(f"""WITH {SNAPSHOT}, {FORECAST.replace(JOBS + ", " + EVENTS + ", ", "")}, {STATES}
SELECT pending, embed_backlog, fc.chunks, round(work, 1) AS work, round(calendar, 1) AS calendar, (SELECT count(*) FROM states) AS servers, (SELECT arg_min(state, server) FROM states) AS first_state,
  (SELECT count(*) FROM states WHERE state = 'stalled') AS stalled FROM snap, fc""")
def status_whole(spark, sf):
    """The status as JSON with forecast and servers, and read again."""
    j = service.status_json(_snapshot(spark, sf), forecast=_forecast(spark, sf), servers=_states(spark, sf))
    kind = "struct<queue:struct<pending:bigint>,lifecycle:struct<embed_backlog:bigint>,eta:struct<chunks:bigint,work:double,calendar:double>,servers:array<struct<server:string,state:string>>>"
    s = j.select(F.from_json("status", kind).alias("s"))
    return s.select("s.queue.pending", "s.lifecycle.embed_backlog", "s.eta.chunks", F.round("s.eta.work", 1).alias("work"), F.round("s.eta.calendar", 1).alias("calendar"), F.size("s.servers").cast("long").alias("servers"),
                    F.col("s.servers")[0]["state"].alias("first_state"), F.size(F.filter("s.servers", lambda x: x["state"] == "stalled")).cast("long").alias("stalled"))


@query(f"""WITH {SNAPSHOT}, {FORECAST.replace(JOBS + ", " + EVENTS + ", ", "")}, r AS (SELECT unnest([
  {{'metric': 'jobs', 'label': 'pending', 'value': pending::DOUBLE}}, {{'metric': 'jobs', 'label': 'claimed', 'value': claimed::DOUBLE}}, {{'metric': 'jobs', 'label': 'done', 'value': done::DOUBLE}}, {{'metric': 'jobs', 'label': 'failed', 'value': failed::DOUBLE}},
  {{'metric': 'embed_backlog', 'label': '', 'value': embed_backlog::DOUBLE}}, {{'metric': 'eval_coverage', 'label': '', 'value': eval_coverage_done / done}},
  {{'metric': 'heartbeat_age_seconds', 'label': '', 'value': greatest(0, (epoch_us(TIMESTAMP '2024-01-28') - epoch_us(latest_activity)) / 1e6)}}, {{'metric': 'alive_age_seconds', 'label': '', 'value': 60.0}},
  {{'metric': 'runner_available', 'label': '', 'value': runner_available::INTEGER::DOUBLE}}, {{'metric': 'eta_work_seconds', 'label': '', 'value': work}}, {{'metric': 'eta_calendar_seconds', 'label': '', 'value': calendar}}]) AS g FROM snap, fc)
SELECT g.metric, g.label, round(g.value, 2) AS value FROM r""")
def monitor_ages(spark, sf):
    rows = status.monitor(_snapshot(spark, sf), _forecast(spark, sf), _now(), _now() - F.expr("interval 1 minute"))
    return rows.withColumn("value", F.round("value", 2))


@query(f"""WITH {FINDINGS}, {JOBS}, f AS (SELECT findings.*, file_path, book_dir FROM findings JOIN jobs ON transcript_id = jobs.id)
SELECT id, confidence, file_path, book_dir, transcript_id AS job_id, start_sec FROM f WHERE starts_with(file_path, 'lib/b3/') ORDER BY confidence DESC, file_path, start_sec, id LIMIT 25""")
def findings_in_book(spark, sf):
    j = roles.jobs(spark, sf)
    f = roles.findings(spark, sf).join(j.select(F.col("id").alias("transcript_id"), "file_path"), "transcript_id")
    return findings.listed(f, j, "lib/b3", 25).select("id", "confidence", "file_path", "book_dir", "job_id", "start_sec")


@query(f"""WITH {FINDINGS}, f AS (SELECT id, max(patch_state) AS s FROM findings GROUP BY 1), r AS (SELECT *, id // 7 % 2 = 0 AND s = 'accepted' OR id // 7 % 2 = 0 AND s = 'applied' AS ok FROM f)
SELECT id, CASE WHEN ok THEN 'applied' ELSE s END AS patch_state, CASE WHEN ok THEN 'was ' || id END AS applied_before_text, CASE WHEN ok THEN 'is ' || id END AS applied_after_text, CASE WHEN ok THEN TIMESTAMP '2024-01-28' END AS applied_at FROM r""")
def applied_marked(spark, sf):
    f = roles.findings(spark, sf).groupBy("id").agg(F.max("patch_state").alias("patch_state"))
    told = f.where(F.floor(F.col("id") / 7) % 2 == 0).select("id", F.concat(F.lit("was "), "id").alias("before"), F.concat(F.lit("is "), "id").alias("after"))
    return findings.mark_applied(f, told, _now()).withColumn("applied_at", F.col("applied_at").cast("timestamp_ntz"))


@query(f"""WITH {JOBS}, {RUNS}, c AS (SELECT list({{'i': l_linenumber, 'n': length(l_returnflag || l_linestatus)}} ORDER BY l_linenumber, l_quantity) AS x FROM lineitem WHERE l_orderkey = 7)
SELECT jobs.id, file_path, status, attempts, claimed_by, job_id IS NOT NULL AS has_transcript, (epoch_us(transcribe_finished_at) - epoch_us(transcribe_started_at)) / 1e6 AS processing_seconds, embed_chunk_count,
  coalesce(len(x), 0)::BIGINT AS chunks, x[1].i AS first_chunk, list_sum(list_transform(x, lambda e: e.n))::BIGINT AS chars FROM jobs LEFT JOIN runs ON job_id = jobs.id, c WHERE jobs.id = 7""")
def track_whole(spark, sf):
    """One track with its run and its chunks."""
    line = table(spark, sf, "lineitem")
    t = line.select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("job_id")).distinct()
    m = line.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min("l_shipdate").cast("timestamp_ntz").alias("transcribe_started_at"), F.max("l_shipdate").cast("timestamp_ntz").alias("transcribe_finished_at"), F.count_if(F.col("l_discount") > 0.02).alias("embed_chunk_count"))
    c = line.select(F.col("l_orderkey").alias("transcript_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_quantity").alias("start_sec"), F.col("l_quantity").alias("end_sec"), F.lit("s").alias("speaker"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.lit(False).alias("embedding_stale"))
    d = service.track_detail(roles.jobs(spark, sf), t, m, c, 7)
    chars = F.aggregate(F.transform("chunks", lambda x: x["chars"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("id", "file_path", "status", "attempts", "claimed_by", "has_transcript", "processing_seconds", "embed_chunk_count", F.size("chunks").cast("long").alias("chunks"), F.col("chunks")[0]["chunk_index"].alias("first_chunk"), chars.alias("chars"))


@query("""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'media/books/' || c_mktsegment || '/' || c_name || ' [B0ABCDEF12]/t1.mp3' WHEN 1 THEN 'other/' || c_mktsegment || '/' || c_name || '/cd1.mp3' ELSE 'media/' || c_name || '/t2.mp3' END AS path,
  c_mktsegment, c_name FROM customer)
SELECT id, path, CASE id % 3 WHEN 2 THEN 'media' ELSE c_mktsegment END AS author, c_name AS title FROM p""")
def path_labels(spark, sf):
    """Author and title from a track's place under a root, or else from its last two directories."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey") % 3
    path = F.when(k == 0, F.concat(F.lit("media/books/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(" [B0ABCDEF12]/t1.mp3"))).when(k == 1, F.concat(F.lit("other/"), "c_mktsegment", F.lit("/"), "c_name", F.lit("/cd1.mp3"))).otherwise(F.concat(F.lit("media/"), "c_name", F.lit("/t2.mp3")))
    rows = c.select(F.col("c_custkey").alias("id"), path.alias("path"))
    return rows.withColumn("l", tx.author_and_title(F.col("path"), ["media", "media/books"])).select("id", "path", "l.author", "l.title")
