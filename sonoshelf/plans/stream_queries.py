"""Registered queries that replay the given tables as streams with state, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoshelf.operators import retention
from sonoshelf.sources.scratch import new_folder
from sonoshelf.streaming import stateful
from sonoshelf.streaming.jobs import drain
from sonoshelf.streaming.keyed_table import KeyedTable

from . import roles
from .catalogue import query, table
from .roles import JOBS

EMPTY = {"job_id": "long", "file_path": "string", "created_at": "timestamp", "attempts": "int", "status": "string", "runner": "string", "paused": "boolean", "run_limit": "long"}


def _log(df, **columns):
    """Rows of a queue's log: columns that aren't named are null."""
    return df.select("shard", F.col("at").cast("timestamp").alias("at"), "seq", F.lit(columns.pop("kind")).alias("kind"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in EMPTY.items()])


@query(f"""WITH {JOBS}, j AS (SELECT id, file_path, attempts, id % 4 AS shard, row_number() OVER (PARTITION BY id % 4 ORDER BY created_at, id) AS n FROM jobs WHERE status = 'pending' AND attempts < 3),
p AS (SELECT user_id % 4 AS shard, 'host' || user_id AS runner, ts, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events
  WHERE event_type IN ('view', 'click') AND (user_id % 4 <> 3 OR ts >= TIMESTAMP '2024-01-15'))
SELECT j.shard, j.id AS job_id, j.file_path, p.runner AS claimed_by, p.ts AS claimed_at, j.attempts + 1 AS attempts, CASE WHEN j.shard = 1 THEN 40 - j.n END AS "left"
FROM j JOIN p ON j.shard = p.shard AND j.n = p.n WHERE j.shard <> 1 OR j.n <= 40""")
def claim_queue(spark, sf):
    """Jobs in four shards and polls for them; one shard has a budget of 40 runs, one is paused until the middle of a month."""
    j = roles.jobs(spark, sf).withColumns({"shard": F.col("id") % 4, "at": F.col("created_at"), "seq": F.col("id")})
    e = table(spark, sf, "events").where("event_type in ('view', 'click')")
    e = e.select((F.col("user_id") % 4).alias("shard"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("host"), "user_id").alias("runner"))
    told = [(1, "2000-01-01", False, 40), (3, "2000-01-01", True, None), (3, "2024-01-15", False, None)]
    c = spark.createDataFrame(told, "shard long, at string, paused boolean, run_limit long").withColumn("seq", F.lit(-1).cast("long"))
    log = _log(j, kind="job", job_id=F.col("id"), file_path=F.col("file_path"), created_at=F.col("created_at"), attempts=F.col("attempts"), status=F.col("status"))
    log = log.unionByName(_log(e, kind="poll", runner=F.col("runner"))).unionByName(_log(c, kind="control", paused=F.col("paused"), run_limit=F.col("run_limit")))
    out = stateful.replayed(spark, log, new_folder(spark, "claims"), stateful.claims)
    return out.withColumn("claimed_at", F.col("claimed_at").cast("timestamp_ntz"))


@query(f"""WITH {JOBS}, e AS (SELECT id AS job_id, created_at AS "at", 0 AS seq, 'claim' AS kind FROM jobs
  UNION ALL SELECT l_orderkey, l_shipdate::TIMESTAMP, 1, 'beat' FROM lineitem
  UNION ALL SELECT l_orderkey, max(l_shipdate)::TIMESTAMP + INTERVAL 1 DAY, 2, 'end' FROM lineitem WHERE l_orderkey IN (SELECT id FROM jobs WHERE status = 'done') GROUP BY 1),
o AS (SELECT e.* FROM e JOIN jobs ON e.job_id = jobs.id WHERE e."at" >= jobs.created_at),
g AS (SELECT *, coalesce(lead("at") OVER (PARTITION BY job_id ORDER BY "at", seq), (SELECT max("at") FROM e)) - "at" AS gap, max(kind = 'end') OVER (PARTITION BY job_id ORDER BY "at", seq) AS ended FROM o),
f AS (SELECT job_id, min("at") AS updated_at FROM g WHERE gap > INTERVAL 30 DAY AND NOT ended GROUP BY 1),
r AS (SELECT f.*, file_path, attempts, claimed_by, attempts < 3 AS free FROM f JOIN jobs ON f.job_id = jobs.id)
SELECT job_id, file_path, attempts, updated_at, 'job' AS record, CASE WHEN free THEN 'pending' ELSE 'failed' END AS status, CASE WHEN NOT free THEN claimed_by END AS claimed_by,
  CASE WHEN NOT free THEN 'max attempts reached' END AS error, NULL AS stage, NULL AS event, NULL AS runner_host, NULL AS reason FROM r
UNION ALL SELECT job_id, file_path, attempts, updated_at, 'event', NULL, NULL, NULL, CASE WHEN free THEN 'requeue' ELSE 'fail' END, CASE WHEN free THEN 'retry' ELSE 'error' END, 'go-worker',
  CASE WHEN free THEN 'stale claim recovered (heartbeat expired); retryable' ELSE 'max attempts reached after stale-claim recovery; discarded' END FROM r""")
def heartbeat_recovery(spark, sf):
    """Jobs are claimed when ordered and beat when parts are shipped; those that are silent for 30 days are let go."""
    j = roles.jobs(spark, sf)
    none = F.lit(None)
    row = lambda job, at, seq, kind, attempts=none, path=none, by=none: [job.alias("job_id"), at.cast("timestamp").alias("at"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), attempts.cast("int").alias("attempts"), path.cast("string").alias("file_path"), by.cast("string").alias("claimed_by")]
    line = table(spark, sf, "lineitem")
    log = j.select(*row(F.col("id"), F.col("created_at"), 0, "claim", F.col("attempts"), F.col("file_path"), F.col("claimed_by")))
    log = log.unionByName(line.select(*row(F.col("l_orderkey"), F.col("l_shipdate"), 1, "beat")))
    last = line.join(j.where("status = 'done'").select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at"))
    log = log.unionByName(last.select(*row(F.col("l_orderkey"), F.col("at").cast("timestamp") + F.expr("interval 1 day"), 2, "end")))
    out = stateful.replayed(spark, log, new_folder(spark, "beats"), lambda s: stateful.recoveries(s, 30 * 86_400, "0 seconds"))
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT 'lib/u' || user_id || '.mp3' AS path, ts AS "at", length(event_type) AS length FROM events),
o AS (SELECT *, min("at") OVER (PARTITION BY path) + INTERVAL 5 DAY AS cap, lag(length, 1) OVER w AS a, lag(length, 2) OVER w AS b, lag(length, 3) OVER w AS c FROM e WINDOW w AS (PARTITION BY path ORDER BY "at", length)),
s AS (SELECT path, min("at") AS "at", arg_min(length, "at") AS length, true AS settled FROM o WHERE length = a AND a = b AND b = c AND "at" <= cap GROUP BY path),
u AS (SELECT path, max(cap) AS "at", arg_max(length, "at") AS length, false AS settled FROM o WHERE "at" <= cap AND path NOT IN (SELECT path FROM s) GROUP BY path)
SELECT path, "at", length::BIGINT AS length, settled FROM s UNION ALL SELECT path, "at", length::BIGINT, settled FROM u WHERE "at" < (SELECT max("at") FROM e)""")
def settled_files(spark, sf):
    """Each user's events as looks at a file that grows and shrinks, five days at most."""
    e = table(spark, sf, "events")
    looks = e.select(F.concat(F.lit("lib/u"), "user_id", F.lit(".mp3")).alias("path"), F.col("ts").cast("timestamp").alias("at"), F.length("event_type").cast("long").alias("length"))
    out = stateful.replayed(spark, looks, new_folder(spark, "looks"), lambda s: stateful.settled_files(s, 3, 5 * 86_400, "0 seconds"))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT doc_id AS transcript_id, doc_id AS id, text, source AS speaker, doc_id % 2 = 0 AS embedding_stale FROM documents),
n AS (SELECT doc_id AS transcript_id, 'new: ' || text AS text, CASE WHEN doc_id % 2 = 1 THEN 'told' END AS speaker FROM documents WHERE doc_id % 3 = 0)
SELECT a.transcript_id, a.id, coalesce(n.text, a.text) AS text, coalesce(n.speaker, a.speaker) AS speaker, a.embedding_stale FROM a LEFT JOIN n USING (transcript_id)
UNION ALL SELECT 100000000 + item_id, item_id, text, NULL, false FROM benchmark""")
def merged_chunks(spark, sf):
    """Documents as chunks; a stream of new texts for a third of them, and of new chunks, comes twice."""
    d, at = table(spark, sf, "documents"), new_folder(spark, "keyed")
    chunks = KeyedTable(at, ["transcript_id"], replace=["text"], keep_if_null=["speaker"], buckets=16)
    chunks.create(d.select(F.col("doc_id").alias("transcript_id"), F.col("doc_id").alias("id"), "text", F.col("source").alias("speaker"), (F.col("doc_id") % 2 == 0).alias("embedding_stale")))
    new = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("transcript_id"), (-F.col("doc_id")).alias("id"), F.concat(F.lit("new: "), "text").alias("text"), F.when(F.col("doc_id") % 2 == 1, "told").alias("speaker"), F.lit(False).alias("embedding_stale"))
    fresh = table(spark, sf, "benchmark").select((F.col("item_id") + 100_000_000).alias("transcript_id"), F.col("item_id").alias("id"), "text", F.lit(None).cast("string").alias("speaker"), F.lit(False).alias("embedding_stale"))
    log = new.unionByName(fresh)
    log.write.parquet(f"{at}/log")
    for run in ("first", "again"):
        drain(spark.readStream.schema(log.schema).parquet(f"{at}/log"), chunks.sink(), f"{at}/{run}")
    return chunks.read(spark)


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, user_id FROM events, m WHERE NOT (event_type IN ('view', 'click') AND ts < now - INTERVAL 10 DAY)""")
def retention_days(spark, sf):
    """The log by day, from which heartbeats of over ten days before its end are pruned."""
    e, at = table(spark, sf, "events"), new_folder(spark, "retention")
    stage = F.when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "click", "runner_availability").otherwise(F.col("event_type"))
    rows = e.select("event_id", "user_id", stage.alias("stage"), F.col("ts").alias("created_at"))
    retention.append_events(rows, at)
    schema = "event_id long, user_id long, stage string, created_at timestamp_ntz"
    retention.prune(spark, at, schema, e.agg(F.max("ts")).first()[0], 10)
    return retention.read_events(spark, at, schema).select("event_id", "user_id")


@query("""WITH RECURSIVE o AS (SELECT 's' || (user_id % 20) AS service, ts, event_id, (event_id * 7) % 4 AS pending, (event_id * 5) % 3 AS claimed, (event_id * 11) % 3 AS run_limit, (event_id * 13) % 3 AS embed, (event_id * 17) % 2 AS eval,
    row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT service, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, 'ready' AS phase, 0::BIGINT AS batch, NULL::VARCHAR AS told FROM (SELECT DISTINCT service FROM o)
  UNION ALL SELECT service, n, ts, CASE WHEN next = 'ready' AND (idle OR batch >= 30) THEN 'off' WHEN next = 'ready' THEN 'transcribe' ELSE next END,
    batch + CASE WHEN next = 'ready' AND NOT idle AND batch < 30 THEN 1 ELSE 0 END,
    CASE WHEN next = 'ready' THEN CASE WHEN idle OR batch >= 30 THEN 'idle' ELSE 'transcribe' END WHEN next = 'analyze' AND phase = 'transcribe' THEN 'analyze' END
  FROM (SELECT o.service, o.n, o.ts, s.phase, s.batch, o.pending = 0 AND o.claimed = 0 AS idle, CASE WHEN s.phase = 'transcribe' AND o.claimed = 0 AND (o.run_limit = 0 OR o.pending = 0) THEN 'analyze'
    WHEN s.phase = 'analyze' AND o.embed = 0 AND o.eval = 0 THEN 'ready' ELSE s.phase END AS next FROM s JOIN o ON o.service = s.service AND o.n = s.n + 1))
SELECT service, ts AS "at", told AS phase, CASE told WHEN 'idle' THEN 0 WHEN 'transcribe' THEN 5 END::BIGINT AS run_limit, batch FROM s WHERE told IS NOT NULL""")
def phase_log(spark, sf):
    """Events as status rows of twenty services that work in batches, thirty at most."""
    e = table(spark, sf, "events")
    n = lambda k, m: (F.col("event_id") * k) % m
    service = F.concat(F.lit("s"), F.col("user_id") % 20).alias("service")
    none = F.lit(None).cast("string").alias("phase")
    status = e.select(service, F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.lit("status").alias("kind"), none, n(7, 4).alias("pending"), n(5, 3).alias("claimed"), n(11, 3).alias("run_limit"), n(13, 3).alias("embed_backlog"), n(17, 2).alias("eval_backlog"))
    start = e.select(service).distinct().select("service", F.lit("2000-01-01").cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), none)
    log = status.unionByName(start, allowMissingColumns=True)
    out = stateful.replayed(spark, log, new_folder(spark, "phases"), lambda s: stateful.phases(s, 5, 30, judges_first=True))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))
