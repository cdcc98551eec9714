"""Health of the pipeline: counts, backlogs, selections for the next batch, hosts, availability and time left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoshelf.functions.text import book_dir, contains_exact

STATUSES = ("pending", "claimed", "done", "failed")
MOST_ATTEMPTS = 3


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps without a zone."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def status_counts(jobs: DataFrame) -> DataFrame:
    """One row: the jobs of each status and all."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def backlog(transcripts: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Transcripts without any chunk."""
    return transcripts.join(chunks, key, "left_anti")


def pipeline_buckets(jobs: DataFrame, evaluated: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: jobs waiting, running, failed, and done ones by what they still lack. The two tables (id) are flags."""
    flags = jobs.join(evaluated.select("id").distinct().withColumn("e", F.lit(True)), "id", "left").join(embedded.select("id").distinct().withColumn("c", F.lit(True)), "id", "left")
    has_e, has_c, done = F.col("e").isNotNull(), F.col("c").isNotNull(), F.col("status") == "done"
    return flags.agg(
        F.count_if(F.col("status") == "pending").alias("waiting"), F.count_if(F.col("status") == "claimed").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(done & ~has_e & ~has_c).alias("transcribed"), F.count_if(done & has_e & ~has_c).alias("evaluated"), F.count_if(done & has_c).alias("embedded"),
    )


def next_batch(transcripts: DataFrame, evaluated: DataFrame, embedded: DataFrame, *, want_evaluated: bool, limit: int = 32) -> DataFrame:
    """The oldest transcripts without chunks, those with an evaluation or those without; the two sets are disjoint."""
    left = transcripts.join(embedded, "id", "left_anti")
    left = left.join(evaluated, "id", "left_semi" if want_evaluated else "left_anti")
    return left.orderBy("created_at", "id").limit(limit)


def stale_transcripts(transcripts: DataFrame, chunks: DataFrame, limit: int = 32) -> DataFrame:
    """The oldest transcripts with a chunk whose embedding is stale."""
    return transcripts.join(chunks.where("embedding_stale"), "id", "left_semi").orderBy("created_at", "id").limit(limit)


# Fixed values of the audit log: who writes, and (stage, event, reason) of what it tells.
MONITOR, WORKER = "go-monitor", "go-worker"
RETRY = ("requeue", "retry", "stale claim recovered (heartbeat expired); retryable")
DISCARD = ("fail", "error", "max attempts reached after stale-claim recovery; discarded")
OPERATOR = ("requeue", "retry", "operator requeue (re-transcribe)")
NO_ATTEMPTS = "max attempts reached"


def audit_event(told: tuple[str, str, str], host: str) -> list[Column]:
    return [F.lit(v).alias(c) for c, v in zip(("stage", "event", "reason"), told, strict=True)] + [F.lit(host).alias("runner_host")]


def recovered(jobs: DataFrame, as_of: Column, timeout_s: int = 1800) -> DataFrame:
    """jobs after stale claims are let go, with stale: those with attempts left are pending, without claimed_by and
    claimed_at; the others failed, with an error."""
    stale = (F.col("status") == "claimed") & (seconds(as_of, F.col("updated_at")) > timeout_s)
    free, spent = F.col("stale") & (F.col("attempts") < MOST_ATTEMPTS), F.col("stale") & (F.col("attempts") >= MOST_ATTEMPTS)
    out = jobs.withColumn("stale", F.coalesce(stale, F.lit(False)))
    changed = {"status": F.when(free, "pending").when(spent, "failed").otherwise(F.col("status"))}
    changed |= {c: F.when(~free, F.col(c)) for c in ("claimed_by", "claimed_at") if c in jobs.columns}
    changed["error"] = F.when(spent, NO_ATTEMPTS).otherwise(F.col("error") if "error" in jobs.columns else F.lit(None))
    return out.withColumns(changed)


def recovery_events(after: DataFrame) -> DataFrame:
    """The audit events of what recovered has let go: (job_id, file_path, attempt, stage, event, reason, runner_host)."""
    told = lambda what: [F.col("id").alias("job_id"), "file_path", F.col("attempts").alias("attempt"), *audit_event(what, WORKER)]
    gone = after.where("stale")
    return gone.where(F.col("status") == "pending").select(*told(RETRY)).unionByName(gone.where(F.col("status") == "failed").select(*told(DISCARD)))


def claimable(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The oldest pending jobs with attempts left."""
    return jobs.where((F.col("status") == "pending") & (F.col("attempts") < MOST_ATTEMPTS)).orderBy("created_at", "id").limit(n)


def hosts(log: DataFrame) -> DataFrame:
    """One row a host: its events, and the latest value of what it told, whether or not the last event had one."""
    at = F.struct("created_at", "event_id")
    return log.groupBy("runner_host").agg(
        F.count("*").alias("events"), F.avg("duration").alias("avg_duration"), F.max("created_at").alias("last_seen"), F.max_by("stage", at).alias("last_stage"),
        F.expr("max_by(duration, struct(created_at, event_id)) FILTER (WHERE stage = 'purchase')").alias("last_purchase"),
    )


def changes(log: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """The events at which value differs from the one before: consecutive repeats are dropped.

    Without by, the log is one sequence: each day is looked at by itself, and its first event is held against the last
    one of the day before it, which are a row a day."""
    if by:
        w = Window.partitionBy(by).orderBy("created_at", "event_id")
        return log.withColumn("_before", F.lag(value).over(w)).where(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")
    days = log.withColumn("_day", F.to_date("created_at"))
    ends = days.groupBy("_day").agg(F.max_by(F.struct(F.col(value).alias("value")), F.struct("created_at", "event_id")).alias("last"))
    ends = ends.select("_day", F.lag("last").over(Window.orderBy("_day")).alias("_last"))
    w = Window.partitionBy("_day").orderBy("created_at", "event_id")
    rows = days.withColumn("_first", F.row_number().over(w) == 1).withColumn("_before", F.lag(value).over(w)).join(F.broadcast(ends), "_day")
    rows = rows.withColumn("_before", F.when(F.col("_first"), F.col("_last.value")).otherwise(F.col("_before")))
    return rows.where(~F.col("_before").eqNullSafe(F.col(value))).select(log.columns)


def availability(log: DataFrame, state: str, by: str, idle: str) -> DataFrame:
    """(by, available): the share of the time between events that began with the idle state. The time after a group's
    last event is left out, and so are gaps that aren't positive; with fewer than two events it is 0."""
    w = Window.partitionBy(by).orderBy("created_at", "event_id")
    gap = seconds(F.lead("created_at").over(w), F.col("created_at"))
    gaps = log.withColumn("gap", gap).where("gap > 0").groupBy(by).agg(F.sum(F.when(F.col(state) == idle, F.col("gap")).otherwise(0.0)).alias("on"), F.sum("gap").alias("all"))
    return log.select(by).distinct().join(gaps, by, "left").select(by, F.coalesce(F.col("on") / F.col("all"), F.lit(0.0)).alias("available"))


def overall_availability(log: DataFrame, state: str, by: str, idle: str) -> DataFrame:
    """One row: the idle share of all groups' time together."""
    w = Window.partitionBy(by).orderBy("created_at", "event_id")
    gaps = log.withColumn("gap", seconds(F.lead("created_at").over(w), F.col("created_at"))).where("gap > 0")
    return gaps.agg(F.coalesce(F.sum(F.when(F.col(state) == idle, F.col("gap")).otherwise(0.0)) / F.sum("gap"), F.lit(0.0)).alias("available"))


def rates(log: DataFrame, stages: dict[str, str], last: int = 50) -> DataFrame:
    """One row: the median duration of each stage over its last events."""
    w = Window.partitionBy("stage").orderBy(F.desc("created_at"), F.desc("event_id"))
    recent = log.where(F.col("stage").isin(list(stages.values()))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    return recent.agg(*[F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY duration) FILTER (WHERE stage = '{s}')").alias(k) for k, s in stages.items()])


def time_left(row: DataFrame) -> DataFrame:
    """work and calendar seconds from chunks, transcribe, embed, evaluate (seconds a chunk) and available; rates that
    aren't positive numbers count as 0, and without availability the calendar time is unknown."""
    good = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c)).otherwise(0.0)
    work = F.greatest(F.col("chunks"), F.lit(0)) * (good("transcribe") + good("embed") + good("evaluate"))
    share = F.least(good("available"), F.lit(1.0))
    return row.withColumn("work", work).withColumn("calendar", F.when(share > 0, work / share))


def keep_best(jobs: DataFrame) -> DataFrame:
    """One job a path: done before claimed before pending before others, then the oldest."""
    rank = F.when(F.col("status") == "done", 0).when(F.col("status") == "claimed", 1).when(F.col("status") == "pending", 2).otherwise(3)
    w = Window.partitionBy("file_path").orderBy(rank, "created_at", "id")
    return jobs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new that share no key with existing, one for each key value: the first by the keys' order."""
    for k in keys:
        new = new.join(existing.select(k), k, "left_anti").select(new.columns)
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(k).orderBy(*keys))).where("_n = 1").drop("_n")
    return new


def upsert(old: DataFrame, new: DataFrame, key: list[str], replace: list[str], keep_if_null: list[str]) -> DataFrame:
    """old with the rows of new: replace columns take new values, keep_if_null ones only where those aren't null, and
    all others keep the old value where there is one."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    pick = {c: F.coalesce(f"o.{c}", f"n.{c}") for c in old.columns}
    pick |= {c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in replace}
    pick |= {c: F.coalesce(f"n.{c}", f"o.{c}") for c in keep_if_null}
    return both.select(*[pick[c].alias(c) for c in old.columns])


def completed_at(history: DataFrame) -> DataFrame:
    """(job, completed_at): the last time a job turned to done, null if it has left it since. history: job, status, at."""
    w = Window.partitionBy("job").orderBy("at")
    turned = history.withColumn("before", F.lag("status").over(w))
    last = F.max_by("status", "at")
    return turned.groupBy("job").agg(F.when(last == "done", F.max(F.when((F.col("status") == "done") & ~F.col("before").eqNullSafe(F.lit("done")), F.col("at")))).alias("completed_at"))


def requeued(jobs: DataFrame, transcripts: DataFrame, chunks: DataFrame, metrics: DataFrame, chosen: Column, as_of: Column) -> dict[str, DataFrame]:
    """The four tables after the chosen jobs are set back at as_of: they are pending without attempts, error or claim, and
    their transcripts, chunks and metrics go."""
    ids = jobs.where(chosen).select("id")
    gone = transcripts.join(ids.withColumnRenamed("id", "job_id"), "job_id", "left_semi")
    hit = jobs.join(ids.distinct().withColumn("_hit", F.lit(True)), "id", "left")
    values = {"status": F.lit("pending"), "attempts": F.lit(0), "error": F.lit(None), "claimed_by": F.lit(None), "claimed_at": F.lit(None), "updated_at": as_of}
    reset = hit.withColumns({c: F.when(F.col("_hit"), v.cast(t)).otherwise(F.col(c)) for c, t in jobs.dtypes if (v := values.get(c)) is not None})
    return {
        "jobs": reset.select(jobs.columns),
        "transcripts": transcripts.join(gone.select("id"), "id", "left_anti"),
        "chunks": chunks.join(gone.select(F.col("id").alias("transcript_id")), "transcript_id", "left_anti"),
        "metrics": metrics.join(ids.withColumnRenamed("id", "job_id"), "job_id", "left_anti"),
    }


def requeue_events(jobs: DataFrame, chosen: Column) -> DataFrame:
    """The audit events of setting the chosen jobs back: (job_id, file_path, stage, event, reason, runner_host)."""
    return jobs.where(chosen).select(F.col("id").alias("job_id"), "file_path", *audit_event(OPERATOR, MONITOR))


def by_path(part: str) -> Column:
    """Jobs whose path holds part, in any case; its characters stand for themselves."""
    return contains_exact(F.col("file_path"), part)


def by_status(status: str = "failed") -> Column:
    return F.col("status") == status


def by_directory(directory: str) -> Column:
    """The tracks right in a directory."""
    return F.col("file_path").startswith(directory + "/") & (book_dir(F.col("file_path")) == directory)


def reembedded(chunks: DataFrame, transcripts: DataFrame, chosen: Column) -> DataFrame:
    """chunks without those of the chosen transcripts, which thus are to be embedded again."""
    return chunks.join(transcripts.where(chosen).select(F.col("id").alias("transcript_id")), "transcript_id", "left_anti")


SERVER = "server string, configured boolean, live string, host string, jobs long, last_seen timestamp_ntz"


def matched_servers(configured: list[str], live: list[tuple], hosts: list[tuple]) -> list[tuple]:
    """Rows of SERVER. Each configured token, in turn, takes the freshest live runner (name, heartbeat) that is left and
    holds it, and all hosts (name, jobs, finished) that are left and hold it, of which it shows the last to finish.
    Runners that are left take, in turn, the last to finish of the hosts that are left and whose names they hold, with
    the jobs of all those; then come the hosts that are left."""
    runners, machines, out = list(live), list(hosts), []
    late = lambda h: (h[2] is not None, h[2])
    for token in configured:
        t = token.lower()
        mine = [r for r in runners if t and t in r[0].lower()]
        runner = max(mine, key=lambda r: r[1]) if mine else None
        own = [h for h in machines if t and t in h[0].lower()]
        host = max(own, key=late) if own else None
        if runner:
            runners.remove(runner)
        machines = [h for h in machines if h not in own]
        out.append((token, True, runner and runner[0], host and host[0], sum(h[1] for h in own), runner[1] if runner else host and host[2]))
    for name, beat in runners:
        own = [h for h in machines if h[0] and h[0].lower() in name.lower()]
        host = max(own, key=late) if own else None
        if host:
            machines.remove(host)
        out.append((name, False, name, host and host[0], sum(h[1] for h in own), beat))
    return out + [(h[0], False, None, h[0], h[1], h[2]) for h in machines]


def server_view(configured: list[str], live: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row a server of a fleet: live (name, last_seen) and hosts (name, jobs, last_seen), a row a machine each, which
    are put together in one task since a machine that one server takes is gone for the next. Both are sorted by name."""
    machine = F.struct("name", "kind", "jobs", "last_seen")
    rows = live.select("name", F.lit("live").alias("kind"), F.lit(0).cast("long").alias("jobs"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))
    rows = rows.unionByName(hosts.select("name", F.lit("host").alias("kind"), F.col("jobs").cast("long").alias("jobs"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen")))

    def run(frames):
        for f in frames:
            for found in f["m"]:
                m = sorted(found, key=lambda x: x["name"])
                served = matched_servers(configured, [(x["name"], x["last_seen"]) for x in m if x["kind"] == "live"], [(x["name"], x["jobs"], x["last_seen"]) for x in m if x["kind"] == "host"])
                yield pd.DataFrame(served, columns=["server", "configured", "live", "host", "jobs", "last_seen"])

    return rows.agg(F.collect_list(machine).alias("m")).mapInPandas(run, SERVER)


def books_of(jobs: DataFrame) -> DataFrame:
    return jobs.select(book_dir(F.col("file_path")).alias("book_dir")).distinct()
