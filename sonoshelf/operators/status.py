"""Small rollups for people: lifecycle flags, a bar of whole percents, labels of progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lifecycle(stats: DataFrame) -> DataFrame:
    """stats with coverage, committed, fully_done and activity.

    stats: pending, claimed, done, embed_backlog and evaluated (done jobs that were), as counts; paused and evaluates
    (whether evaluation is part of the pipeline); phase (idle, transcribe or analyze); probed and probe_active (what the
    GPU's arbiter says). Coverage is the evaluated share of done, -1 without evaluation. What was paused comes first,
    then what runs, then what waits, and the gap in which all is transcribed but not yet through winds down."""
    c = F.col
    coverage = F.when(~c("evaluates"), -1.0).when(c("done") > 0, c("evaluated") / c("done")).otherwise(0.0)
    out = stats.withColumn("coverage", coverage).withColumn("committed", c("phase").isin("transcribe", "analyze") | (c("probed") & c("probe_active") & (c("claimed") > 0)))
    left = (c("pending") > 0) | (c("claimed") > 0) | (c("embed_backlog") > 0)
    out = out.withColumn("fully_done", ~left & (~c("evaluates") | (c("coverage") >= 1)))
    activity = (
        F.when(c("paused"), "paused").when((c("claimed") > 0) | (c("phase") == "transcribe"), "transcribing").when(c("phase") == "analyze", "evaluating")
        .when(c("embed_backlog") > 0, "embedding").when(c("fully_done") & ~c("committed"), "idle").when(c("evaluates") & (c("coverage") >= 0) & (c("coverage") < 1), "evaluating")
        .otherwise("winding-down")
    )
    return out.withColumn("activity", activity)


def percents(counts: list[int], floor: int = 2) -> list[int]:
    """Whole percents of counts that sum to 100: cut, the rest dealt out in turn among those that have some, none of a
    count below floor, and what that adds taken from the largest."""
    total = sum(c for c in counts if c > 0)
    if total <= 0:
        return [0] * len(counts)
    out = [max(c, 0) * 100 // total for c in counts]
    some = [i for i, p in enumerate(out) if p > 0]
    for k in range(100 - sum(out) if some else 0):
        out[some[k % len(some)]] += 1
    out = [max(p, floor) if c > 0 else p for c, p in zip(counts, out, strict=True)]
    while sum(out) > 100 and (over := [i for i, p in enumerate(out) if p > floor]):
        out[max(over, key=lambda i: out[i])] -= 1
    return out


def stalled(backlog: DataFrame, embedded: DataFrame, as_of, least: int = 10, minutes: int = 10) -> DataFrame:
    """One row: whether a backlog of at least so many saw no embedding for so many minutes. embedded: created_at."""
    last = embedded.agg(F.max("created_at").alias("last"))
    quiet = F.col("last").isNull() | (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) > minutes * 60_000_000)
    return backlog.agg(F.count("*").alias("backlog")).crossJoin(last).select("backlog", "last", ((F.col("backlog") >= least) & quiet).alias("stalled"))


def gauges(jobs: DataFrame, transcripts: DataFrame, chunks: DataFrame, log: DataFrame) -> DataFrame:
    """(metric, label, value): what a monitor reads, as rows: jobs by status, backlog, coverage, events by host."""
    status = jobs.groupBy("status").agg(F.count("*").cast("double").alias("value")).select(F.lit("jobs").alias("metric"), F.col("status").alias("label"), "value")
    left = transcripts.join(chunks, "id", "left_anti").agg(F.count("*").cast("double").alias("value")).select(F.lit("backlog"), F.lit(""), "value")
    done = transcripts.join(chunks.select("id").distinct().withColumn("_c", F.lit(1)), "id", "left").agg(F.coalesce(F.avg(F.coalesce("_c", F.lit(0))), F.lit(0.0)).alias("value"))
    hosts = log.groupBy("runner_host").agg(F.count("*").cast("double").alias("value")).select(F.lit("events"), "runner_host", "value")
    return status.union(left).union(done.select(F.lit("coverage"), F.lit(""), "value")).union(hosts)


def monitor(snap: DataFrame, forecast: DataFrame, as_of: Column, alive_at: Column | None = None) -> DataFrame:
    """(metric, label, value) from the status snapshot and the forecast, a row each: what a monitor alerts on.

    A gauge that can't be told has no row: the age of the last activity without any, of the runner's sign of life before
    the first, availability before it is known, work without work and calendar time without availability. Ages aren't
    below 0."""
    age = lambda c: F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))) / 1e6)
    one = lambda metric, value, label="": F.struct(F.lit(metric).alias("metric"), F.lit(label).alias("label"), value.cast("double").alias("value"))
    told = [one("jobs", F.col(s), s) for s in ("pending", "claimed", "done", "failed")] + [
        one("embed_backlog", F.col("embed_backlog")), one("eval_coverage", F.when(F.col("done") > 0, F.col("eval_coverage_done") / F.col("done")).otherwise(0.0)),
        one("heartbeat_age_seconds", age(F.col("latest_activity"))), one("alive_age_seconds", age(alive_at if alive_at is not None else F.lit(None).cast("timestamp"))),
        one("runner_available", F.when(F.col("runner_available_known"), F.col("runner_available").cast("int"))),
        one("eta_work_seconds", F.when(F.col("has_work"), F.col("work"))), one("eta_calendar_seconds", F.col("calendar")),
    ]
    known = {"heartbeat_age_seconds": F.col("latest_activity"), "alive_age_seconds": alive_at if alive_at is not None else F.lit(None)}
    rows = snap.crossJoin(forecast.select("work", "calendar", "has_work"))  # a row each
    rows = rows.select(F.explode(F.array(*told)).alias("g"), *[v.isNotNull().alias(f"_{k}") for k, v in known.items()])
    seen = F.col("g.value").isNotNull()
    for k in known:
        seen = seen & ((F.col("g.metric") != k) | F.col(f"_{k}"))
    return rows.where(seen).select("g.*")
