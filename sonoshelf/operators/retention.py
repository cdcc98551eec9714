"""An event log that forgets its heartbeats by dropping directories.

Events lie by whether they may go (heartbeats and availability, which are frequent) and by day. Pruning drops the
directories of whole days before the cut-off, rewrites that of the cut-off's own day, and touches nothing else: stage
events are kept for good and never read.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoshelf.sources.scratch import remove

# The stages that may go, and after how many days.
PRUNED, DAYS = ("heartbeat", "runner_availability"), 180


def append_events(events: DataFrame, path: str) -> None:
    """Add events (stage, created_at, and others) to the log at path. An event without a time is never pruned."""
    rows = events.withColumn("prunable", F.coalesce(F.col("stage").isin(*PRUNED), F.lit(False))).withColumn("day", F.to_date("created_at"))
    rows.repartition("prunable", "day").write.mode("append").partitionBy("prunable", "day").parquet(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log; filters on prunable and day reach its directories."""
    return spark.read.schema(f"{schema}, prunable boolean, day date").parquet(path)


def _days(spark: SparkSession, path: str) -> dict[date, str]:
    """The days that have prunable events, with their directories: as many as there are days."""
    jvm = spark._jvm.org.apache.hadoop.fs
    top = jvm.Path(f"{path}/prunable=true")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
    return {date.fromisoformat(p.getName().removeprefix("day=")): p.toString() for p in names if p.getName().startswith("day=") and p.getName()[4].isdigit()}


def prune(spark: SparkSession, path: str, schema: str, as_of: datetime, days: int = DAYS) -> int:
    """Remove prunable events of more than so many days before as_of (in the session's time zone), and say how many."""
    cut = as_of - timedelta(days=days)
    found = _days(spark, path)
    if not found:
        return 0
    whole = sorted(d for d in found if d < cut.date())
    log = read_events(spark, path, schema).where("prunable")
    gone = log.where(F.col("day").isin(whole)).count() if whole else 0  # from the files' footers
    if cut.date() in found:
        edge = log.where(F.col("day") == cut.date())
        left = edge.where(F.col("created_at") >= F.lit(cut))
        n, kept = edge.count(), left.count()
        if kept == 0:
            remove(spark, found[cut.date()])
        elif kept < n:
            left.coalesce(1).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("prunable", "day").parquet(path)
        gone += n - kept
    for d in whole:
        remove(spark, found[d])
    return gone
