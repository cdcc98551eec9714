"""Structured Streaming jobs: the event log as a stream, throughput, state changes, stale claims, stage by stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "30 minutes"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The files of path as they come, with created_at as a timestamp."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn("created_at", F.col("ts").cast("timestamp"))


def throughput(events: DataFrame, done: str, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events of a type in each window; those that come later than the watermark are left out."""
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    rows = events.withWatermark("created_at", LATE) if events.isStreaming else events
    return rows.where(F.col("event_type") == done).groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def state_changes(events: DataFrame) -> DataFrame:
    """(user_id, event_type, created_at) where a user's type differs from the one before, which is kept as state. Within
    a batch events are ordered by time; a batch is taken to come after the batches before it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["created_at", "event_id"])
        before = state.get[0] if state.exists else None
        shifted = rows["event_type"].shift(1, fill_value=before)
        state.update((rows["event_type"].iloc[-1],))
        kept = rows[rows["event_type"] != shifted]
        yield kept[["user_id", "event_type", "created_at"]]

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_type string, created_at timestamp", "last string", "append", GroupStateTimeout.NoTimeout)


def stale_claims(beats: DataFrame, timeout_ms: int = 30 * 60 * 1000) -> DataFrame:
    """(job_id, last_beat) of jobs from which no beat came for the timeout, by event time and a timer for each job."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = pd.Timestamp(state.get[0], unit="ms")
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_beat": [last]})
            return
        top = max(int(f["created_at"].max().timestamp() * 1000) for f in frames)
        top = max(top, state.get[0]) if state.exists else top
        state.update((top,))
        state.setTimeoutTimestamp(max(top + timeout_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [], "last_beat": pd.to_datetime([])})

    return beats.withWatermark("created_at", "0 seconds").groupBy("job_id").applyInPandasWithState(run, "job_id long, last_beat timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give all that is there to handle, batch by batch, and stop. handle sees a batch again after a failure, so it
    should write by batch number."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def every(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 3600):
    """Give what is new to handle every so many seconds, as a running query; 0 or less stops once all is given."""
    when = {"processingTime": f"{seconds} seconds"} if seconds > 0 else {"availableNow": True}
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**when).start()


def is_open(control: DataFrame, phase: str | None = None) -> bool:
    """Whether the control row (paused, phase), if there is one, lets work of a phase begin."""
    row = control.limit(1).collect()
    return not row or not (row[0].paused or (phase is not None and row[0].phase != phase))


def drain_while_open(control: Callable[[], DataFrame], stream: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str, phase: str | None = None) -> bool:
    """One run over what is there if the gate is open; whether it ran. The gate is read before a run begins, so that a
    pause starts nothing and fails nothing, and what is held back comes with the next run."""
    if not is_open(control(), phase):
        return False
    drain(stream(), handle, checkpoint)
    return True


def best_effort(side: Callable[[DataFrame, int], None], told: Callable[[Exception], None] = lambda e: None) -> Callable[[DataFrame, int], None]:
    """A side write that never fails the stream: what goes wrong is told."""

    def run(df: DataFrame, batch: int) -> None:
        try:
            side(df, batch)
        except Exception as e:  # noqa: BLE001
            told(e)

    return run


def rebuilt(decisions: DataFrame, chunks: Callable[[SparkSession], DataFrame], rebuild: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Rebuild the transcripts that new decisions (transcript_id) touch, batch by batch: rebuild gets their chunks."""

    def run(df: DataFrame, batch: int) -> None:
        touched = df.select("transcript_id").distinct()
        rebuild(chunks(df.sparkSession).join(touched, "transcript_id", "left_semi"), batch)

    drain(decisions, run, checkpoint)


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder named by its number, so a batch that comes again replaces itself."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
