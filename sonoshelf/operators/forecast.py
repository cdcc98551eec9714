"""How long the rest will take: rates of the last jobs, what is left, and the share of time that the machine is free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pipeline import seconds, time_left

LAST_JOBS, WINDOW_DAYS = 50, 14
STAGE, IDLE = "runner_availability", "idle"


def last_done(jobs: DataFrame, metrics: DataFrame, n: int = LAST_JOBS) -> DataFrame:
    """The metrics of the n jobs that were done last; they are cut before anything is computed from them."""
    done = jobs.where("status = 'done'").select(F.col("id").alias("job_id"), F.coalesce("completed_at", "updated_at").alias("_ended"))
    return metrics.join(done, "job_id").orderBy(F.desc_nulls_first("_ended"), "job_id").limit(n).drop("_ended")


def cohort_rates(jobs: DataFrame, metrics: DataFrame, n: int = LAST_JOBS) -> DataFrame:
    """One row: the median seconds a chunk of transcribing, embedding and evaluating over the last n done jobs, 0 where
    none tells, and whether any of them was evaluated. Evaluation is counted by its own chunks."""

    def rate(stage: str, chunks: str) -> Column:
        start, end, per = F.col(f"{stage}_started_at"), F.col(f"{stage}_finished_at"), F.col(chunks)
        told = F.when(per > 0, seconds(end, start) / per)  # a median leaves nulls out
        return F.coalesce(F.percentile(told, F.lit(0.5)), F.lit(0.0))

    return last_done(jobs, metrics, n).agg(
        rate("transcribe", "embed_chunk_count").alias("transcribe"), rate("embed", "embed_chunk_count").alias("embed"), rate("eval", "eval_chunks").alias("evaluate"),
        (F.count("eval_finished_at") > 0).alias("evaluated"),
    )


def chunks_left(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: the jobs that wait or run times the median number of chunks of those that have some, to a whole number."""
    waiting = jobs.agg(F.count_if(F.col("status").isin("pending", "claimed")).alias("n"))
    usual = metrics.agg(F.coalesce(F.percentile(F.when(F.col("embed_chunk_count") > 0, F.col("embed_chunk_count")), F.lit(0.5)), F.lit(0.0)).alias("m"))
    return waiting.crossJoin(usual).select(F.rint(F.col("n") * F.col("m")).cast("long").alias("chunks"))  # a row each


def idle_share(log: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """One row: the share of the time between availability events of the last days that began idle, 0 with fewer than two
    of them or no time between. The event's detail names the reason, else its own. The time after the last one is open.

    Each day is looked at by itself, and its last event ends with the first one of the next day that has any."""
    reason = F.coalesce(F.get_json_object("detail", "$.reason"), "reason", F.lit(""))
    rows = log.where((F.col("stage") == STAGE) & (F.col("created_at") > as_of - F.make_dt_interval(F.lit(days)))).select("created_at", "event_id", reason.alias("reason"), F.to_date("created_at").alias("day"))
    firsts = rows.groupBy("day").agg(F.min("created_at").alias("first"))
    nexts = firsts.select("day", F.lead("first").over(Window.orderBy("day")).alias("then"))  # a row a day
    w = Window.partitionBy("day").orderBy("created_at", "event_id")
    ends = rows.withColumn("end", F.lead("created_at").over(w)).join(F.broadcast(nexts), "day")
    gap = seconds(F.coalesce("end", "then"), F.col("created_at"))
    gaps = ends.withColumn("gap", gap).where("gap > 0")
    return gaps.agg(F.coalesce(F.sum(F.when(F.col("reason") == IDLE, F.col("gap")).otherwise(0.0)) / F.sum("gap"), F.lit(0.0)).alias("available"))


def forecast(jobs: DataFrame, metrics: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """One row: chunks, rates, available, work and calendar seconds, evaluated, and has_work."""
    row = cohort_rates(jobs, metrics).crossJoin(chunks_left(jobs, metrics)).crossJoin(idle_share(log, as_of))  # a row each
    return time_left(row).withColumn("has_work", F.col("work") > 0)
