"""The roles that the given tables play: jobs, run metrics, books, findings, transcripts.

Each role is a DataFrame and the same as the text of a SQL table expression, for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import table


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcription jobs; the customer is the book."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("claimed")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("lib/b"), "o_custkey", F.lit("/t"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".mp3")).alias("file_path"),
        status.alias("status"),
        F.concat(F.lit("host"), F.col("o_custkey") % 7).alias("claimed_by"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, cast(floor(o_totalprice) as decimal(18, 6)))")).alias("updated_at"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS id, 'lib/b' || o_custkey || '/t' || lpad(o_orderkey::VARCHAR, 8, '0') || '.mp3' AS file_path,
  CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'claimed' END AS status,
  'host' || (o_custkey % 7) AS claimed_by, o_orderdate AS created_at, o_orderdate + to_seconds(floor(o_totalprice)::BIGINT) AS updated_at,
  (o_orderkey % 5)::INTEGER AS attempts, 'lib/b' || o_custkey AS book_dir FROM orders)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has line items, as the metrics of its run."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.sum("l_quantity").cast("long").alias("word_count"),
        F.sum(F.round(F.col("l_extendedprice")).cast("long")).alias("duration_seconds"),
        F.sum("l_partkey").alias("total_tokens"),
        F.count("*").alias("embed_chunks"),
        F.min("l_shipdate").alias("started_at"),
        F.max("l_shipdate").alias("finished_at"),
        F.count_if(F.col("l_returnflag") == "R").alias("eval_findings"),
    )


METRICS = """metrics AS (SELECT l_orderkey AS job_id, sum(l_quantity)::BIGINT AS word_count, sum(round(l_extendedprice)::BIGINT)::BIGINT AS duration_seconds,
  sum(l_partkey)::BIGINT AS total_tokens, count(*) AS embed_chunks, min(l_shipdate) AS started_at, max(l_shipdate) AS finished_at,
  count(*) FILTER (WHERE l_returnflag = 'R') AS eval_findings FROM lineitem GROUP BY 1)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as book metadata."""
    c = table(spark, sf_dir, "customer")
    series = F.concat(F.lit("Saga "), "c_nationkey", F.lit(" #"), F.col("c_custkey") % 9 + 1, F.lit(", World #"), F.col("c_nationkey"))
    return c.select(
        F.concat(F.lit("lib/b"), "c_custkey").alias("book_dir"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"),
        F.when(F.col("c_custkey") % 4 > 0, series).alias("series"),
    )


BOOKS = """books AS (SELECT 'lib/b' || c_custkey AS book_dir, c_name AS title, c_mktsegment AS author,
  CASE WHEN c_custkey % 4 > 0 THEN 'Saga ' || c_nationkey || ' #' || (c_custkey % 9 + 1) || ', World #' || c_nationkey END AS series FROM customer)"""


STATES = ("proposed", "accepted", "applied", "rejected", "reverted", "stale")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings on the chunks of a job's transcript."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("transcript_id"), F.col("l_linenumber").alias("chunk_index"),
        F.col("l_quantity").alias("start_sec"), F.col("l_returnflag").alias("issue_type"), F.concat(F.lit("part"), F.col("l_partkey") % 50).alias("original_text"),
        F.concat(F.lit("supp"), F.col("l_suppkey") % 3).alias("suggested_correction"), F.round(F.col("l_discount") * 10, 1).alias("confidence"),
        F.element_at(F.array(*map(F.lit, STATES)), (F.col("l_partkey") % 6 + 1).cast("int")).alias("patch_state"), F.col("l_shipdate").alias("decided_at"),
    )


FINDINGS = """findings AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS id, l_orderkey AS transcript_id, l_linenumber AS chunk_index, l_quantity AS start_sec,
  l_returnflag AS issue_type, 'part' || (l_partkey % 50) AS original_text, 'supp' || (l_suppkey % 3) AS suggested_correction,
  round(l_discount * 10, 1) AS confidence, (['proposed', 'accepted', 'applied', 'rejected', 'reverted', 'stale'])[l_partkey % 6 + 1] AS patch_state, l_shipdate AS decided_at FROM lineitem)"""


def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the pipeline's log: users are hosts, types are stages."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("created_at"), F.concat(F.lit("host"), "user_id").alias("runner_host"), F.col("event_type").alias("stage"), F.col("value").alias("duration"), F.col("props").alias("detail"))


EVENTS = """log AS (SELECT event_id, ts AS created_at, 'host' || user_id AS runner_host, event_type AS stage, value AS duration, props AS detail FROM events)"""
