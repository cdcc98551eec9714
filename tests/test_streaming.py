"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from sonoshelf.operators import pipeline
from sonoshelf.streaming import jobs

DATA = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(DATA).orderBy("ts", "event_id")
    rows = e.collect()
    for k in range(3):
        part = spark.createDataFrame(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], e.schema)
        part.coalesce(1).write.parquet(f"{at}/{k}")
        for f in (at / str(k)).glob("part-*.parquet"):
            f.rename(at / f"{k}.parquet")
    return at


def test_throughput(spark, parts, tmp_path):
    stream = jobs.throughput(jobs.event_stream(spark, f"{parts}/*.parquet"), "view")
    q = stream.writeStream.format("memory").queryName("throughput").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = jobs.throughput(spark.read.parquet(DATA).withColumn("created_at", F.col("ts").cast("timestamp")), "view")
    assert sorted(map(tuple, spark.table("throughput").collect())) == sorted(map(tuple, batch.collect()))


def test_state_changes(spark, parts, tmp_path):
    out = str(tmp_path / "out")
    jobs.drain(jobs.state_changes(jobs.event_stream(spark, f"{parts}/*.parquet")), jobs.append_once(out), str(tmp_path / "c"))
    log = spark.read.parquet(DATA).withColumn("created_at", F.col("ts").cast("timestamp"))
    want = pipeline.changes(log, "event_type", "user_id").select("user_id", "event_type", "created_at")
    got = spark.read.parquet(out).select("user_id", "event_type", "created_at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stale_claims(spark, tmp_path):
    src = tmp_path / "beats"
    for k, rows in enumerate([[(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")], [(2, "2024-01-01 00:40:00")], [(3, "2024-01-01 00:45:00")]]):
        spark.createDataFrame(rows, "job_id long, at string").selectExpr("job_id", "cast(at as timestamp) created_at").coalesce(1).write.parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema("job_id long, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = str(tmp_path / "out")
    jobs.drain(jobs.stale_claims(stream), jobs.append_once(out), str(tmp_path / "c"))
    assert 1 in {r.job_id for r in spark.read.parquet(out).collect()}
    assert 3 not in {r.job_id for r in spark.read.parquet(out).collect()}
