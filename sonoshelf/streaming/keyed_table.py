"""A table of rows by key in Parquet that streams merge their batches into.

Rows lie in directories by the hash of their key. A merge reads the directories that a batch's keys fall into, joins them
with the batch by key and overwrites these directories only, so its cost follows the batch and not the table. A batch that
comes again changes nothing, which makes ``foreachBatch`` exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: A directory's rows are dealt over at most so many tasks.
BUCKETS, SALTS = 256, 16


class KeyedTable:
    """The table at path with these key columns, none of them null. On a key that is there, ``replace`` columns take the
    new values, ``keep_if_null`` ones only where those aren't null, and all others stay as they are."""

    def __init__(self, path: str, key: list[str], *, replace: list[str] | None = None, keep_if_null: list[str] | None = None, buckets: int = BUCKETS):
        self.path, self.key, self.buckets = path, key, buckets
        self.replace, self.keep_if_null = replace or [], keep_if_null or []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows with bucket and salt, dealt over tasks by both: rows of one key are in one task."""
        salt = F.pmod(F.shiftright(F.xxhash64(*self.key), 32), F.lit(SALTS)).cast("int")
        return rows.withColumns({"bucket": self.bucket(), "salt": salt}).repartition("bucket", "salt")

    def _write(self, dealt: DataFrame, mode: str) -> None:
        """Write rows that are dealt and in order of their buckets."""
        dealt.write.option("partitionOverwriteMode", mode).mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows")

    def create(self, rows: DataFrame) -> None:
        """Begin anew with these rows, one a key."""
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema")
        self._write(self._dealt(rows).sortWithinPartitions("bucket", *self.key).drop("salt"), "static")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows with their bucket, by which a reader may prune."""
        schema = spark.read.parquet(f"{self.path}/schema").schema
        return spark.read.schema(schema.add("bucket", IntegerType())).parquet(f"{self.path}/rows")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).drop("bucket")

    def merge(self, batch: DataFrame, order: list[str] | None = None, insert: bool = True) -> None:
        """Merge a batch. Of its rows with one key the last by ``order`` counts; rows with a null in their key go. Without
        insert, only keys that are there are touched."""
        spark, order = batch.sparkSession, order or []
        old = self.rows(spark)
        kinds, given = [(c, t) for c, t in old.dtypes if c != "bucket"], dict(batch.dtypes)
        by = [*order, *[c for c in batch.columns if c not in order and c not in self.key]]
        kept = {f"_by{k}": c for k, c in enumerate(by) if (c, given[c]) not in kinds}  # what orders rows as it came
        new = batch.dropna(subset=self.key).select(*[(F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in kinds], *[F.col(c).alias(k) for k, c in kept.items()], F.lit(True).alias("_new"))
        touched = [r.b for r in new.select(self.bucket().alias("b")).distinct().collect()]  # at most a row a bucket
        if not touched:
            return
        mine = old.where(F.col("bucket").isin(touched)).drop("bucket").withColumn("_new", F.lit(False))
        # rows are dealt once, as they will lie; a key's new rows come in order, and its old one is the last
        last = Window.partitionBy("bucket", *self.key, "salt").orderBy(F.desc("_new"), *[F.col(next((k for k, v in kept.items() if v == c), c)).desc_nulls_last() for c in by])
        whole = last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        there = ~F.last("_new").over(whole)
        before = {c: F.when(there, F.last(c).over(whole)) for c, _ in kinds if c not in self.key and c not in self.replace}
        pick = {c: F.coalesce(F.col(c), v) if c in self.keep_if_null else F.coalesce(v, F.col(c)) for c, v in before.items()}
        rows = self._dealt(mine.unionByName(new, allowMissingColumns=True))
        rows = rows.select("bucket", F.row_number().over(last).alias("_n"), there.alias("_there"), *[pick.get(c, F.col(c)).alias(c) for c, _ in kinds])
        rows = rows.where("_n = 1" if insert else "_n = 1 and _there")
        self._write(rows.select(*[c for c, _ in kinds], "bucket"), "dynamic")

    def sink(self, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
        return lambda df, batch: self.merge(df, order)


def finish_jobs(transcripts: KeyedTable, jobs: KeyedTable) -> Callable[[DataFrame, int], None]:
    """A sink for finished transcripts (job_id, finished_at, and their own columns): they are stored, and then their jobs
    are done. A failure in between is made good when the batch comes again."""

    def run(df: DataFrame, batch: int) -> None:
        transcripts.merge(df, ["finished_at"])
        done = df.groupBy("job_id").agg(F.max("finished_at").alias("completed_at"))
        jobs.merge(done.select(F.col("job_id").alias("id"), F.lit("done").alias("status"), "completed_at", F.col("completed_at").alias("updated_at"), F.lit(None).cast("string").alias("error")), insert=False)

    return run


def rebuild_stale(chunks: KeyedTable, findings: Callable[[SparkSession], DataFrame], rebuild: Callable[[DataFrame, DataFrame, int], None], clock: Callable[[SparkSession], object]) -> Callable[[DataFrame, int], None]:
    """A sink that rebuilds the chunks of transcripts (transcript_id) and then clears their stale flags.

    The time is taken before the corrections are read, and the findings are read again after the rebuild: a chunk stays
    stale if one of them was decided after that time or still waits to be applied, so no decision between reading and
    clearing is lost. rebuild gets the chunks, the findings as read first, and the batch's number. chunks must replace
    embedding_stale."""

    def run(df: DataFrame, batch: int) -> None:
        from sonoshelf.operators.findings import clear_stale

        spark = df.sparkSession
        touched = df.select("transcript_id").distinct()
        mark = F.lit(clock(spark))
        mine = chunks.read(spark).join(touched, "transcript_id", "left_semi")
        rebuild(mine, findings(spark), batch)
        chunks.merge(clear_stale(chunks.read(spark).join(touched, "transcript_id", "left_semi"), findings(spark), mark), insert=False)

    return run
