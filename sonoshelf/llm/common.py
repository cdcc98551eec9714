"""What the operations share: the folder that driver and executors both see, and small column helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lookups of at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of an Arrow batch, or one row if that has more.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a new local one, as in tests; on
    a cluster that is an error, since its machines don't share local folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written inside is removed at the end; tables that outlive the block are stowed with ``outlives``."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not made]  # not by value: empty ones are equal
        remove(spark, made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for at in paths:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


def new_path(spark: SparkSession, tag: str, outlives: bool = False) -> str:
    """A path in the shared folder that nothing else uses. It belongs to the innermost temporary block, or where it
    outlives that, to the next."""
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if len(_SCOPES) > outlives:
        _SCOPES[-1 - outlives].append(at)
    return at


def stow(df: DataFrame, tag: str, outlives: bool = False, at: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder, at a new path unless one is given, and read it back, which cuts the
    lineage durably."""
    spark, at = df.sparkSession, at or new_path(df.sparkSession, tag, outlives)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for tables that hold some very long texts. It is the same bound for every
    operation, so plans that run later aren't affected by which was built last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these which no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


_HELD: dict[tuple, object] = {}


def held_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """What make gives, kept for the later tasks of a worker process until a task asks for something else: workers
    live on from one operation to the next, and what they hold would add up."""
    if key not in _HELD:
        release_held()
        _HELD[key] = make()
    return _HELD[key]


def release_held() -> None:
    """Let go of what an earlier operation holds in this worker process, and give the memory back."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give free memory back to the machine: workers live on, and beside them an executor's other tasks need it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
