"""The session that tests, bench and examples share."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch, or one row if that has more; the operations for training text set the same.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession | None = None) -> None:
    """Bound the Arrow batches of a session by bytes, not by rows alone. Who has a DataFrame gives its session: a thread
    needn't have an active one, nor need the active one be that of the rows. Without one it is the active or shared one."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def local_session(cores: str = "8", app: str = "sonoshelf", memory: str = "12g") -> SparkSession:
    """A local session with AQE, UTC and as many shuffle partitions as cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
