"""Session settings, the shared work folder and size checks used before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a batch that a Python worker takes at once: texts, blocks and vectors are wide rows, and a batch of them
# stands in memory several times.
BATCH_BYTES = 8 << 20

# Row bound behind every explicit broadcast of a data-dependent side.  With the narrow rows that
# are broadcast here (ids, terms, counts) this stays in the tens of megabytes.
BROADCAST_ROWS = 200_000


def build_session(app: str = "evidloom", cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session in."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> None:
    """Runtime settings every operator relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # the cluster default means 200 state stores per stateful operator on one machine
        spark.conf.set("spark.sql.shuffle.partitions", str(context.defaultParallelism))


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a fresh temporary folder: on a cluster
    such a folder would not outlive the executor that wrote it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back (lineage cut, no recompute)."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most ``max_rows`` rows; never counts further than that."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The frame with a broadcast hint when its checked size allows it, and whether it did."""
    small = fits(df, max_rows)
    return (F.broadcast(df) if small else df), small
