"""Checked sizes, the shared scratch folder, and session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000


def is_small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a static table has at most ``max_rows`` rows; reads no more than it must."""
    return table.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(table) if is_small(table, max_rows) else table


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or our own in local runs."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_netlantern_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark._netlantern_dir = own
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


@contextmanager
def written_once(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The same rows, made once and read back from Parquet in the shared folder, for as long as the block lasts."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def configure(spark: SparkSession) -> SparkSession:
    """Run-time settings: UTC times, adaptive execution, and generated code the JVM compiles.

    The JVM never compiles a method of more than 8,000 bytes of bytecode. A projection that
    exceeds it is better split into small methods than fused into one that stays interpreted.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark
