"""Raw-line sources: files, Kafka, or a socket relay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlantern.functions.text import not_blank, strip_blanks

LINE_SCHEMA = "id BIGINT, received_at TIMESTAMP, raw STRING"


def clean_lines(df: DataFrame) -> DataFrame:
    """Trim, drop blank lines, and stamp a receive time where the input has none."""
    if "received_at" not in df.columns:
        df = df.withColumn("received_at", F.current_timestamp())
    return df.filter(not_blank(F.col("raw"))).withColumn("raw", strip_blanks(F.col("raw")))


def read_lines(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Lines of text files, or rows of a Parquet folder with ``id, received_at, raw``.

    Text lines carry their file and a place that is theirs alone: equal lines stay apart, and the
    same files read with the same split settings give the same places.
    """
    if fmt == "text":
        return clean_lines(
            spark.read.text(path).select(
                F.col("value").alias("raw"),
                F.col("_metadata.file_path").alias("source"),
                F.monotonically_increasing_id().alias("offset"),
            )
        )
    return clean_lines(spark.read.schema(LINE_SCHEMA).format(fmt).load(path))


def stream_lines(spark: SparkSession, fmt: str, options: dict[str, str]) -> DataFrame:
    """A stream of raw lines from files (``text``, ``parquet``), ``kafka`` or a ``socket`` relay.

    Streams of text and socket lines know no places; ingest tells their equal lines apart by batch
    and place in it.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return clean_lines(
            reader.load().select(
                F.col("value").cast("string").alias("raw"),
                F.col("timestamp").alias("received_at"),
                F.concat_ws(":", "topic", "partition").alias("source"),
                "offset",
            )
        )
    if fmt == "text":
        files = reader.load()
        return clean_lines(
            files.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source"))
        )
    if fmt == "socket":
        return clean_lines(reader.load().select(F.col("value").alias("raw")))
    return clean_lines(reader.schema(LINE_SCHEMA).load())
