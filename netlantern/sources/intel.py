"""The address-intelligence table and its append-only log (S7, J11 storage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlantern.schema import INTEL_FACTS, INTEL_SCHEMA


def usable_intel(intel: DataFrame) -> DataFrame:
    """Rows worth copying onto events: public, with a country or a score."""
    return intel.filter(
        ~F.coalesce("is_private", F.lit(False))
        & (F.col("geo_country").isNotNull() | F.col("abuse_score").isNotNull())
    ).select("ip", *INTEL_FACTS)


def latest_intel(rows: DataFrame, version: str | None = None) -> DataFrame:
    """The newest row of each address. Partial aggregation keeps a hot address in bounds."""
    order = ["updated_at", version] if version else ["updated_at"]
    facts = [c for c in INTEL_SCHEMA.fieldNames() if c != "ip"]
    best = F.max_by(F.struct(*facts), F.struct(*order)).alias("_row")
    return rows.groupBy("ip").agg(best).select(
        "ip", *[F.col(f"_row.{c}").alias(c) for c in facts]
    )


def append_intel(updates: DataFrame, path: str, version: int) -> None:
    """Add one version of updates to the log; writing the same version again replaces it."""
    names = INTEL_SCHEMA.fieldNames()
    updates.select(*names).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_intel(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Current intelligence: the newest row of each address, optionally as of a version."""
    schema = INTEL_SCHEMA.simpleString()[len("struct<"):-1]
    fields = ", ".join(p.replace(":", " ", 1) for p in schema.split(","))
    rows = spark.read.schema(f"{fields}, version BIGINT").parquet(path)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    return latest_intel(rows, "version")
