"""Keeping the optimizer from copying an expensive expression into every filter above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filters_stay_above(df: DataFrame) -> DataFrame:
    """Filters and semi-joins written after this point are evaluated on the finished columns.

    Pushing a filter through several projections replaces each column name by its expression;
    for the parse job, whose columns build on one another, that multiplies the patterns run per
    line and lets the plan itself outgrow the driver. Nothing is pushed through a projection with
    a column that is not deterministic; a condition on that column, always true, keeps it from
    being pruned. Unneeded other columns are still pruned.
    """
    return df.withColumn("_pin", F.rand(0)).filter(F.col("_pin") >= 0.0).drop("_pin")


def lineage_ends(df: DataFrame) -> DataFrame:
    """The same rows, as the output of a generator over one-element arrays.

    Join planning follows a key through projections to its source, and it too replaces names by
    expressions on the way. It does not look through a generator.
    """
    one_row = F.explode(F.array(F.struct(*df.columns))).alias("_row")
    return df.select(one_row).select("_row.*")
