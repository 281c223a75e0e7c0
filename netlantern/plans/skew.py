"""Joins that stay balanced when one key, or a missing key, holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlantern.functions.text import MARK
from netlantern.plans.sizing import is_small

# A key is hot when it holds more than one row in this many.
HOT_SHARE = 200
SPREAD = 1024


def hot_keys(rows: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than ``1/share`` of the keyed rows.

    Fewer than ``share`` keys can satisfy this, whatever the data: the result may be broadcast.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * share > total).select(key)


def spread_key(key: Column, usable: Column, spread: Column) -> Column:
    """The join key where it is usable, else one of many keys that match nothing."""
    nowhere = F.concat(F.lit(MARK), F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("string"))
    return F.when(usable, key).otherwise(nowhere)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    found: str,
    *,
    needed: Column | None = None,
    spread: str = "id",
    small: bool | None = None,
) -> DataFrame:
    """Left-join a text key to a table that has one row per key; facts arrive as struct ``found``.

    A table of checked size is broadcast (``small`` passes on a check already made). A larger one is shuffled, and then rows that need no
    lookup are spread over many partitions, and the few hot keys are looked up from a broadcast
    of those keys alone, so that no task receives more than a small share of the rows.
    """
    facts = [c for c in table.columns if c != key]
    packed = table.select(key, F.struct(*facts).alias(found))
    wanted = F.col(key).isNotNull() if needed is None else F.col(key).isNotNull() & needed
    if is_small(table) if small is None else small:
        return rows.join(F.broadcast(packed), key, "left").select(
            *rows.columns, F.when(wanted, F.col(found)).alias(found)
        )
    hot = hot_keys(rows.filter(wanted).select(key), key)
    hot_facts = packed.join(F.broadcast(hot), key, "left_semi")
    hot_side = hot.join(F.broadcast(hot_facts), key, "left").select(
        F.col(key).alias("_hot_key"), F.col(found).alias("_hot_found")
    )
    cold_side = packed.select(F.col(key).alias("_key"), F.col(found).alias("_cold_found"))
    cold = F.coalesce(wanted, F.lit(False)) & F.col("_hot_key").isNull()
    return (
        rows.join(F.broadcast(hot_side), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_cold", spread_key(F.col(key), cold, F.col(spread)))
        .join(cold_side, F.col("_cold") == F.col("_key"), "left")
        .select(
            *rows.columns,
            F.when(wanted, F.coalesce("_hot_found", "_cold_found")).alias(found),
        )
    )


def keep_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a (distinct) list of checked size, by a broadcast semi-join."""
    return rows.join(F.broadcast(listed.select(key)), key, "left_semi")
