"""Top-k, latest-value and numbering helpers that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netlantern.plans.sizing import checkpointed

SALTS = 64
#: About so many rows are sorted by one task.
RANGE_ROWS = 200_000


def row_limit(limit: int | str | None, default: int, most: int | None = None) -> int:
    """The requested number of rows, the default when absent; above ``most``, if given, an error."""
    asked = int(limit) if limit not in (None, "") else default
    if most is not None and asked > most:
        raise ValueError(f"{asked} rows were asked for; at most {most} are given")
    return asked


def top_k(df: DataFrame, k: int, keys: list[str], count: str = "count") -> DataFrame:
    """The k rows with the highest count; equal counts are ordered by the keys."""
    return df.orderBy(F.desc(count), *[F.asc_nulls_first(c) for c in keys]).limit(k)


def top_k_per(
    df: DataFrame, k: int, by: list[str], keys: list[str], count: str = "count"
) -> DataFrame:
    """The k best rows of each group. Each task forwards at most k rows of a group."""
    order = W.partitionBy(*by).orderBy(F.desc(count), *[F.asc_nulls_first(c) for c in keys])
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def newest_per_key(rows: DataFrame, key: str, n: int, spread: str = "id") -> DataFrame:
    """The n newest rows of each key by (received_at, id).

    A hot key is first cut down within salted groups, so the last step sees few rows of it.
    """
    newest = [F.desc("received_at"), F.desc("id")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    first = W.partitionBy(key, "_salt").orderBy(*newest)
    last = W.partitionBy(key).orderBy(*newest)
    return (
        salted.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= n)
        .drop("_salt")
        .withColumn("_rank", F.row_number().over(last))
        .filter(F.col("_rank") <= n)
    )


def aggregate_with_latest(
    rows: DataFrame,
    keys: list[str],
    latest: list[str],
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Per key: ``count``, ``lastSeen``, summed measures, and the ``latest`` columns as they were
    on the newest row (NULL if they were NULL there).

    The latest columns of a key take few distinct values, so they are grouping columns of a first
    aggregate, which keeps the newest (time, id) of each version; only its small result goes through
    the sort-based ``max_by``. Nothing of a hot key travels beyond its partial counts. Of two rows at
    the same instant the one with the larger id is the newer.
    """
    measures = measures or {}
    # (time, id) as one number, which a hash aggregate can keep: ids differ by less than 2**64.
    micros = F.unix_micros("received_at").cast("decimal(19,0)")
    instant = micros * F.lit(str(2**64)).cast("decimal(20,0)") + F.col("id").cast("decimal(19,0)")
    versions = rows.groupBy(*keys, *latest).agg(
        F.count("*").alias("count"),
        F.max(instant).alias("_at"),
        F.max("received_at").alias("lastSeen"),
        *[F.sum(m.cast("bigint")).alias(name) for name, m in measures.items()],
    )
    newest = F.max_by(F.struct(*latest), F.col("_at"))
    return (
        versions.groupBy(*keys)
        .agg(
            newest.alias("_latest"),
            F.sum("count").alias("count"),
            F.max("lastSeen").alias("lastSeen"),
            *[F.sum(name).alias(name) for name in measures],
        )
        .select(
            *keys,
            *[F.col(f"_latest.{c}").alias(c) for c in latest],
            "count",
            "lastSeen",
            *measures,
        )
    )


def sequence_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number all rows ``start+1, start+2, ...`` in the given order without a one-task window.

    The rows, which are read three times, are sorted in ranges of bounded size and checkpointed, so that
    a row's partition and its place in it cannot change: they are its number once the rows of the
    partitions before are added. That table has one row per partition.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # Partition and place, the place in the lower 33 bits.
    placed = checkpointed(ranged).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.lit(start) + F.col("_before") + within)
        .drop("_part", "_before", "_place")
    )
