"""Weighted rendezvous hashing of record keys, with gapless places inside each shard.

Everything is DataFrame functions. A record goes to the shard with the smallest ``-ln(u) / weight``,
``u`` being a number in (0, 1) made of the MD5 of key and shard. Shards are scored independently, so
one more shard takes records only into itself and a changed weight moves records only to or from
that shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netlantern.llm.common import text_or_empty, written

SHARDS = 40
ROW_BYTES = 16
DIGITS = 13


def score(key: Column, shard: int, weight: float) -> Column:
    """How far a key is from a shard; exponential with rate ``weight``."""
    digest = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, DIGITS)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that a text key belongs to. A null key is the empty key.

    Of equal scores the lowest shard wins; a shard of weight 0 gets nothing.
    """
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("weights must be 0 or more, and one of them more")
    key = F.coalesce(key, F.lit(""))
    scored = [
        F.struct(score(key, shard, w).alias("far"), F.lit(shard).alias("shard"))
        for shard, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*scored))["shard"]


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, as ``slot``.

    The rows are written; a row's place in its file is then fixed, so places within a file are
    ranked in groups that are no larger than a file, and files follow one another by an offset. No
    task sees a whole shard. Rows that repeat in full get slots of their own.
    """
    placed = written(rows, "sharded").select(
        *rows.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    sizes = placed.groupBy(shard, "_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        W.partitionBy(shard).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = sizes.select(shard, "_file", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(shard, "_file").orderBy("_row")) - 1
    return (
        placed.withColumn("_within", within)
        .join(offsets, [shard, "_file"])
        .withColumn("slot", (F.col("_before") + F.col("_within")).cast("long"))
        .select(*rows.columns, "slot")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """One row per row of ``docs``, by the law ``key``: doc_id and the shards decide.

    Columns: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the text's
    bytes plus 16 and ``text_crc32`` its CRC-32, a null text counting as empty; ``grown_shard`` is
    the shard if one more of weight 1 is added. Rows of one doc_id share a shard, those without a
    doc_id too. An empty table gives no rows; other columns are not read.
    """
    key = F.col("doc_id").cast("string")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
    )
    grown = F.coalesce(key, F.lit(""))
    old, new = F.col("shard"), len(weights)
    taken = F.array_min(
        F.array(
            *[
                F.when(old == s, score(grown, s, w))
                for s, w in enumerate(weights)
                if w > 0
            ]
        )
    )
    rows = rows.withColumn(
        "grown_shard", F.when(score(grown, new, 1.0) < taken, F.lit(new)).otherwise(old)
    )
    return with_slots(rows).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
