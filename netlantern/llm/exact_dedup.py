"""Exact duplicates, with frequent digests split off.

A Misra-Gries summary of each task finds every digest that may hold more than ``SHARE`` of the
rows; there are at most ``1 / SHARE`` of those. Each task passes on one partial winner of such a digest,
the verified winners are broadcast, and where rows are dropped those of the losers are dropped in place:
rows of frequent digests never move. All other digests are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlantern.llm.common import new_name, row_hash, rows_kept, text_or_empty, written

#: Every digest with more than this share of the rows is split off.
SHARE = 1 / 256
#: Counters of a Misra-Gries summary; the error of a count is below rows / COUNTERS.
COUNTERS = 1024
WHITE = " \t\n\x0b\x0c\r"


def text_digest() -> Column:
    return F.unhex(F.sha2(F.translate(text_or_empty(), WHITE, ""), 256))


def digested(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, points, h`` of every row, as a written table.

    The digest is the SHA-256 of the text without ASCII white space; points are the code points of
    the text as it is. A null text counts as empty.
    """
    return written(
        docs.select(
            "doc_id",
            text_digest().alias("digest"),
            F.length(text_or_empty()).alias("points"),
            row_hash().alias("h"),
        ),
        "digests",
    )


def summarise(batches: Iterator[pd.DataFrame], counters: int = COUNTERS) -> Iterator[pd.DataFrame]:
    """Misra-Gries: of each digest a count that is at most ``rows / counters`` too low."""
    held: Counter = Counter()
    for batch in batches:
        held.update(batch["digest"])
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = Counter({k: v - cut for k, v in held.items() if v > cut})
    yield pd.DataFrame({"digest": list(held), "n": list(held.values())}, columns=["digest", "n"])


def frequent(rows: DataFrame, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """``digest`` of every value with more than ``share`` of the rows.

    Summed over tasks, a count is too low by less than ``rows / counters``, so a value is only left
    out if it can't be frequent. At most ``1 / (share - 1 / counters)`` come back: 341 by default.
    """
    total = rows.count()
    least = total * (share - 1 / counters)
    summaries = rows.select("digest").mapInPandas(
        lambda batches: summarise(batches, counters), "digest binary, n long"
    )
    return summaries.groupBy("digest").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= F.lit(least)
    ).select("digest")


def winners(rows: DataFrame) -> DataFrame:
    """Per digest: its size and the row that stays: most points, then smallest doc_id (null last)."""
    same = rows.groupBy("digest", "doc_id", "points", "h").agg(F.count("*").alias("copies"))
    best = F.min(
        F.struct(
            (-F.col("points")).alias("p"), F.isnull("doc_id").alias("no_id"), "doc_id", "h", "copies"
        )
    )
    groups = same.groupBy("digest").agg(best.alias("best"), F.sum("copies").alias("group_size"))
    return groups.select(
        "digest",
        "group_size",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.h").alias("keep_h"),
        "best.copies",
    )


def frequent_winners(rows: DataFrame) -> DataFrame:
    """The same for frequent digests, written. Each task passes on one row of a digest and its count."""
    least = F.min(F.struct((-F.col("points")).alias("p"), F.isnull("doc_id").alias("no_id"), "doc_id", "h"))
    groups = rows.groupBy("digest").agg(least.alias("best"), F.count("*").alias("group_size"))
    best = groups.select(
        "digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.h").alias("keep_h")
    )
    best = written(best, "winners")
    repeats = rows.join(F.broadcast(best), "digest").filter(stays()).groupBy("digest")
    copies = repeats.agg(F.count("*").alias("copies"))
    return written(best.join(copies, "digest"), "winners")


def stays() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows of frequent digests, their winners, other rows, their winners)."""
    hot = written(frequent(rows), "frequent")
    common = rows.join(F.broadcast(hot), "digest", "left_semi")
    rest = rows.join(F.broadcast(hot), "digest", "left_anti")
    return common, frequent_winners(common), rest, winners(rest)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts
    the row with the most code points stays, then the smallest doc_id; a null doc_id comes last and
    gives a null keep_id. Rows that repeat both doc_id and text are the same document: each is
    returned, with the same answer. An empty table gives no rows; other columns are not read.
    """
    common, verified, rest, others = grouped(digested(docs))
    found = common.join(F.broadcast(verified), "digest").unionByName(rest.join(others, "digest"))
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        stays().alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, all columns as they are.

    Of rows repeated in full any one stays, though :func:`exact_groups` marks all of them.
    """
    _, verified, _, others = grouped(digested(docs))
    keepers = verified.unionByName(others).select(
        F.col("keep_id").alias("doc_id"), F.col("keep_h").alias("h"), "copies"
    )
    return rows_kept(without_losers(docs, verified), written(keepers, "keepers"))


def without_losers(docs: DataFrame, verified: DataFrame) -> DataFrame:
    """``docs`` without the rows that lose to one of the ``verified`` winners, which are broadcast."""
    if verified.isEmpty():
        return docs
    names = [new_name(docs, c) for c in ("_digest", "_keep_id", "_keep_h")]
    best = verified.select(*[F.col(c).alias(n) for c, n in zip(("digest", "keep_id", "keep_h"), names)])
    digest, keep_id, keep_h = (F.col(n) for n in names)
    best = best.withColumnRenamed(names[0], f"{names[0]}_of")
    found = docs.withColumn(names[0], text_digest()).join(
        F.broadcast(best), digest == F.col(f"{names[0]}_of"), "left"
    )
    wins = docs["doc_id"].eqNullSafe(keep_id) & (row_hash() == keep_h)
    return found.filter(F.col(f"{names[0]}_of").isNull() | wins).select(*[docs[c] for c in docs.columns])
