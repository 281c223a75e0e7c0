"""Documents to packed training sequences: drop toxic and poor ones, drop copies, pack the rest.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. All but the last
return the columns they were given. Labels come from ``sf_dir``; a model is fitted on the stage's own
input. Texts that are null or empty are scored like any other; stages on an empty table return one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netlantern.llm import exact_dedup, near_dedup, packing, quality, toxicity
from netlantern.llm.common import forget, ship, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that differ in white space only."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that texts with a similarity of 0.8 or more in five words connect."""
    ship(spark)
    return near_dedup.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their places in sequences of at most 4096 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached=CACHED)


#: Entries of a cache generation while packing: workers also hold what earlier stages left.
CACHED = 250_000

STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

#: Scores, fingerprints and packing have no SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(spark, made)
        made = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
