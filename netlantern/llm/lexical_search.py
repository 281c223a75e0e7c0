"""Ranked lexical search of a few items against all documents, without an index of the documents.

Method: all terms of a block of items, each between two guards, make one Aho-Corasick automaton. A text
is reduced to its terms with guards for everything else, and one scan of it finds every whole-word
occurrence; neighbours share a guard, which the automaton's overlapping matches allow. A first scan of the
documents counts them, their terms and the documents that hold each term; a second one counts each term
in each text and adds up the items' scores, and a task passes on only its best documents of each item.

Items are the query set and go to the tasks in blocks of bounded size, each block against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netlantern.llm.common import written

#: Documents returned for each item.
BEST = 50
#: A block of items weighs at most this: its terms' bytes, and ITEM_BYTES for each item's best documents.
BLOCK_BYTES = 4 << 20
ITEM_BYTES = 1024
#: Cells of the (documents, items) table that a task adds scores into at once.
CELLS = 1 << 20
#: Best documents of an item are first chosen within so many parts.
PARTS = 64

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GUARD = " "
_REDUCED = bytes(
    c if c > 0x7F or chr(c).isalnum() else ord(GUARD) for c in bytes(range(256)).lower()
)


def reduced(text: bytes) -> bytes:
    """The terms of a UTF-8 text in order, A-Z lower-cased, with a guard for every other character."""
    return text.translate(_REDUCED)


class Block:
    """A block's terms as an automaton, and the items that each term belongs to."""

    def __init__(self, terms: list[str], owners: list[list[int]]) -> None:
        self.terms = terms
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            self.automaton.add_word(f"{GUARD}{term}{GUARD}", k)
        if terms:
            self.automaton.make_automaton()
        self.sizes = np.fromiter(map(len, owners), np.int64, len(owners))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.items = np.fromiter((i for o in owners for i in o), np.int64, int(self.sizes.sum()))

    def found(self, text: bytes) -> Iterator[int]:
        """The term of every occurrence in a reduced text."""
        if not self.terms:
            return iter(())
        guarded = f"{GUARD}{text.decode('utf-8', 'replace')}{GUARD}"
        return map(itemgetter(1), self.automaton.iter(guarded))

    def scores(self, texts: list[dict[int, int]], m: list[int], weights: np.ndarray, n_items: int):
        """The (texts, items) table of scores from each text's term counts and length measure."""
        held = np.fromiter(map(len, texts), np.int64, len(texts))
        terms = np.fromiter((t for c in texts for t in c), np.int64, int(held.sum()))
        tf = np.fromiter((n for c in texts for n in c.values()), np.int64, len(terms))
        row = np.repeat(np.arange(len(texts)), held)
        part = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * np.array(m, np.int64)[row]))
        # Each occurrence once for each item of its term.
        times = self.sizes[terms]
        at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        cell = np.repeat(row, times) * n_items + self.items[np.repeat(self.first[terms], times) + at]
        total = np.zeros(len(texts) * n_items, np.int64)
        np.add.at(total, cell, np.repeat(part, times))
        return total.reshape(len(texts), n_items)


@lru_cache(2)
def _block_of(shared: Broadcast) -> Block:
    return Block(*shared.value)


class Best:
    """The best documents of each item so far; documents are pairs of (no id, id)."""

    def __init__(self, n_items: int, most: int) -> None:
        self.most, self.n_items = most, n_items
        self.least = np.ones(n_items, np.int64)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        self.kept.append((item, scores[row, item], no_id[row], ids[row]))
        self.waiting += len(row)
        if self.waiting > 2 * self.most * self.n_items + (1 << 14):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.kept:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, no_id, ids = (np.concatenate(c) for c in zip(*self.kept))
        order = np.lexsort((ids, no_id, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, int)
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        order, item = order[place < self.most], item[place < self.most]
        last = place[place < self.most] == self.most - 1
        self.least[item[last]] = score[order][last]
        self.kept = [(item, score[order], no_id[order], ids[order])]
        self.waiting = 0
        return self.kept[0]


def item_terms(items: DataFrame) -> DataFrame:
    """``no, item_id, terms, weight, block``, written: the different terms of the rows of an item."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))
    each = items.select("item_id", F.explode(terms).alias("term"))
    each = each.groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    size = F.aggregate("terms", F.lit(ITEM_BYTES), lambda a, t: a + F.octet_length(t))
    each = each.withColumn("weight", size.cast("long"))
    each = written(each.withColumn("no", F.monotonically_increasing_id()), "items")
    total = each.agg(F.sum("weight")).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    while True:
        dealt = each.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("long"))
        held = dealt.groupBy("block").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
        if blocks == 1 or held.filter((F.col("w") > BLOCK_BYTES) & (F.col("n") > 1)).isEmpty():
            return dealt
        blocks *= 2


def statistics(texts: DataFrame, shared: Broadcast, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents that hold each of the block's terms)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block_of(shared)
        documents = terms = 0
        held: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = reduced(value.as_py())
                n = len(text.split())
                if n:
                    documents += 1
                    terms += n
                    held.update(set(block.found(text)))
        rows = {-2: documents, -1: terms, **held}
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(rows, pa.int64()), "n": pa.array(rows.values(), pa.int64())}
        )

    parts = texts.select("text").mapInArrow(count, "term long, n long")
    sums = dict(parts.groupBy("term").agg(F.sum("n")).collect())  # one row for each of the block's terms
    df = np.fromiter((sums.get(k, 0) for k in range(n_terms)), np.int64, n_terms)
    return sums.get(-2) or 0, sums.get(-1) or 0, df


def term_weights(documents: int, df: np.ndarray) -> np.ndarray:
    values = (math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist())
    return np.fromiter(values, np.int64, len(df))


def best_documents(texts: DataFrame, block: list[Row], most: int) -> DataFrame:
    """``no, score, doc_id``: at least the best documents of each item of a block."""
    spark = texts.sparkSession
    terms = sorted({t for row in block for t in row.terms})
    place = {t: k for k, t in enumerate(terms)}
    owners: list[list[int]] = [[] for _ in terms]
    for k, row in enumerate(block):
        for t in row.terms:
            owners[place[t]].append(k)
    numbers = np.array([row.no for row in block], np.int64)
    shared = spark.sparkContext.broadcast((terms, owners))
    documents, length, df = statistics(texts, shared, len(terms))
    weights = term_weights(documents, df)
    rows_at_once = max(1, CELLS // max(1, len(block)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _block_of(shared)
        best = Best(len(numbers), most)
        counts, m, ids = [], [], []

        def add() -> None:
            table = own.scores(counts, m, weights, len(numbers))
            no_id = np.fromiter((i is None for i in ids), bool, len(ids))
            best.add(table, no_id, np.array([i or 0 for i in ids], np.int64))
            for held in (counts, m, ids):
                held.clear()

        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                text = reduced(value.as_py())
                found = Counter(own.found(text))
                if found:
                    counts.append(found)
                    m.append(50 + 50 * len(text.split()) * documents // length)
                    ids.append(doc_id.as_py())
                    if len(ids) == rows_at_once:
                        add()
        if ids:
            add()
        item, points, no_id, doc_ids = best.cut()
        columns = [pa.array(numbers[item]), pa.array(points), pa.array(doc_ids, mask=no_id)]
        yield pa.RecordBatch.from_arrays(columns, names=["no", "score", "doc_id"])

    return texts.mapInArrow(score, "no long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` highest scores above 0 of each item.

    Terms, weights and scores are whole numbers as the contract of op12 states them. Equal scores go by
    rising doc_id, a null one last. Rows of ``docs`` count one by one, also where doc_ids or whole rows
    repeat; rows of ``items`` with one item_id, null included, are one item with the terms of all. A null
    text has no terms; a document or an item without terms never comes back, and an empty table on
    either side gives no rows. ``doc_id`` is read as a long; other columns are not read.
    """
    wanted = item_terms(items)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    found = None
    for block in sorted(r.block for r in wanted.select("block").distinct().collect()):
        rows = wanted.filter(F.col("block") == block).select("no", "terms").collect()
        part = written(best_documents(texts, rows, most), "best")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "no long, score long, doc_id long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = W.partitionBy("no", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("no").orderBy(*order)))
    return (
        ranked.filter(F.col("rank") <= most)
        .join(wanted.select("no", "item_id"), "no")
        .select("item_id", "rank", "doc_id", "score")
    )
