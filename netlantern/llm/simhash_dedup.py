"""SimHash near-duplicates: links between fingerprints that differ in a few bits.

Method: the generalised pigeonhole principle. The 64 bits are dealt into ``m`` parts, correlated
bits together, and part ``k`` gets its own threshold ``t[k] >= -1`` with ``sum(t[k] + 1) = d + 1``.
Two fingerprints within ``d`` bits agree in some part up to its threshold, else they would differ in
at least ``sum(t[k] + 1) > d`` bits. So every link is found by probing, in each part, the values up
to ``t[k]`` flips away (a part of threshold -1 isn't probed), and each candidate is verified on all
64 bits. ``m`` and the thresholds come from dynamic programming over estimated candidates and
probes; the estimate reads the bit statistics of all distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlantern.llm.common import row_hash, rows_kept, text_or_empty, written
from netlantern.llm.components import components
from netlantern.llm.fingerprint import simhash_udf

BITS = 64
MAX_BITS = 3
PARTS = (2, 3, 4)
#: Cost of making and moving one probe, in verified candidates.
PROBE_COST = 20.0


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int


# --- choosing parts and thresholds ------------------------------------------------------------


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits in how many both are set.

    Every task forwards one 64 x 64 table, whatever it read.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            rows = batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(rows, axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pd.DataFrame({"n": [n], "counts": [both.ravel()]})

    schema = "n long, counts array<long>"
    parts = prints.select("fp").mapInPandas(count, schema)
    cells = parts.select("n", F.posexplode("counts").alias("cell", "c"))
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()
    both = np.zeros(BITS * BITS)
    for row in rows:
        both[row.cell] = row.c
    return (int(rows[0].n) if rows else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Deal the bits into parts of nearly equal width, each grown by its most correlated bit."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        order = sorted(free)
        group = [max(order, key=lambda b: (related[b, order].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(tuple(sorted(group)))
    return out


def allocate(n: int, both: np.ndarray, groups: list[tuple[int, ...]], most: int):
    """(cost, thresholds): the cheapest thresholds with ``sum(t + 1) = most + 1``.

    A pair's bits agree in bit ``b`` with probability ``p^2 + (1 - p)^2``; how many of a part's bits
    differ then follows from convolving those, which gives the expected candidates per threshold.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    pairs = n * (n - 1) / 2
    states = {0: (0.0, ())}
    for bits in groups:
        mass = np.zeros(most + 2)
        mass[0] = 1.0
        for b in bits:
            mass = mass * (1 - differ[b]) + np.concatenate([[0], mass[:-1]]) * differ[b]
        grown: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in states.items():
            for t in range(-1, most - spent + 1):
                probes = sum(comb(len(bits), i) for i in range(t + 1))
                found = pairs * min(1.0, float(mass[: t + 1].sum()))
                total = cost + PROBE_COST * n * probes + found
                at = spent + t + 1
                if at <= most + 1 and (at not in grown or total < grown[at][0]):
                    grown[at] = (total, (*chosen, t))
        states = grown
    return states[most + 1]


def choose_parts(n: int, both: np.ndarray, most: int = MAX_BITS) -> list[Part]:
    options = []
    for m in PARTS:
        groups = group_bits(n, both, m)
        cost, thresholds = allocate(n, both, groups, most)
        options.append((cost, m, [Part(g, t) for g, t in zip(groups, thresholds)]))
    return min(options, key=lambda x: x[:2])[2]


# --- probing and verifying ---------------------------------------------------------------------


def _flips(bits: tuple[int, ...], most: int) -> list[int]:
    masks = [0]
    for i in range(1, most + 1):
        masks += [sum(1 << b for b in chosen) for chosen in combinations(bits, i)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _key(k: int, value: Column):
    return lambda mask: F.struct(F.lit(k).alias("k"), value.bitwiseXOR(mask).alias("v"))


def links(prints: DataFrame, most: int = MAX_BITS, parts: list[Part] | None = None) -> DataFrame:
    """``a, b`` with ``a < b``: every two distinct fingerprints that differ in at most ``most`` bits.

    ``prints(fp)`` must be distinct. A fingerprint has at most ``sum(C(64, i), i <= most)``
    neighbours, so links grow with the fingerprints. Each link comes once: a candidate counts only
    in the first part that can find it.
    """
    parts = choose_parts(*bit_statistics(prints), most) if parts is None else parts
    used = [(k, part) for k, part in enumerate(parts) if part.threshold >= 0]
    masks = {k: sum(1 << b for b in part.bits) for k, part in used}
    signed = {k: F.lit(m - (1 << 64) if m >> 63 else m) for k, m in masks.items()}

    def keys(probe: bool):
        out = []
        for k, part in used:
            flips = _flips(part.bits, part.threshold if probe else 0)
            masks_ = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<long>")
            out.append(F.transform(masks_, _key(k, F.col("fp").bitwiseAND(signed[k]))))
        return F.concat(*out)

    left = prints.select(F.col("fp").alias("a"), F.explode(keys(False)).alias("key"))
    right = prints.select(F.col("fp").alias("b"), F.explode(keys(True)).alias("key"))
    left = left.select("a", "key.k", "key.v")
    right = right.select("b", "key.k", "key.v")
    different = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None).cast("int")
    for k, part in reversed(used):
        near = F.bit_count(different.bitwiseAND(signed[k])) <= part.threshold
        first = F.when(near, F.lit(k)).otherwise(first)
    where = (
        (left.k == right.k)
        & (left.v == right.v)
        & (F.col("a") < F.col("b"))
        & (F.bit_count(different) <= most)
        & (first == left.k)
    )
    return left.join(right, where).select("a", "b")


# --- documents ---------------------------------------------------------------------------------


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row, as a written table."""
    rows = docs.select("doc_id", simhash_udf(text_or_empty()).alias("fp"))
    return written(rows, "fingerprints")


def classes(prints: DataFrame, most: int = MAX_BITS, root: bool = False) -> DataFrame:
    """``fp, component``: for every distinct fingerprint the smallest doc_id of its class.

    With ``root``, ``fp, root`` instead: a number for the class that is never null.

    ``prints(doc_id, fp)`` may hold a fingerprint any number of times: its copies are one partial
    row per task. Rows without a doc_id are in the class but never give it its name, unless it has
    no other.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    near = components(links(distinct.select("fp"), most))
    named = distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")
    )
    named = written(named.select("fp", "first", "root"), "classes")
    if root:
        return named.select("fp", "root")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return named.join(least, "root").select("fp", "component")


def simhash_classes(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Texts without a word, null ones included, have fingerprint zero and link like any other.
    Repeated rows come as often as they are there. An empty table gives no rows. Other columns are
    neither read nor returned.
    """
    prints = fingerprinted(docs)
    named = classes(prints, most)
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").cast(T.LongType()).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one of each class: the one with the smallest doc_id.

    All columns stay as they are, whatever their names. Rows without a doc_id come last; of rows
    that share that doc_id one text is kept, and of rows repeated in full any one.
    """
    prints = written(
        docs.select("doc_id", row_hash().alias("h"), simhash_udf(text_or_empty()).alias("fp")),
        "fingerprints",
    )
    return first_of_classes(docs, prints, classes(prints, most, root=True))


def first_of_classes(docs: DataFrame, prints: DataFrame, named: DataFrame) -> DataFrame:
    """The first rows of ``docs`` by class, from ``prints(doc_id, h, fp)`` and ``named(fp, root)``.

    The first row of each fingerprint comes from partial aggregates, so that one with a third of the
    rows joins its class as one row.
    """
    rows = prints.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "h", "copies"))
    each = rows.groupBy("fp").agg(first.alias("row")).join(named, "fp")
    keepers = each.groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    return rows_kept(docs, written(keepers.drop("no_id"), "keepers"))
