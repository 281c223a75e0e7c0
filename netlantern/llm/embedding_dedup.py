"""Near-duplicate vectors: all pairs within an angle, by an exact metric range join.

Pivots, drawn from the vectors, cut them into cells: a vector's home is the pivot nearest to it. Two
vectors within the angle ``r`` of one another can only be in cells that both bounds allow:
``angle(u, pivot) <= radius(cell) + r`` by the triangle inequality, and the distance of ``u`` from the
plane halfway between its own pivot and the other's is at most the chord of ``r``. A vector is sent
to the pairs of blocks it may have partners in, where blocks are cells cut to a bounded size. Each
pair of blocks is joined by itself: link counts, and the components among its own links, come out;
links never do. Vectors that are equal are joined once.

Where vectors lie far apart in many directions, as random ones do, neither bound excludes much and
each block meets each other one, which is the price of an exact answer there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlantern.llm.common import written
from netlantern.llm.components import components

COSINE = 0.9
#: Vectors that a block is meant to hold, and the most pivots there can be; beyond that many blocks,
#: cells are cut into several.
BLOCK = 4096
PIVOTS = 1024
STRIP = 512
#: Bounds are widened by this much, so that rounding excludes no pair.
SLACK = 1e-9


def usable() -> F.Column:
    """Whether a vector can link at all: not null, not zero, all components finite."""
    v = F.col("embedding")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(vectors) -> np.ndarray:
    """The vectors, all of one length, as rows of length 1 in double precision."""
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Cells:
    """Pivots by vector length; a cell's number is its pivot's place in the whole list.

    Vectors of a length without a pivot share a cell of their own, numbered below zero.
    """

    def __init__(self, pivots: list) -> None:
        self.first, self.pivots = {}, {}
        by_length: dict[int, list] = {}
        for p in pivots:
            by_length.setdefault(len(p), []).append(p)
        at = 0
        for length, own in sorted(by_length.items()):
            x = np.unique(units(own), axis=0)
            self.first[length], self.pivots[length] = at, x
            at += len(x)

    def home(self, length: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, angle to its pivot) of each row."""
        if length not in self.pivots:
            return np.full(len(x), -1 - length), np.zeros(len(x))
        c = np.clip(x @ self.pivots[length].T, -1, 1)
        best = c.argmax(axis=1)
        return self.first[length] + best, np.arccos(c[np.arange(len(x)), best])

    def reached(self, length: int, x: np.ndarray, radius: dict[int, float], r: float):
        """(cells, rows x cells: whether a partner may live there)."""
        if length not in self.pivots:
            return [-1 - length], np.ones((len(x), 1), bool)
        p, first = self.pivots[length], self.first[length]
        c = np.clip(x @ p.T, -1, 1)
        own = c.argmax(axis=1)
        far = np.array([radius.get(first + k, -np.inf) for k in range(len(p))])
        near = np.arccos(c) <= far + r + SLACK
        apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[own]
        chord = 2 * np.sin(r / 2)
        plane = c[np.arange(len(x)), own][:, None] - c <= apart * chord + SLACK
        reach = near & plane
        reach[np.arange(len(x)), own] = True
        return list(range(first, first + len(p))), reach


def by_length(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = vectors.map(len).to_numpy(np.int64)
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def join_blocks(a: pd.DataFrame, b: pd.DataFrame | None, cosine: float) -> pd.DataFrame:
    """Links between two blocks, or within one: per vector their number and its component.

    Only vectors with a link come out; ``root`` is the smallest ``rep`` of those that links between
    these two blocks connect.
    """
    x, own = units(a["embedding"]), a["copies"].to_numpy(np.float64)
    y, other = (x, own) if b is None else (units(b["embedding"]), b["copies"].to_numpy(np.float64))
    near = np.empty((len(x), len(y)), bool)
    links_x, links_y = np.zeros(len(x)), np.zeros(len(y))
    for at in range(0, len(x), STRIP):
        part = near[at : at + STRIP]
        np.greater_equal(x[at : at + STRIP] @ y.T, cosine, out=part)
        if b is None:
            rows = np.arange(len(part))
            part[rows, at + rows] = False
        if part.any():
            links_x[at : at + STRIP] = part @ other
            links_y += own[at : at + STRIP] @ part
    rep_x = a["rep"].to_numpy(np.int64)
    rep_y = rep_x if b is None else b["rep"].to_numpy(np.int64)
    rows, cols = np.flatnonzero(links_x), np.flatnonzero(links_y)
    linked = near[np.ix_(rows, cols)]
    low_x, low_y = rep_x[rows].copy(), rep_y[cols].copy()
    none = np.iinfo(np.int64).max
    while len(rows):
        if b is None:
            low_x = low_y = np.minimum(low_x, low_y)
        before = low_x.sum() + low_y.sum()
        for at in range(0, len(rows), STRIP):
            part = linked[at : at + STRIP]
            own_low = low_x[at : at + STRIP]
            np.minimum(own_low, np.where(part, low_y, none).min(axis=1), out=own_low)
            low_y = np.minimum(low_y, np.where(part, own_low[:, None], none).min(axis=0))
        if low_x.sum() + low_y.sum() == before:
            break
    parts = [pd.DataFrame({"rep": rep_x[rows], "links": links_x[rows], "root": low_x})]
    if b is not None:
        parts.append(pd.DataFrame({"rep": rep_y[cols], "links": links_y[cols], "root": low_y}))
    return pd.concat(parts).astype({"rep": "int64", "links": "int64", "root": "int64"})


def range_join(reps: DataFrame, cosine: float = COSINE, block: int = BLOCK, pivots: int = PIVOTS):
    """``rep, links, root`` rows: how many vectors ``rep`` links with in a pair of blocks, and one
    that it is connected with. ``reps(rep, copies, embedding)`` is a written table of usable vectors,
    no two of them equal."""
    r, kind = float(np.arccos(cosine)), reps.schema["embedding"].dataType.simpleString()
    wanted = min(pivots, max(1, -(-reps.count() // block)))
    drawn = reps.select("embedding").orderBy(F.xxhash64("embedding"), "rep").limit(wanted).collect()
    cells = Cells([row.embedding for row in drawn])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            home, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for length, rows in by_length(batch["embedding"]):
                x = units(batch["embedding"].iloc[rows])
                home[rows], far[rows] = cells.home(length, x)
            yield batch.assign(cell=home, far=far)

    schema = f"rep long, copies long, embedding {kind}, cell long, far double"
    homes = written(reps.select("rep", "copies", "embedding").mapInPandas(assign, schema), "homes")
    # One row per cell: at most as many as there are pivots and lengths of vectors.
    known = homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    radius = {row.cell: row.far for row in known}
    first, blocks = {}, 0
    for row in sorted(known, key=lambda row: row.cell):
        first[row.cell] = range(blocks, blocks + -(-row.n // block))
        blocks += len(first[row.cell])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mine = np.array(
                [first[c][h % len(first[c])] for c, h in zip(batch["cell"], batch["spread"])], np.int64
            )
            for length, rows in by_length(batch["embedding"]):
                x = units(batch["embedding"].iloc[rows])
                names, reach = cells.reached(length, x, radius, r)
                for k, name in enumerate(names):
                    for other in first.get(name, ()):
                        went = rows[reach[:, k]]
                        if len(went):
                            own = mine[went]
                            out = batch.iloc[went][["rep", "copies", "embedding"]]
                            yield out.assign(
                                low=np.minimum(own, other), high=np.maximum(own, other), home=own
                            )

    spread = homes.withColumn("spread", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)))
    schema = f"rep long, copies long, embedding {kind}, low long, high long, home long"
    sent = spread.mapInPandas(send, schema)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        a = rows[rows["home"] == low]
        b = None if low == high else rows[rows["home"] == high]
        if not len(a) or (b is not None and not len(b)):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        return join_blocks(a, b, cosine)

    return sent.groupBy("low", "high").applyInPandas(join, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Two vectors link when their cosine, in double precision, is at least ``cosine`` and their lengths
    are the same. Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing and are their own component. Equal vectors link with one another and count one by one,
    also where rows repeat in full. ``component_id`` is the smallest vec_id reachable by links, a null
    one only if there is no other. An empty table gives no rows; other columns are not read.
    """
    given = vectors.schema["embedding"].dataType.simpleString()
    kind = given if given in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    able = rows.filter(usable())
    same = able.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    reps = written(same.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    found = written(range_join(reps, cosine), "near")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    near = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    whole = (
        reps.join(counted, "rep", "left")
        .join(near.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "embedding",
            "copies",
            "first",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("root"),
        )
    )
    whole = written(whole, "near")
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    named = whole.join(least, "root")
    one = named.filter("copies = 1").select(F.col("first").alias("vec_id"), "n_links", "component_id")
    many = named.filter("copies > 1").select("embedding", "n_links", "component_id")
    many = able.join(many, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = one.unionByName(many).unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
