"""Hard negatives: for each anchor and positive, the best rows of other labels in a window of scores.

Method: a GNAT-style tree of split points. A node deals its rows to the nearest of its split points
(hyperplanes), and each split point keeps the range of its distances to the rows of every sibling's
subtree. Scores are inner products; with one more coordinate that gives all rows the same length, a
window of scores about an anchor is an annulus of distances. A sibling subtree is left out where the
range kept for it and the distances that the annulus allows don't meet. What is left is compared in
whole numbers, so results are exact whatever the tree looks like.

The tree is fitted on a bounded sample and has a bounded number of leaves; every row is dealt to a leaf.
A leaf's rows are cut into blocks and its visiting anchors into chunks, so that one vector in a third of
the rows, or an anchor that can leave nothing out, meets no bound of a task. Each search visits the
anchors' own leaves first: what they hold narrows the annuli for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netlantern.llm.common import written

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Whole-number components beyond this count as this, so that scores stay within a long.
MOST = 1 << 26
#: Split points are chosen from a sample of at most so many rows and components.
SAMPLE_ROWS, SAMPLE_CELLS = 8192, 1 << 22
FAN = 8
MAX_LEAVES = 1024
#: A leaf aims at so many rows; what holds more is cut into blocks, and its anchors into chunks.
LEAF_ROWS, CHUNK = 2048, 512
FAR = float("inf")
#: Beyond every score.
ANY = 1 << 62


# --- the tree --------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Split points of each node with the ranges of distances to the rows of each child's subtree.

    ``children[v][j]`` is a node, or ``~leaf``. ``low[v][i, j]`` and ``high[v][i, j]`` bound the distances
    from split point i of node v to the rows below child j.
    """

    radius2: float
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    leaves: int = 1

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that puts them all on one sphere."""
        rest = self.radius2 - np.einsum("ij,ij->i", rows, rows)
        return np.column_stack([rows, np.sqrt(np.maximum(rest, 0))])

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (1 + math.sqrt(self.radius2))


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", points, points)
    return np.sqrt(np.maximum(square - 2 * rows @ points.T, 0))


def spread_points(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it; equal rows are chosen once."""
    chosen = [0]
    near = distances(rows, rows[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def fit_tree(sample: np.ndarray, radius2: float, share: float) -> Tree:
    """A tree over lifted sample rows, each of which stands for ``share`` rows."""
    tree = Tree(radius2)
    tree.leaves = 0
    waiting: list[tuple[np.ndarray, int, int]] = [(tree.lifted(sample), -1, 0)]
    while waiting:
        waiting.sort(key=lambda w: -len(w[0]))  # the largest first, while leaves remain
        rows, parent, place = waiting.pop(0)
        points = rows[:0]
        if len(rows) * share > LEAF_ROWS and tree.leaves + len(waiting) + FAN <= MAX_LEAVES:
            points = spread_points(rows, FAN)
        if len(points) > 1:
            number = len(tree.points)
            tree.points.append(points)
            tree.children.append([0] * len(points))
            home = distances(rows, points).argmin(1)
            waiting += [(rows[home == j], number, j) for j in range(len(points))]
        else:
            number = ~tree.leaves
            tree.leaves += 1
        if parent >= 0:
            tree.children[parent][place] = number
    tree.low = [np.full((len(p), len(p)), FAR) for p in tree.points]
    tree.high = [np.full((len(p), len(p)), -FAR) for p in tree.points]
    return tree


def descend(tree: Tree, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """(leaf of each lifted row, (node, its rows' distances, their children) of each node with rows)."""
    leaf = np.zeros(len(rows), np.int64)
    seen = []
    waiting = [(0, np.arange(len(rows)))] if tree.points and len(rows) else []
    while waiting:
        node, at = waiting.pop()
        far = distances(rows[at], tree.points[node])
        home = far.argmin(1)
        seen.append((node, far, home))
        for j, child in enumerate(tree.children[node]):
            own = at[home == j]
            if not len(own):
                continue
            if child < 0:
                leaf[own] = ~child
            else:
                waiting.append((child, own))
    return leaf, seen


def visited(tree: Tree, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
    """For each leaf the anchors whose annuli (``near``, ``far``: a row of radii each) may reach it.

    The rows of a subtree are between ``|d - r|`` and ``d + r`` from a split point that is ``d`` from the
    anchor, for some r of an annulus; ranges that meet no such interval leave the subtree out.
    """
    here = [np.empty(0, np.int64)] * tree.leaves
    if not tree.points:
        return [np.arange(len(anchors))]
    lifted = np.column_stack([anchors, np.zeros(len(anchors))])
    near, far = near - tree.slack, far + tree.slack
    waiting = [(0, np.arange(len(anchors)))]
    while waiting:
        node, at = waiting.pop()
        d = distances(lifted[at], tree.points[node])
        for j, child in enumerate(tree.children[node]):
            meets = np.zeros(len(at), bool)
            for k in range(near.shape[1]):
                r1, r2 = near[at, k][:, None], far[at, k][:, None]
                from_ = np.maximum(r1 - d, d - r2)
                reach = (tree.low[node][:, j] <= d + r2) & (tree.high[node][:, j] >= from_)
                meets |= reach.all(1) & (r1 <= r2)[:, 0]
            own = at[meets]
            if not len(own):
                continue
            if child < 0:
                here[~child] = own
            else:
                waiting.append((child, own))
    return here


def radii(tree: Tree, anchors: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The annuli that hold all rows with scores from ``low`` to ``high`` about each anchor."""
    whole = (tree.radius2 + np.einsum("ij,ij->i", anchors, anchors))[:, None]
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum(whole - 2 * high, 0)), np.sqrt(np.maximum(whole - 2 * low, 0))


# --- whole-number scores ----------------------------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; in doubles where none can be rounded."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def matrix(vectors: pd.Series, size: int) -> np.ndarray:
    """Whole-number rows; shorter vectors count as if filled up with zeros."""
    out = np.zeros((len(vectors), size), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def ids_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(is null, id): ids in their order, null ones last."""
    return rows["vec_id"].isna().to_numpy(), rows["vec_id"].fillna(0).to_numpy().astype(np.int64)


def best_of(scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` highest scores, ties by id."""
    if len(scores) > 4 * most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= least)
        return some[best_of_few(scores[some], no_id[some], ids[some])[:most]]
    return best_of_few(scores, no_id, ids)[:most]


def best_of_few(scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, no_id, -scores))


# --- the search -------------------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, v`` of the rows that take part, written: ``v`` is floor(256 * component)."""

    def number(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * 256)
        return F.greatest(F.least(scaled, F.lit(MOST)), F.lit(-MOST)).cast("int")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))

    able = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    rows = vectors.filter(F.coalesce(able, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        F.transform("embedding", number).alias("v"),
    )
    return written(rows, "points")


@dataclass
class Dealt:
    """Rows with their leaves, and how many each leaf holds."""

    rows: DataFrame
    tree: Tree
    size: int
    blocks: DataFrame


def deal(points: DataFrame) -> Dealt:
    """Fits the tree on a sample of the written ``points``, deals all rows and measures the ranges."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = points.agg(
        F.count("*").alias("n"), F.max(square).alias("radius2"), F.max(F.size("v")).alias("size")
    ).first()
    size = max(1, facts["size"] or 0)
    some = points.orderBy(F.xxhash64("row"), "row").limit(min(SAMPLE_ROWS, max(1, SAMPLE_CELLS // size)))
    sample = matrix(some.select("v").toPandas()["v"], size).astype(np.float64)
    share = facts["n"] / max(1, len(sample))
    tree = fit_tree(sample, facts["radius2"] or 0.0, share) if len(sample) else Tree(0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = [x.copy() for x in tree.low], [x.copy() for x in tree.high]
        for batch in batches:
            rows = tree.lifted(matrix(batch["v"], size).astype(np.float64))
            leaf, seen = descend(tree, rows)
            for node, far, home in seen:
                for j in np.unique(home):
                    own = far[home == j]
                    low[node][:, j] = np.minimum(low[node][:, j], own.min(0))
                    high[node][:, j] = np.maximum(high[node][:, j], own.max(0))
            yield pd.DataFrame({"row": batch["row"], "leaf": leaf}).reindex(columns=names)
        ranges = [
            (v, i, j, low[v][i, j], high[v][i, j])
            for v in range(len(low))
            for i, j in zip(*np.nonzero(high[v] >= low[v]))
        ]
        yield pd.DataFrame(ranges, columns=["node", "i", "j", "low", "high"]).reindex(columns=names)

    schema = "row long, leaf long, node long, i long, j long, low double, high double"
    names = [part.split()[0] for part in schema.split(", ")]
    found = written(points.select("row", "v").mapInPandas(run, schema), "leaves")
    ranges = found.filter("node IS NOT NULL").groupBy("node", "i", "j")
    # One row for each pair of split points of a node: bounded as the tree is.
    for r in ranges.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.low[r.node][r.i, r.j], tree.high[r.node][r.i, r.j] = r.low, r.high
    leaf = found.filter("row IS NOT NULL").select("row", "leaf")
    rows = written(points.join(leaf, "row"), "dealt")
    held = rows.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * LEAF_ROWS)).cast("int").alias("blocks"))
    return Dealt(rows, tree, size, F.broadcast(written(held, "blocks")))


def _routed(dealt: Dealt, anchors: DataFrame, home: bool) -> DataFrame:
    """``anchors(arow, home, v, low, high, ...)``, a row for each leaf to visit, written.

    ``low`` and ``high`` are arrays: the windows of scores still of interest. ``home`` asks for each
    anchor's own leaf only, otherwise all others come that may hold such scores.
    """
    if home:
        return anchors.withColumn("leaf", F.col("home"))
    tree, size = dealt.tree, dealt.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = matrix(batch["v"], size).astype(np.float64)
            most = max(1, int(batch["low"].map(len).max()))
            low, high = (np.full((len(batch), most), f) for f in (FAR, -FAR))
            for k, (a, b) in enumerate(zip(batch["low"], batch["high"])):
                low[k, : len(a)], high[k, : len(b)] = a, b
            near, far = radii(tree, own, low, high)
            near[low > high], far[low > high] = FAR, -FAR
            for leaf, at in enumerate(visited(tree, own, near, far)):
                at = at[batch["home"].to_numpy()[at] != leaf]
                if len(at):
                    yield batch.iloc[at].assign(leaf=leaf)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema)
    return written(anchors.mapInPandas(run, f"{kinds}, leaf long"), "routed")


def _met(dealt: Dealt, routed: DataFrame, compare, schema: str) -> DataFrame:
    """``compare(anchors, rows)`` for every block of a leaf and every chunk of the anchors visiting it."""
    chunks = routed.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    each = written(chunks.join(dealt.blocks, "leaf"), "visits")  # a row for each leaf

    def parts(rows: DataFrame, key: str, own: str, many: str, other: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(F.lit(7), key), F.col(many)).cast("int")
        wide = rows.join(F.broadcast(each), "leaf").withColumn(own, spread)
        return wide.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop(
            "blocks", "chunks"
        )

    key = ["leaf", "block", "chunk"]
    one = parts(routed, "arow", "chunk", "chunks", "block").groupBy(*key)
    two = parts(dealt.rows, "row", "block", "blocks", "chunk").groupBy(*key)
    return one.cogroup(two).applyInPandas(compare, schema)


def _same_label(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    return a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]


def _best(found: DataFrame, by: list[str], score: str, name: str, most: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(name))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _positives(dealt: Dealt, anchors: DataFrame, most: int) -> DataFrame:
    """``arow, vec_id, score, place``: the best other rows with the anchor's label, written."""
    size = dealt.size

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            scores = products(matrix(a["v"], size), matrix(b["v"], size))
            able = _same_label(a, b) & (a["arow"].to_numpy()[:, None] != b["row"].to_numpy())
            no_id, ids = ids_of(b)
            for k, (arow, low) in enumerate(zip(a["arow"], a["low"])):
                some = np.flatnonzero(able[k] & (scores[k] >= low[0]))
                some = some[best_of(scores[k, some], no_id[some], ids[some], most)]
                out += [(arow, None if no_id[i] else ids[i], scores[k, i]) for i in some]
        return pd.DataFrame(out, columns=["arow", "vec_id", "score"])

    schema = "arow long, vec_id long, score long"
    everything = anchors.withColumn("low", F.array(F.lit(-ANY))).withColumn("high", F.array(F.lit(ANY)))
    first = written(_met(dealt, _routed(dealt, everything, True), compare, schema), "positives")
    bound = _best(first, ["arow"], "score", "vec_id", most).filter(F.col("place") == most)
    bound = bound.select("arow", F.array("score").alias("least"))
    narrowed = everything.join(bound, "arow", "left")
    narrowed = narrowed.withColumn("low", F.coalesce("least", "low")).drop("least")
    others = _met(dealt, _routed(dealt, narrowed, False), compare, schema)
    return written(_best(first.unionByName(others), ["arow"], "score", "vec_id", most), "positives")


def _negatives(dealt: Dealt, anchors: DataFrame, most: int) -> DataFrame:
    """``arow, place, vec_id, score``: the best rows of other labels in each of the anchor's windows.

    ``anchors`` has arrays ``places``, ``low`` and ``high`` with an entry for each window.
    """
    size = dealt.size

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            scores = products(matrix(a["v"], size), matrix(b["v"], size))
            other = ~_same_label(a, b)
            no_id, ids = ids_of(b)
            for k, (arow, places, low, high) in enumerate(
                zip(a["arow"], a["places"], a["low"], a["high"])
            ):
                able = np.flatnonzero(other[k] & (scores[k] >= min(low)) & (scores[k] <= max(high)))
                for place, least, greatest in zip(places, low, high):
                    own = scores[k, able]
                    some = able[(own >= least) & (own <= greatest)]
                    some = some[best_of(scores[k, some], no_id[some], ids[some], most)]
                    out += [(arow, place, None if no_id[i] else ids[i], scores[k, i]) for i in some]
        return pd.DataFrame(out, columns=["arow", "place", "vec_id", "score"])

    schema = "arow long, place int, vec_id long, score long"
    by = ["arow", "place"]
    first = written(_met(dealt, _routed(dealt, anchors, True), compare, schema), "negatives")
    bound = _best(first.withColumnRenamed("place", "window"), ["arow", "window"], "score", "vec_id", most)
    bound = bound.filter(F.col("place") == most).groupBy("arow").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("least")
    )
    narrowed = anchors.join(bound, "arow", "left")
    raised = F.transform(
        F.arrays_zip("places", "low"), lambda w: F.coalesce(F.col("least")[w["places"]], w["low"])
    )
    narrowed = narrowed.withColumn("low", raised).drop("least")
    others = _met(dealt, _routed(dealt, narrowed, False), compare, schema)
    every = first.unionByName(others).withColumnRenamed("place", "window")
    best = _best(every, ["arow", "window"], "score", "vec_id", most)
    return best.select("arow", "window", "vec_id", "score", F.col("place").alias("rank"))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on vec_id. A component x
    counts as floor(256 * x), within ±2**26; a score is the inner product of those. An anchor's positives
    are its best ``positives`` other rows of the same label; a positive's negatives are the best
    ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive``. Higher
    scores come first, ties by smaller vec_id, a null one last.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of
    different lengths are compared as if the shorter ended in zeros; an empty one scores 0. Rows count one
    by one: a repeat of the anchor's row is another row, and repeated anchors give repeated results. A row
    without a vec_id is no anchor. An empty table gives no rows; other columns are not read.
    """
    dealt = deal(whole_numbers(vectors))
    chosen = dealt.rows.filter(F.coalesce(is_anchor, F.lit(False)))
    anchors = chosen.select(
        F.col("row").alias("arow"), F.col("vec_id").alias("anchor_id"), "label", "v", F.col("leaf").alias("home")
    )
    anchors = written(anchors, "anchors")
    best = _positives(dealt, anchors.drop("anchor_id"), positives)
    window = F.struct(
        F.col("place").alias("places"),
        F.expr(f"-((score * -{low} - pmod(score * -{low}, 100)) DIV 100)").alias("low"),
        F.expr(f"(score * {high} - pmod(score * {high}, 100)) DIV 100").alias("high"),
    )
    windows = best.groupBy("arow").agg(F.collect_list(window).alias("w"))
    asking = anchors.drop("anchor_id").join(windows, "arow").select(
        "arow", "label", "v", "home", "w.places", "w.low", "w.high"
    )
    found = _negatives(dealt, written(asking, "windows"), negatives)
    named = best.select("arow", F.col("place").alias("window"), F.col("vec_id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return (
        found.join(named, ["arow", "window"])
        .join(anchors.select("arow", "anchor_id"), "arow")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
