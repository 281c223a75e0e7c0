"""Connected components by randomised contraction, as joins and aggregates.

Each round every node joins the node of its closed neighbourhood with the smallest random
priority, links are renamed and repeated ones dropped; what is left shrinks by a constant factor in
expectation (Boegeholz, Brand and Todor, "In-database connected component analysis"). A node with
a third of all links is one partial row per task in the aggregate and a split partition in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlantern.llm.common import written

ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the smallest node reachable.

    Both columns are longs. Repeated links and both directions are fine. A link without both ends
    says nothing and is left out; a node linked with itself only is its own component. No links:
    no rows.
    """
    whole = links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    edges = written(whole.distinct(), "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    left = edges.filter("a <> b")
    steps: list[DataFrame] = []
    for turn in range(ROUNDS):
        if left.isEmpty():
            break
        steps.append(_nearest(left, turn))
        to = steps[-1].select("node", "root")
        left = written(
            left.join(to.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
    else:
        raise RuntimeError(f"links did not contract within {ROUNDS} rounds")
    if not steps:
        return nodes.distinct().select("node", F.col("node").alias("component"))
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("_later"))
        roots = step.join(later, "root", "left").select(
            "node", F.coalesce("_later", "root").alias("root")
        )
    roots = written(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    found = roots.join(least, "root").select("node", "component")
    alone = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    alone = alone.join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))


def _nearest(links: DataFrame, turn: int) -> DataFrame:
    def rank(name: str):
        return F.struct(F.xxhash64(F.lit(turn), F.col(name)).alias("p"), F.col(name).alias("n"))

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
    chosen = best.select(F.col("a").alias("node"), F.least("best", rank("a")).n.alias("root"))
    return written(chosen, "roots")
