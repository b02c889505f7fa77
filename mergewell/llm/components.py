"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mergewell.runtime import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the number of rounds grows with the logarithm
    of the largest component and no node's neighbours are ever gathered, only their minimum, which is
    aggregated before the shuffle. Every round is written to the shared checkpoint folder, so a lost executor
    costs one round. Self-loops, repeated edges and either direction are welcome; null ends are left out.
    """
    # Written first: the edges may be dear to make and are read twice, for the nodes and for the first round.
    loops = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null"))
    nodes = loops.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = loops.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # large star: larger neighbours of a node move to the smallest node that it knows
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(
            large.join(lows, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lows.select("a", F.col("m").alias("b"))).distinct()
        )
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    labels = now.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(labels, nodes["node"] == labels["a"], "left").select("node", F.coalesce("m", "node").alias("component"))
