"""Connected components by alternating large and small stars, on any orderable node.

Each round contracts: every node hands its neighbours the smallest node it knows, first to its
larger neighbours (large star), then to itself and its smaller ones (small star), until the edges
are stars around roots.  A hub's edges would meet in one task; nodes with HOT_SHARE of all edges or
more, of which there are 2 / HOT_SHARE at most, are joined by a broadcast instead, so their edges
stay where they are.  Minima collapse map-side.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.operators.shared import pinned

#: The part of all edges from which a node is a hub, and the fewest edges of one.
HOT_SHARE, HOT_FROM = 1 / 2000, 1000


def least_neighbours(pairs: DataFrame, floor: int) -> DataFrame:
    """pairs (a, b) with m, the smallest of a and its b; nodes of `floor` pairs or more are hubs."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    hubs, others = least.where(F.col("n") >= floor).select("a", "m"), least.where(F.col("n") < floor).select("a", "m")
    first = pairs.join(F.broadcast(hubs), "a", "left")
    rest = first.where("m is null").drop("m").join(others, "a")
    return first.where("m is not null").unionByName(rest)


def star(edges: DataFrame, large: bool, floor: int) -> DataFrame:
    """One round over edges with a < b."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    met = least_neighbours(edges.unionByName(turned) if large else turned, floor)
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        out = met.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return out.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes are those of the edges, also of loops."""
    given = pinned(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), "edges")
    e = pinned(given.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    sign_of = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    sign = sign_of(e)
    while sign[0]:
        floor = max(HOT_FROM, int(sign[0] * HOT_SHARE))
        e = pinned(star(pinned(star(e, True, floor), "stars"), False, floor), "stars")
        now = sign_of(e)
        if now == sign:
            break
        sign = now
    held = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    alone = given.where("a = b").select(F.col("a").alias("node")).distinct().join(e.select(F.explode(F.array("a", "b")).alias("node")), "node", "left_anti")
    roots = e.select(F.col("a").alias("node")).distinct().unionByName(alone)
    return held.unionByName(roots.select("node", F.col("node").alias("root")))
