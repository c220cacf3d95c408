"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import materialize


#: Nodes with at least this share of all edges, 2/share of them at most, are joined by a broadcast.
HOT_SHARE = 1 / 2000


def _stars(edges: DataFrame, large: bool, floor: int) -> DataFrame:
    """One star round over distinct edges (a < b as bigint); nodes of `floor` edges or more are hubs and split by broadcast."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    first = both.join(F.broadcast(least.where(F.col("n") >= floor).select("a", "m")), "a", "left")
    rest = first.where("m is null").drop("m").join(least.where(F.col("n") < floor).select("a", "m"), "a")
    met = first.where("m is not null").unionByName(rest)
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        out = met.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.  edges: (a, b) bigint.

    Every round is written to the shared folder, so lineage stays short.  The loop ends when no
    edge changes; edges that link a node to itself give nothing, and no edges give no rows.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    sign_of = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    sign = sign_of(e)
    while sign[0]:
        floor = max(1000, int(sign[0] * HOT_SHARE))
        large = materialize(_stars(e, True, floor), "stars")
        e = materialize(_stars(large, False, floor), "stars")
        now = sign_of(e)
        if now == sign:
            break
        sign = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
