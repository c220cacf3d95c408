"""Connected components: random graphs, chains, loops, and a hub."""

import random

from pyspark.sql import functions as F

from partyloom.operators import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in list(root)}


def test_random_graphs_chains_and_loops(spark):
    rng = random.Random(2)
    name = lambda k: f"n{k:03}"
    edges = [(name(rng.randrange(300)), name(rng.randrange(300))) for _ in range(180)]
    edges += [(name(400 + k), name(401 + k)) for k in range(60)] + [("loop", "loop"), ("n000", "n000"), (None, "x"), ("x", None)] + edges[:9]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == plain(edges)
    assert components.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_edges_of_a_hub_stay_dealt_out(spark):
    """One node of 100,000 edges: no task gets above twice the median of the rows, neither after the join nor at the end."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        edges = spark.range(0, 100_000, 1, 8).select(F.lit(0).cast("long").alias("a"), (F.col("id") + 1).alias("b"))
        edges = edges.unionByName(spark.range(200_000, 240_000, 2, 8).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect() if r["count"])
        met = components.least_neighbours(edges, 1000)
        tasks = sizes(met)
        assert sum(tasks) == 120_000 and tasks[-1] <= 2 * 100_000 / 8
        for large in (True, False):
            tasks = sizes(components.star(edges, large, 1000))
            assert tasks[-1] <= 2 * tasks[len(tasks) // 2]
        got = components.connected_components(edges, "a", "b")
        assert got.where("root = 0").count() == 100_001 and got.where("root >= 200000").count() == 40_000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
