"""Relationship graph: edges, roles, ego networks, degrees and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partyloom.operators.shared import pinned

# Patterns of relationship types.
OWNS = r"(?i)^owns|owns,|owner of|parent of|controls, or operates"
OWNED_BY = r"(?i)owned|property in the interest of|subsidiary of|controlled by"
PEER = r"(?i)family|associate|related to|spouse|sibling|relative"
OWNERSHIP = r"(?i)own|control|subsid|parent|beneficial"
MOST_NODES, MOST_DEPTH = 300, 3
#: Edges that one task collapses.
LINK_ROWS = 500_000


def ownership_role(kind: Column) -> Column:
    return F.when(kind.rlike(OWNS), "owns").when(kind.rlike(OWNED_BY), "owned_by")


def relation_direction(kind: Column) -> Column:
    role = ownership_role(kind)
    return F.when(role == "owns", "down").when(role == "owned_by", "up").when(kind.rlike(PEER), "peer").otherwise("up")


def edges(parties: DataFrame) -> DataFrame:
    """(src, dst, type, ownership, role): one row a stated relationship; a target without an id gets a made-up one."""
    r = parties.select(F.col("id").alias("src"), F.explode("relationships").alias("r"))
    made = F.concat(F.lit("name:"), F.regexp_replace(F.lower(F.col("r.relatedName")), r"[^a-z0-9]+", "_"))
    dst = F.when(F.coalesce(F.col("r.relatedId"), F.lit("")) != "", F.col("r.relatedId")).otherwise(F.regexp_replace(made, r"_$", ""))
    kind = F.coalesce(F.col("r.type"), F.lit(""))
    return r.select("src", dst.alias("dst"), kind.alias("type"), kind.rlike(OWNERSHIP).alias("ownership"), ownership_role(kind).alias("role"), F.coalesce(F.col("r.relatedName"), F.lit("")).alias("dst_name"))


def nodes(parties: DataFrame, links: DataFrame) -> DataFrame:
    """(id, name, type, external): listed parties and the unlisted targets of edges."""
    listed = parties.select("id", "name", "type", F.lit(False).alias("external"))
    known = links.groupBy(F.col("dst").alias("id")).agg(F.max("dst_name").alias("name")).join(listed.select("id"), "id", "left_anti")
    return listed.unionByName(known.select("id", F.when(F.col("name") != "", F.col("name")).otherwise(F.col("id")).alias("name"), F.lit("External").alias("type"), F.lit(True).alias("external")))


def both_ways(links: DataFrame) -> DataFrame:
    """Each edge from either end, with its direction."""
    return links.withColumn("dir", F.lit("out")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in links.columns if c not in ("src", "dst")], F.lit("in").alias("dir")))


def ego_nodes(links: DataFrame, root: str, depth: int = 2, most: int | None = MOST_NODES) -> DataFrame:
    """(id, hop) around root, nearest first, at most `most` (G2, L6); all of them, unsorted, if that is None."""
    near = both_ways(links).select("src", "dst").distinct()
    seen = near.sparkSession.createDataFrame([(root, 0)], "id string, hop int")
    for hop in range(1, max(1, min(MOST_DEPTH, depth)) + 1):
        new = near.join(seen.where(F.col("hop") == hop - 1), near["src"] == F.col("id")).select(F.col("dst").alias("id")).distinct()
        every = seen.unionByName(new.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = pinned(every if most is None else every.orderBy("hop", "id").limit(most), "ego")
    return seen


def induced_edges(links: DataFrame, within: DataFrame) -> DataFrame:
    """Edges with both ends among nodes, once for each (src, dst, type)."""
    ends = lambda c: within.select(F.col("id").alias(c))
    return links.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").dropDuplicates(["src", "dst", "type"])


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree, weighted): ownership edges weigh two; a self-loop counts at both ends."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("id"), F.when(F.col("ownership"), 2).otherwise(1).alias("w"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted"))


def ego_metrics(within: DataFrame, links: DataFrame) -> DataFrame:
    """One row: node, edge and ownership counts and the five heaviest nodes."""
    top = degrees(links).orderBy(F.desc("weighted"), "id").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("weighted")).alias("w"), "id"))).alias("t")).select(F.transform("t", lambda x: x["id"]).alias("top"))
    counts = links.agg(F.count(F.lit(1)).alias("edges"), F.count_if("ownership").alias("ownership_edges"))
    return within.agg(F.count(F.lit(1)).alias("nodes")).join(counts, how="cross").join(top, how="cross")  # one row each


def collapse_parallel(links: DataFrame) -> DataFrame:
    """One undirected edge for each pair, with its types, whether any is ownership, and whether it runs both ways.

    Edges are dealt by their ends, LINK_ROWS to a task, and collapse there alone: maps hold few equal
    pairs, so tables of sums in front of the shuffle would only fill memory.
    """
    forward = F.col("src") <= F.col("dst")
    rows = links.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst"), "forward": forward})
    rows = rows.repartition(max(1, -(-links.count() // LINK_ROWS)), "a", "b")
    return rows.groupBy("a", "b").agg(
        F.bool_or("ownership").alias("ownership"), F.array_sort(F.collect_set("type")).alias("types"), F.coalesce(F.bool_or("forward") & ~F.bool_and("forward"), F.lit(False)).alias("mutual")
    )


def assign_levels(links: DataFrame, root: str, most: int = 32) -> DataFrame:
    """(id, level): superiors above (negative), subordinates below, peers beside, by breadth-first steps."""
    step = F.when(relation_direction(F.col("type")) == "up", -1).when(relation_direction(F.col("type")) == "down", 1).otherwise(0)
    one = links.select("src", "dst", step.alias("d"))
    moves = pinned(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("d")).alias("d"))).distinct(), "moves")
    seen = links.sparkSession.createDataFrame([(root, 0, 0)], "id string, level int, hop int")
    for hop in range(1, most + 1):
        new = moves.join(seen.where(F.col("hop") == hop - 1), moves["src"] == F.col("id")).groupBy("dst").agg(F.min(F.col("level") + F.col("d")).alias("level"))
        new = new.select(F.col("dst").alias("id"), F.col("level").cast("int"), F.lit(hop).alias("hop")).join(seen, "id", "left_anti")
        grown = pinned(seen.unionByName(new), "levels")
        if grown.where(F.col("hop") == hop).isEmpty():
            break
        seen = grown
    return seen.select("id", "level")


def layout(levels: DataFrame, gap: float = 120.0) -> DataFrame:
    """(id, x, y): rows by level, spread evenly."""
    by = Window.partitionBy("level")
    n, k = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy("id"))
    return levels.select("id", ((k - (n + 1) / 2) * gap).alias("x"), (F.col("level") * gap).alias("y"))


def severity(blocking: Column, external: Column, degree: Column) -> tuple[Column, Column]:
    """(severity, radius) of a drawn node."""
    return F.when(external, "external").when(blocking, "blocked").otherwise("listed"), F.least(F.lit(26.0), 10.0 + 2.0 * F.sqrt(degree.cast("double")))
