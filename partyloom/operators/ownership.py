"""Ownership between parties: blocked owners above, subsidiaries, control links and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyloom.functions.text import reading_order
from partyloom.operators.components import connected_components
from partyloom.operators.graph import edges
from partyloom.operators.shared import pinned

CONTROL = r"(?i)control|acting for|on behalf of|leader|official of|director|manag"
MOST_DEPTH = 6
# Notes on a profile, by whether a blocked owner was found.
REACHES = "A chain of owners reaches a blocked person. Lists state no percentages: confirm the stakes, added up over all blocked owners, before treating this party as blocked."
NO_CHAIN = "No chain to a blocked person in the published relationships; this is not a clearance, because owners that nobody lists don't appear."


def is_blocking(lists: Column, listed: Column, measures: Column) -> Column:
    """Full blocking by the party's own listing."""
    every = F.when(F.size(lists) > 0, lists).otherwise(F.array(listed))
    return F.array_contains(every, "SDN List") | F.exists(measures, lambda t: F.lower(t) == "block")


def canonical(parties: DataFrame, members: DataFrame | None) -> DataFrame:
    """(id, node): each listing and the node that stands for its party."""
    if members is None:
        return parties.select("id", F.col("id").alias("node"))
    return parties.select("id").join(members.select("id", "cluster_id"), "id", "left").select("id", F.coalesce("cluster_id", "id").alias("node"))


def owner_links(parties: DataFrame, nodes: DataFrame) -> DataFrame:
    """(owner, owned, type) between party nodes, without links to oneself or to parties without an id."""
    e = edges(parties).where("role is not null").where(~F.col("dst").startswith("name:"))
    way = e.select(F.when(F.col("role") == "owns", F.col("src")).otherwise(F.col("dst")).alias("o"), F.when(F.col("role") == "owns", F.col("dst")).otherwise(F.col("src")).alias("s"), "type")
    up = nodes.select(F.col("id").alias("o"), F.col("node").alias("on"))
    down = nodes.select(F.col("id").alias("s"), F.col("node").alias("sn"))
    met = way.join(up, "o", "left").join(down, "s", "left")
    return met.select(F.coalesce("on", "o").alias("owner"), F.coalesce("sn", "s").alias("owned"), "type").where("owner <> owned").groupBy("owner", "owned").agg(F.min("type").alias("type"))


def control_links(parties: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, other, type): links of control that aren't ownership."""
    e = edges(parties).where(F.col("role").isNull() & F.col("type").rlike(CONTROL)).where(~F.col("dst").startswith("name:"))
    n = lambda a, b: nodes.select(F.col("id").alias(a), F.col("node").alias(b))
    met = e.join(n("src", "sn"), "src", "left").join(n("dst", "dn"), "dst", "left")
    return met.select(F.coalesce("sn", "src").alias("id"), F.coalesce("dn", "dst").alias("other"), "type").where("id <> other").distinct()


def blocking_nodes(parties: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): parties of which any listing blocks."""
    return parties.where(is_blocking(F.col("lists"), F.col("list"), F.col("sanctionsTypes"))).join(nodes, "id").select("node").distinct()


def chains(owners: DataFrame, blocked: DataFrame, depth: int = MOST_DEPTH, start: DataFrame | None = None) -> DataFrame:
    """(id, owner, hops, path): blocked owners above each party, by the shortest and then smallest path.

    start: (node) to walk from; all parties without it.
    """
    step = owners.select(F.col("owned").alias("at"), F.col("owner").alias("up"))
    reach = owners.select(F.col("owned").alias("id"), F.col("owner"), F.lit(1).alias("hops"), F.array("owned", "owner").alias("path"))
    if start is not None:
        reach = reach.join(start.select(F.col("node").alias("id")), "id", "left_semi")
    reach = pinned(reach, "chain")
    for hop in range(2, depth + 1):
        last = reach.where(F.col("hops") == hop - 1)
        grown = last.join(step, last["owner"] == step["at"]).where(F.col("up") != F.col("id"))
        grown = grown.groupBy("id", F.col("up").alias("owner")).agg(F.min(F.concat("path", F.array("up"))).alias("path"))
        new = grown.join(reach.select("id", "owner"), ["id", "owner"], "left_anti").select("id", "owner", F.lit(hop).alias("hops"), "path")
        wider = pinned(reach.unionByName(new), "chain")
        if wider.where(F.col("hops") == hop).isEmpty():
            break
        reach = wider
    return reach.join(blocked.select(F.col("node").alias("owner")), "owner", "left_semi")


def node_profiles(parties: DataFrame, nodes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, ...): one row for each party node with any ownership or control link."""
    owners = pinned(owner_links(parties, nodes), "owners")
    blocked = pinned(blocking_nodes(parties, nodes), "blocked")
    stated = edges(parties).where("dst_name <> ''").groupBy("dst").agg(F.min("dst_name").alias("said"))
    listed = parties.select("id", "name", F.lit(True).alias("listed"))
    names = listed.join(stated, listed["id"] == stated["dst"], "full").select(F.coalesce("id", "dst").alias("other"), F.coalesce("name", "said").alias("name"), F.coalesce("listed", F.lit(False)).alias("in_snapshot"))
    names = pinned(names, "names")

    def told(rows: DataFrame) -> DataFrame:
        """rows (node, other, ...) with the other's name, whether it is in the snapshot and whether it is blocked."""
        flag = blocked.select(F.col("node").alias("other"), F.lit(True).alias("b"))
        met = rows.join(names, "other", "left").join(flag, "other", "left")
        return met.withColumns({"name": F.coalesce("name", F.concat(F.lit("Entity "), "other")), "in_snapshot": F.coalesce("in_snapshot", F.lit(False)), "blocked": F.coalesce("b", F.lit(False))})

    of = lambda a, b: owners.select(F.col(a).alias("node"), F.col(b).alias("other"))
    own = lambda df: df if start is None else df.join(start, "node", "left_semi")
    found = chains(owners, blocked, start=start).select(F.col("id").alias("node"), F.col("owner").alias("other"), "hops", "path")
    above = told(found).groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("hops", F.col("other").alias("owner"), "path", "name"))).alias("blocked_owners"),
        F.count_if(F.col("hops") == 1).alias("direct"),
        F.count_if(F.col("hops") > 1).alias("indirect"),
    )
    below = told(own(of("owner", "owned"))).groupBy("node").agg(F.array_sort(F.collect_set(F.struct(F.col("other").alias("id"), "name", "in_snapshot", F.col("blocked").alias("listed")))).alias("subsidiaries"))
    links = control_links(parties, nodes).select(F.col("id").alias("node"), "other").distinct()
    control = told(own(links)).groupBy("node").agg(F.array_sort(F.collect_set(F.struct(F.col("other").alias("id"), "name", "blocked"))).alias("controls"))
    marked = own(blocked).withColumn("self_blocked", F.lit(True))
    return above.join(below, "node", "full").join(control, "node", "full").join(marked, "node", "full")


def profile(parties: DataFrame, members: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """One row for every listing, answered for the party it belongs to.

    only: the id of one listing; the walk then starts from its party alone.
    """
    nodes = pinned(canonical(parties, members), "nodes")
    asked = nodes if only is None else nodes.where(F.col("id") == only)
    found = node_profiles(parties, nodes, None if only is None else pinned(asked.select("node").distinct(), "start"))
    out = asked.join(found, "node", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    chained = F.coalesce("blocked_owners", none("struct<hops:int,owner:string,path:array<string>,name:string>"))
    return out.select(
        "id",
        "node",
        F.coalesce("self_blocked", F.lit(False)).alias("self_blocked"),
        chained.alias("blocked_owners"),
        F.coalesce("direct", F.lit(0)).alias("direct"),
        F.coalesce("indirect", F.lit(0)).alias("indirect"),
        (F.size(chained) > 1).alias("aggregation_candidate"),
        F.coalesce("subsidiaries", none("struct<id:string,name:string,in_snapshot:boolean,listed:boolean>")).alias("subsidiaries"),
        F.coalesce("controls", none("struct<id:string,name:string,blocked:boolean>")).alias("controls"),
        F.lit(False).alias("percentages_available"),
        F.when(F.size(chained) > 0, REACHES).otherwise(NO_CHAIN).alias("note"),
    )


def groups(parties: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(id, group_id, size, label): ownership groups of two parties or more, for every listing in them.

    The label is the member that owns most others, the first name among equals.
    """
    nodes = pinned(canonical(parties, members), "nodes")
    owners = pinned(owner_links(parties, nodes), "owners")
    roots = connected_components(owners, "owner", "owned")
    owned = owners.groupBy(F.col("owner").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    named = parties.select(F.col("id").alias("node"), "name")
    each = roots.join(owned, "node", "left").join(named, "node", "left").select("root", "node", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("name", "node").alias("name"))
    label = F.min_by("name", F.struct((-F.col("k")).alias("k"), reading_order("name").alias("n"), "name"))
    size = each.groupBy("root").agg(F.count(F.lit(1)).alias("size"), label.alias("label")).where("size >= 2")
    inside = roots.join(size, "root").select(F.col("node"), F.col("root").alias("group_id"), "size", "label")
    return nodes.join(inside, "node").select("id", "group_id", "size", "label")


def overview(parties: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row: parties with a blocked owner above, only over several hops, and with several owners."""
    p = node_profiles(parties, pinned(canonical(parties, members), "nodes"))
    owners = F.col("direct") + F.col("indirect")
    return p.agg(F.count_if(owners > 0).alias("with_blocked_owner"), F.count_if((F.col("direct") == 0) & (F.col("indirect") > 0)).alias("multi_hop_only"), F.count_if(owners > 1).alias("several_owners"))
