"""Merkle manifest of a dataset by fractal traversal, with a proof for every row.

Rows become leaves; the leaves of a tree (one for each value of `by`) ascend by id, and every FAN
consecutive nodes become one until one is left; the trees' roots, ordered by value, make the root.

Leaves are ranked by a range partitioning, and every FAN ** BLOCK_LEVELS consecutive ones form an
aligned block.  A first pass turns each block into its root, and the block roots are the leaves
of the same operation one storey up, until each tree has one node.  On the way back every block
meets the proof of its root, and a fractal traversal of the block emits its leaves' authentication
paths one after another: for each band of STEP levels it keeps the existing subtree that the present
leaf lies in and the desired one to its right, which takes in one leaf whenever the traversal
advances by one and replaces the existing subtree just when the traversal enters it.  A task
holds one block of leaves and (FAN ** STEP) * 2 nodes a band, whatever the size of the dataset.

A leaf is the hash of the row's columns, each as its length in UTF-8 bytes, a colon and the
value, `-` if null.  Null ids come first; rows with equal ids are ordered by their leaves, equal
rows stand side by side, each with a proof of its own.  The null tree comes first.  An empty table
gives an empty result; columns outside `columns` are not part of a leaf.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partyloom.llm.common import materialize

FAN, BITS = 8, 3
#: Levels of a block (4,096 leaves) and of a band of the traversal.
BLOCK_LEVELS, STEP = 4, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(df: DataFrame, columns: tuple = COLUMNS, instead: dict[str, Column] | None = None) -> Column:
    """The leaf of a row as 32 bytes.  instead: expressions that replace columns."""
    parts = []
    for c in columns:
        value = (instead or {}).get(c, df[c]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def join_hash(digests: bytes) -> bytes:
    """The node over packed digests, which are hashed as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def depth(n: int) -> int:
    """Levels above n leaves until one node is left."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


class Band:
    """A subtree that spans the levels base .. base + height - 1, built leaf by leaf."""

    def __init__(self, base: int, height: int):
        self.base, self.height = base, height
        #: nodes[k]: packed digests of level base + k under this subtree's root, left to right
        self.nodes = [bytearray() for _ in range(height)]
        #: nodes of lower levels that wait for their siblings
        self.waiting = [bytearray() for _ in range(base)]

    def _put(self, level: int, digest: bytes) -> None:
        while level < self.base + self.height:
            row = self.waiting[level] if level < self.base else self.nodes[level - self.base]
            row += digest
            if len(row) % (32 * FAN):
                return
            digest = join_hash(bytes(row[-32 * FAN :]))
            if level < self.base:
                row.clear()
            level += 1

    def take(self, digest: bytes) -> None:
        self._put(0, digest)

    def end(self) -> None:
        """No more leaves: runs that stay short become nodes."""
        for level in range(self.base + self.height - 1):
            row = self.waiting[level] if level < self.base else self.nodes[level - self.base]
            short = len(row) % (32 * FAN)
            if short:
                digest = join_hash(bytes(row[-short:]))
                if level < self.base:
                    row.clear()
                self._put(level + 1, digest)


def traverse(leaves: list[bytes], height: int, step: int = STEP):
    """(siblings, shape) of each leaf in turn: packed digests from the bottom up, and two bytes a level (own place, width)."""
    bases = list(range(0, height, step))
    spans = [FAN ** min(b + step, height) for b in bases]
    exist: list[Band] = []
    for b, span in zip(bases, spans, strict=True):
        band = Band(b, min(step, height - b))
        for d in leaves[:span]:
            band.take(d)
        if span >= len(leaves):
            band.end()
        exist.append(band)
    desire: list[Band | None] = [None] * len(bases)
    for i in range(len(leaves)):
        for k, (b, span) in enumerate(zip(bases, spans, strict=True)):
            if i and i % span == 0:
                exist[k], desire[k] = desire[k], None
            ahead = (i // span + 1) * span + i % span
            if ahead < len(leaves):
                desire[k] = desire[k] or Band(b, min(step, height - b))
                desire[k].take(leaves[ahead])
            if ahead == len(leaves) - 1:
                desire[k].end()
        path, shape = [], bytearray()
        for level in range(height):
            k = level // step
            row = exist[k].nodes[level - bases[k]]
            at = (i % spans[k]) >> (BITS * level)
            first = (at - at % FAN) * 32
            run = row[first : first + 32 * FAN]
            place = at % FAN
            path.append(bytes(run[: 32 * place] + run[32 * place + 32 :]))
            shape += bytes((place, len(run) // 32))
        yield b"".join(path), bytes(shape)


def block_root(leaves: list[bytes], height: int) -> bytes:
    row = b"".join(leaves)
    for _ in range(height):
        row = b"".join(join_hash(row[a : a + 32 * FAN]) for a in range(0, len(row), 32 * FAN))
    return row


def fold(digest: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for k in range(0, len(shape), 2):
        place, others = shape[k], shape[k + 1] - 1
        row = siblings[at : at + 32 * others]
        digest = join_hash(row[: 32 * place] + digest + row[32 * place :])
        at += 32 * others
    return digest


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with `pos` (from 0) and `n` within their tree; written to the shared folder.

    Range partitions are numbered in order, and so are the rows in each; a tree's offset in a
    partition is a running sum over one row for each partition and tree.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("__part", F.shiftright("__at", 33)), "ranked")
    starts = dealt.groupBy(F.col(tree).alias("__t"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__t")
    starts = starts.withColumn("__before", F.sum("__c").over(w.orderBy("__p")) - F.col("__c")).withColumn("n", F.sum("__c").over(w))
    # one row for each range partition and tree in it, partitions + trees at most
    met = dealt.join(F.broadcast(starts) if starts.count() <= MOST_STARTS else starts, F.col(tree).eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__p")))
    return met.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__t", "__p", "__first", "__c", "__before")


#: Rows of the table of offsets that are broadcast (some 40 bytes each); more are joined by a shuffle.
MOST_STARTS = 500_000
PROOF = "siblings binary, shape binary, subroot binary, root binary"


def proofs(nodes: DataFrame, crowned: bool = True) -> DataFrame:
    """nodes: (tree, pos, n, digest, ...) with n nodes in each tree; adds siblings, shape, subroot and root.

    crowned: the trees' roots, in the order of their numbers, are the leaves of one more tree.
    """
    if nodes.where("n > 1").isEmpty():
        if not crowned:
            return nodes.withColumns({"siblings": F.lit(b""), "shape": F.lit(b""), "subroot": F.col("digest"), "root": F.col("digest")})
        count = nodes.count()
        tops = nodes.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "digest")
        crown = materialize(proofs(tops, False).select(F.col("pos").alias("tree"), "siblings", "shape", F.col("digest").alias("subroot"), "root"), "crown")
        return nodes.join(crown, "tree")  # one row a tree on either side
    blocked = nodes.withColumn("block", F.shiftright("pos", BITS * BLOCK_LEVELS))
    size = FAN**BLOCK_LEVELS

    def roots(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows.column("n")[0].as_py()
        top = block_root(rows.column("digest").to_pylist(), min(BLOCK_LEVELS, depth(n)))
        return pa.table([rows.column("tree").slice(0, 1), rows.column("block").slice(0, 1), pa.array([-(-n // size)], pa.int64()), pa.array([top], pa.binary())], ["tree", "pos", "n", "digest"])

    tops = materialize(blocked.select("tree", "pos", "block", "n", "digest").groupBy("tree", "block").applyInArrow(roots, "tree long, pos long, n long, digest binary"), "blocks")
    upper = proofs(tops, crowned).select("tree", F.col("pos").alias("block"), "siblings", "shape", "subroot", "root")
    carried = nodes.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)

    def paths(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        more_siblings, more_shape, subroot, root = (above.column(c)[0].as_py() for c in ("siblings", "shape", "subroot", "root"))
        height = min(BLOCK_LEVELS, depth(rows.column("n")[0].as_py()))
        siblings, shape = [], []
        for path, form in traverse(rows.column("digest").to_pylist(), height):
            siblings.append(path + more_siblings)
            shape.append(form + more_shape)
        fixed = [pa.array([x] * len(rows), pa.binary()) for x in (subroot, root)]
        return pa.table([*(rows.column(c) for c in carried), pa.array(siblings, pa.binary()), pa.array(shape, pa.binary()), *fixed], [*carried, "siblings", "shape", "subroot", "root"])

    return blocked.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(paths, f"{kinds}, {PROOF}")


def manifest(rows: DataFrame, id_col: str = "doc_id", by: str = "lang", leaf_col: str = "leaf") -> DataFrame:
    """rows: leaves (32 bytes) with id, tree and any carried columns; adds pos, siblings, shape, subroot and root.

    siblings: the digests of the proof, packed, bottom up and left to right; shape: two bytes a
    level, the row's place in its run and the run's width.
    """
    spark = rows.sparkSession
    placed = ranked(rows.withColumnRenamed(leaf_col, "digest"), by, [id_col, "digest"])
    trees = ranked(placed.select(F.col(by).alias("__by")).distinct().withColumn("__all", F.lit(0)), "__all", ["__by"]).select("__by", F.col("pos").alias("tree"))
    trees = materialize(trees, "trees")
    named = F.broadcast(trees) if trees.count() <= MOST_STARTS else trees
    nodes = placed.join(named, placed[by].eqNullSafe(F.col("__by"))).drop("__by")
    return proofs(nodes).drop("tree", "n").withColumnRenamed("digest", leaf_col)


def folded(proved: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """The rows of a manifest with `folded_root`, to which the leaves in leaf_col lead by the rows' proofs."""

    def run(batches):
        for batch in batches:
            each = zip(*(batch.column(c).to_pylist() for c in (leaf_col, "siblings", "shape")), strict=True)
            found = pa.array([fold(*x) for x in each], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "folded_root"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proved.schema.fields)
    return proved.mapInArrow(run, f"{kinds}, folded_root binary")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), rows AS (
  SELECT doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         "text" AS t,
         CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE "text" END AS t2
  FROM documents LEFT JOIN crc USING (doc_id)
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS leaf, sha256(head || coalesce(strlen(t2) || ':' || t2, '-')) AS leaf2 FROM rows
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves
), low AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 8
), sub AS (
  SELECT tree, h FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM sub) AS n, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 8
), low_runs AS (
  SELECT tree, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 8
), high_runs AS (
  SELECT lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM high WHERE n > 1 GROUP BY lvl, pos // 8
), steps AS (
  SELECT p.tree, p.pos, r.lvl, hs, (p.pos >> (3 * r.lvl)) % 8 AS k FROM placed p JOIN low_runs r ON r.tree = p.tree AND r.run = p.pos >> (3 * r.lvl + 3)
  UNION ALL
  SELECT p.tree, p.pos, 100 + r.lvl, hs, (p.tree >> (3 * r.lvl)) % 8 FROM placed p JOIN high_runs r ON r.run = p.tree >> (3 * r.lvl + 3)
), paths AS (
  SELECT tree, pos, list({'l': array_to_string(hs[1:k], ''), 'r': array_to_string(hs[k + 2:], '')} ORDER BY lvl) AS path FROM steps GROUP BY tree, pos
), told AS (
  SELECT *, coalesce(path, []) AS way FROM placed LEFT JOIN paths USING (tree, pos)
), folded AS (
  SELECT doc_id, leaf, tree, array_to_string(list_transform(way, lambda s: s.l || s.r), '') AS proof,
         list_reduce(list_prepend({'l': leaf2, 'r': ''}, way), lambda a, b: {'l': sha256(b.l || a.l || b.r), 'r': ''}).l AS folded_root
  FROM told
)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM folded JOIN sub USING (tree), (SELECT h FROM high WHERE n = 1) top
"""
