"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the copy probability target / source size, at most 2.  Its whole
part is taken outright.  The fractional parts are rounded in pairs: mass moves from one document
to the other, in units of words, until one of the two is integral; which way it moves is random
and keeps every document's expectation, and the pair's words never change.  A leaf of the
reduction tree holds the documents of one source whose id and text hash to it and leaves one fractional
document at most; leaves then meet FAN at a time, level by level, until one fractional document
remains for each source, which is rounded by itself.  So a source's taken words differ from its
target by less than one document.  A source of any size is spread over its leaves.

Random numbers come from the seed, source and level, and leaves from ids and sizes, so reruns
agree under any partitioning.  Rows that are equal in all of this, if they are more than HOT_SHARE
of all rows, are counted and dealt anew by number, so that no leaf holds them all.  Null texts and texts without words have size 0 and take 0; the null
source is a source and comes last.  Null ids hash like any other value; repeated rows are
documents of their own.  Without any words all targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partyloom.llm.common import materialize

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
LEAF_ROWS, FAN = 2048, 64
#: Equal rows from this share of all rows on (1/share kinds at most) are numbered.
HOT_SHARE = 1 / 20000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[object, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[object, float]:
    """Target of each source: by weight, at most `most` times its size, the excess dealt again by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, full, out = share * sum(size.values()), {}, {}
    while True:
        free = [s for s in weight if s not in full]
        total = sum(weight[s] for s in free)
        out = {s: left * weight[s] / total for s in free}
        over = [s for s in free if out[s] > most * size[s]]
        if not over:
            return full | out
        for s in over:
            full[s] = most * size[s]
        left = share * sum(size.values()) - sum(full.values())
        if len(full) == len(weight):
            return full


def round_pairs(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal rounding of the fractions `part` of documents with these sizes; one stays fractional at most.

    Words move between two documents, so size * part keeps its sum.
    """
    out = part.copy()
    a = -1
    draws = rng.random(len(out))
    for b in range(len(out)):
        if not 0 < out[b] < 1:
            continue
        if a < 0:
            a = b
            continue
        sa, sb = size[a], size[b]
        up = min((1 - out[a]) * sa, out[b] * sb)  # words that can move from b to a
        down = min(out[a] * sa, (1 - out[b]) * sb)
        if draws[b] * (up + down) < down:
            full_a, full_b = up == (1 - out[a]) * sa, up == out[b] * sb
            out[a] = 1.0 if full_a else out[a] + up / sa
            out[b] = 0.0 if full_b else out[b] - up / sb
        else:
            empty_a, empty_b = down == out[a] * sa, down == (1 - out[b]) * sb
            out[a] = 0.0 if empty_a else out[a] - down / sa
            out[b] = 1.0 if empty_b else out[b] + down / sb
        for k in (a, b):  # what float error leaves
            if out[k] < 1e-12 or out[k] > 1 - 1e-12:
                out[k] = round(out[k])
        a = a if 0 < out[a] < 1 else b if 0 < out[b] < 1 else -1
    return out


def _dealer(order: list[str], seed: int, level: int, last: bool):
    """Rounds one leaf's documents; on the last level the one left over as well."""

    def deal(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        key = repr((seed, rows.column("source")[0].as_py(), level, rows.column("__leaf")[0].as_py()))
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big"))
        size = rows.column("size").to_numpy().astype(float)
        part = rows.column("__part").to_numpy().astype(float)
        # large documents first: what stays fractional at the end is small
        at = np.argsort(-size, kind="stable")
        part[at] = round_pairs(size[at], part[at], rng)
        if last:
            left = (part > 0) & (part < 1)
            part[left] = rng.random(int(left.sum())) < part[left]
        return rows.set_column(rows.column_names.index("__part"), "__part", pa.array(part))

    return deal


def copies(rows: DataFrame, ratio_of: dict, seed: int = 0) -> DataFrame:
    """rows: (id, source, size, __h) and any carried columns; __h tells documents with one id apart; adds `copies`, the whole number of times each row is taken."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(s, float(r)) for s, r in ratio_of.items()] or [(None, 0.0)], "__s string, __ratio double")
    rows = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["__s"]), "left").drop("__s")
    whole = F.floor("__ratio").cast("long")
    rows = rows.withColumn("__part", F.col("__ratio") - whole).withColumn("__whole", whole)
    still = (F.col("size") == 0) | (F.col("__part") == 0)
    done = [rows.where(still).withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("__whole")).cast("long")).drop("__ratio", "__part", "__whole")]
    open_ = rows.where(~still).drop("__ratio")
    count = rows.count()
    leaves = max(1, math.ceil(count / LEAF_ROWS))
    depth = max(1, math.ceil(math.log(leaves, FAN))) if leaves > 1 else 0
    floor = max(LEAF_ROWS, int(count * HOT_SHARE))
    copied = open_.groupBy(*open_.columns).agg(F.count(F.lit(1)).alias("__copies")).where(F.col("__copies") >= floor)
    copied = materialize(copied, "copied")  # 1 / HOT_SHARE rows at most
    open_ = open_.withColumn("__n", F.lit(0).cast("long"))
    if not copied.isEmpty():
        alike = reduce(and_, (open_[c].eqNullSafe(copied[c]) for c in rows.columns if c != "__ratio"))
        again = copied.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).drop("__copies")
        open_ = open_.join(F.broadcast(copied.select(*(c for c in copied.columns if c != "__copies"))), alike, "left_anti").unionByName(again)
    open_ = open_.withColumn("__leaf", F.pmod(F.xxhash64("id", "size", "__h", "__n"), F.lit(leaves)).cast("long")).drop("__n")
    extra = [c for c in rows.columns if c not in ("id", "source", "size", "__ratio", "__part", "__whole")]
    order = ["id", "size", *extra]

    for level in range(depth + 1):
        dealt = open_.groupBy("source", "__leaf").applyInArrow(_dealer(order, seed, level, level == depth), open_.schema)
        dealt = materialize(dealt, f"mix{level}")
        settled = (F.col("__part") <= 0) | (F.col("__part") >= 1)
        done.append(dealt.where(settled).withColumn("copies", F.col("__whole") + F.col("__part").cast("long")).drop("__part", "__whole", "__leaf"))
        open_ = dealt.where(~settled).withColumn("__leaf", F.floor(F.col("__leaf") / FAN).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple = (), weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """(id, size, source_size, target, copies, taken) and the carried columns, for each row of df."""
    size = F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    rows = df.select(df[id_col].alias("id"), df[source_col].alias("source"), size.alias("size"), F.xxhash64(df[text_col]).alias("__h"), *[df[c].alias(f"c_{c}") for c in carry])
    rows = materialize(rows, "sizes")
    sums = [(r["source"], r["s"]) for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()]  # one row a source
    goal = targets(sums, weights, share, most) if sums else {}
    ratio = {s: goal[s] / n if n else 0.0 for s, n in sums}
    out = copies(rows, ratio, seed)
    by = rows.sparkSession.createDataFrame([(s, n, float(goal[s])) for s, n in sums] or [(None, 0, 0.0)], "__s string, source_size long, target double")
    out = out.join(F.broadcast(by), out["source"].eqNullSafe(by["__s"]), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"c_{c}").alias(c) for c in carry if c != id_col])


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Rows of df, each as often as the mix takes it, with all columns."""
    keyed = df.withColumn("__key", F.xxhash64(df[text_col], df[source_col])).withColumn("__id", df[id_col])
    dealt = mix(keyed, "__id", text_col, source_col, carry=("__key",), **how).select(F.col("__id").alias("__i"), F.col("__key").alias("__k"), "copies")
    dealt = materialize(dealt, "dealt")
    same = (F.col("__key") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i"))
    if not dealt.groupBy("__i", "__k").count().where("count > 1").isEmpty():  # repeated rows: number them on both sides
        number = lambda i, k: F.row_number().over(Window.partitionBy(i, k).orderBy(i))
        dealt, keyed = dealt.withColumn("__n", number("__i", "__k")), keyed.withColumn("__m", number("__id", "__key"))
        same = same & (F.col("__n") == F.col("__m"))
    met = keyed.join(dealt.where("copies > 0").hint("shuffle_hash"), same)
    return met.withColumn("__again", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*df.columns)
