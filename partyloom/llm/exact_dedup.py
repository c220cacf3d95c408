"""Exact dedup by a tree-merge of sorted digest runs.

Each task turns its texts into runs: (digest, length, smallest id, largest id, count) sorted by
digest, its own duplicates already collapsed.  A run travels as segments, one packed row for each
shard of the digests, so no task ever holds a whole level.  In binomial rounds, runs whose numbers
agree after dropping their last bits meet; their sorted segments are merged many ways at once and
equal digests collapse again, each level keeping the identifiers of verified groups only (the
lengths must agree with the digest).  A group of any size is one entry per run from the first
level on, so a hot text never piles up; shards are as many as keep SHARD_ROWS entries a merge.

Null texts count as empty; empty texts are equal to each other.  Null ids never win against other
ids and are reported as null keepers only where a group has nothing else.  Of repeated rows with
the winning id exactly one is kept.  An empty table gives an empty result.  Extra columns are
ignored by `groups`, and carried through by `keep_one`.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partyloom.llm.common import keep_rows, materialize, string_views, winners

#: Bits of the run number that a round drops: 8 runs meet in each round.
ROUND_BITS = 3
RUN_BITS = 9
#: Rows that the last merge of a shard sees at most, if digests spread; digests that a task holds before it begins another run.
SHARD_ROWS, RUN_ROWS = 1 << 16, 1 << 17
#: Groups at least this share of all rows are joined by a broadcast: there are at most 1/share of them.
HOT_SHARE = 1 / 2000


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes, key): SHA-256 of the A-Z lower-cased text in UTF-8; key hashes the text as it is."""
    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("key"))

    def run(batches):
        for batch in batches:
            offsets, flat = string_views(batch.column(1))
            view, at = memoryview(flat), offsets.tolist()
            digests = [hashlib.sha256(bytes(view[a:b]).lower()).digest() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(np.diff(offsets)), batch.column(2)], ["id", "digest", "n_bytes", "key"])

    return source.mapInArrow(run, "id long, digest binary, n_bytes long, key long")


SEGMENT = "run int, shard int, digests binary, n_bytes array<bigint>, low array<bigint>, high array<bigint>, n array<bigint>"


def collapse(entries):
    """Neighbours of a sorted stream of (digest, n_bytes, low, high, n) with equal digests as one; verified by length."""
    held = None
    for e in entries:
        if held is None or held[0] != e[0]:
            if held is not None:
                yield held
            held = e
            continue
        if held[1] != e[1]:
            raise ValueError("equal digests of texts of different length")
        low = e[2] if held[2] is None else held[2] if e[2] is None else min(held[2], e[2])
        high = e[3] if held[3] is None else held[3] if e[3] is None else max(held[3], e[3])
        held = (held[0], held[1], low, high, held[4] + e[4])
    if held is not None:
        yield held


def segments(run: int, entries, shards: int, of: int | None = None) -> pa.RecordBatch:
    """Sorted entries as packed rows, one for each shard; `of` names the shard if there is but one."""
    by: dict[int, list[tuple]] = {}
    for e in entries:
        by.setdefault(int.from_bytes(e[0][:4], "big") % shards if of is None else of, []).append(e)
    lists = lambda k: pa.array([[e[k] for e in x] for x in by.values()], pa.list_(pa.int64()))
    packed = pa.array([b"".join(e[0] for e in x) for x in by.values()], pa.binary())
    names = ["run", "shard", "digests", "n_bytes", "low", "high", "n"]
    return pa.RecordBatch.from_arrays([pa.array([run] * len(by), pa.int32()), pa.array(list(by), pa.int32()), packed, *map(lists, (1, 2, 3, 4))], names)


def unpack(digests: bytes, *columns: list) -> list[tuple]:
    return list(zip((digests[i : i + 32] for i in range(0, len(digests), 32)), *columns, strict=True))


def sorted_runs(digests: DataFrame, shards: int) -> DataFrame:
    """The first level: each task's sorted, collapsed runs, in segments."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() % (1 << RUN_BITS)
        held: list[tuple] = []
        for batch in batches:
            ids, keys, sizes = (batch.column(k).to_pylist() for k in range(3))
            held += [(d, n, i, i, 1) for i, d, n in zip(ids, keys, sizes, strict=True)]
            if len(held) > RUN_ROWS:
                held.sort(key=lambda e: e[0])
                yield segments(number, collapse(held), shards)
                held = []
        held.sort(key=lambda e: e[0])
        yield segments(number, collapse(held), shards)

    return digests.select("id", "digest", "n_bytes").mapInArrow(run, SEGMENT)


def tree_merge(digests: DataFrame, count: int) -> DataFrame:
    """(digest, n_bytes, low, high, n): one row per distinct text, by binomial rounds over the sorted runs."""
    shards = max(1, -(-count // SHARD_ROWS))
    runs = sorted_runs(digests, shards)

    def merge(rows: pa.Table) -> pa.Table:
        columns = [rows.column(k).to_pylist() for k in ("digests", "n_bytes", "low", "high", "n")]
        streams = [unpack(*x) for x in zip(*columns, strict=True)]
        merged = collapse(heapq.merge(*streams, key=lambda e: e[0]))
        return pa.Table.from_batches([segments(rows.column("run")[0].as_py(), merged, shards, rows.column("shard")[0].as_py())])

    for _ in range(-(-RUN_BITS // ROUND_BITS)):
        runs = runs.withColumn("run", F.shiftright("run", ROUND_BITS)).groupBy("run", "shard").applyInArrow(merge, SEGMENT)

    def spread(batches):
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("digests", "n_bytes", "low", "high", "n")), strict=True):
                entries = list(zip(*unpack(*row), strict=True)) or [()] * 5
                kinds = (pa.binary(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(entries, kinds, strict=True)], ["digest", "n_bytes", "low", "high", "n"])

    return runs.mapInArrow(spread, "digest binary, n_bytes long, low long, high long, n long")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "low") -> DataFrame:
    """(id, keep_id, group_size, kept, digest, key) per row.  keep: "low" or "high", the identifier that stays."""
    digests = materialize(digest_rows(df, id_col, text_col), "digests")
    count = digests.count()
    merged = materialize(tree_merge(digests, count).select("digest", F.col(keep).alias("keep_id"), F.col("n").alias("group_size")), "groups")
    floor = F.lit(max(2, int(count * HOT_SHARE)))
    hot = F.broadcast(merged.where(F.col("group_size") >= floor))
    # rows of hot groups find their group by broadcast; all others by a shuffle in which no key is hot
    first = digests.join(hot, "digest", "left")
    done = first.where(F.col("group_size").isNotNull())
    rest = first.where(F.col("group_size").isNull()).drop("keep_id", "group_size").join(merged.where(F.col("group_size") < floor), "digest")
    every = done.select("id", "keep_id", "group_size", "digest", "key").unionByName(rest.select("id", "keep_id", "group_size", "digest", "key"))
    # the winner's own repeated rows: only rows with the winning id are looked at
    wins = F.col("id").eqNullSafe(F.col("keep_id"))
    winners = every.where(wins).withColumn("kept", F.row_number().over(Window.partitionBy("digest").orderBy("id")) == 1)
    return winners.unionByName(every.where(~wins).withColumn("kept", F.lit(False)))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "high") -> DataFrame:
    """The rows of df that stay, with all their columns: one for each distinct text."""
    found = groups(df, id_col, text_col, keep)
    return keep_rows(df, winners(found, "digest", "keep_id"), id_col, text_col)
