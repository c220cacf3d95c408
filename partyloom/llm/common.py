"""Shared helpers: Arrow text access, shared-folder tables, bounded samples."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker; a longer text is handled alone.
CHUNK_BYTES = 2 << 20
#: White space of the word contracts: space and U+0009..U+000D.
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares.  Where it is unset a local session gets one of its own; a cluster is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="partyloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/partyloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null where the id is null."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def hash_sample(columns: list, salt: int, want: int, count: int) -> Column:
    """Whether a row is among about `want` of `count` rows, by the 64-bit hash of its columns; holds at any count."""
    if count <= want:
        return F.lit(True)
    return F.xxhash64(*columns, F.lit(salt)) < F.lit(-(1 << 63) + (want << 64) // count)


def string_views(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without copying; null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        width = np.int64
    else:
        width = np.int32
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], flat[offsets[0] : offsets[-1]]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows with at most `limit` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat indices of the slices [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the slices between offsets; 0 for empty slices."""
    run = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def winners(rows: DataFrame, group_col: str, keep_col: str) -> DataFrame:
    """(id, key, times): one row of each group among those with id = keep_col.  rows: (id, key, ...).

    key tells rows with one id apart; times says how many rows share both.
    """
    own = rows.where(F.col("id").eqNullSafe(F.col(keep_col))).groupBy(group_col, "id", "key").agg(F.count(F.lit(1)).alias("times"))
    best = own.groupBy(group_col).agg(F.min(F.struct("key", "times", "id")).alias("w"))
    return best.select("w.id", "w.key", "w.times")


def keep_rows(df: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that `chosen` (id, key, times) names, each once, with all columns; key is the text's xxhash64."""
    chosen = materialize(chosen.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("times").alias("__times")), "chosen")
    same = (F.xxhash64(df[text_col]) == chosen["__key"]) & df[id_col].cast("long").eqNullSafe(chosen["__id"])
    met = df.join(chosen.hint("shuffle_hash"), same)
    more = ["__id", "__key", "__times"]
    if chosen.where(F.col("__times") > 1).isEmpty():
        return met.drop(*more)
    once = met.where(F.col("__times") > 1).dropDuplicates(["__key", "__id"])
    return met.where(F.col("__times") == 1).unionByName(once).drop(*more)
