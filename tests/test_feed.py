"""The change feed against snapshot.delta over versions, also after a restart."""

import datetime

from partyloom.plans import snapshot as snap
from partyloom.streaming import feed
from tests.parties import frame, party

DAYS = [datetime.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
VERSIONS = [("1", "2", "3", "4"), ("2", "3", "5"), ("1", "3", "5", "6"), ("3", "6")]


def publish(spark, path, k):
    rows = [party(i, f"Party {i}") for i in VERSIONS[k]]
    snapshot = frame(spark, rows)
    from pyspark.sql import functions as F

    snapshot.select("id", "name", "authority", "list", "type", F.lit(DAYS[k]).cast("timestamp").alias("version")).coalesce(1).write.mode("append").parquet(path)
    return snapshot


def test_feed_equals_deltas(spark, tmp_path):
    where, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    snapshots = [publish(spark, where, k) for k in (0, 1)]
    schema = spark.read.parquet(where).schema

    def run():
        records = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
        query = feed.follow(records, out, checkpoint)
        assert query.awaitTermination(240)
        return sorted((r["version"], r["change"], r["id"], r["name"]) for r in spark.read.parquet(out).collect())

    first = run()
    assert {r[2] for r in first if r[0] == DAYS[0]} == set(VERSIONS[0])
    snapshots += [publish(spark, where, k) for k in (2, 3)]  # a new process would find the same checkpoint
    got = run()
    want = [(DAYS[k], r["change"], r["id"], r["name"]) for k in (1, 2, 3) for r in snap.delta(snapshots[k - 1], snapshots[k]).collect()]
    assert [r for r in got if r[0] != DAYS[0]] == sorted(want)
