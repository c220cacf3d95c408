"""Stream-static screening: micro-batches of queries against the current snapshot.

An extension: the batch semantics of plans.screening hold within each micro-batch, and the
batch's number makes the sink idempotent when a batch is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partyloom.plans.screening import DEFAULT_THRESHOLD, screen


def screen_stream(queries: DataFrame, parties: DataFrame, out: str, checkpoint: str, threshold: float = DEFAULT_THRESHOLD) -> StreamingQuery:
    """Writes hits of a stream (qid, q) as Parquet, one folder a batch."""

    def batch(df: DataFrame, number: int) -> None:
        screen(df, parties, threshold).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit(events: DataFrame, key: str, at: str, most: int, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(key, window, n): keys over the limit in a window; late rows are dropped by the watermark (Q8)."""
    counts = events.withWatermark(at, late).groupBy(key, F.window(at, window)).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most)
