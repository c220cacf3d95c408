"""A stream of what changes from one snapshot version to the next: parties added and removed.

An extension.  The input is the versions' records as they are published, each with its version's
time.  State is kept per party: what it looked like and when it was seen last.  A record of a
party that wasn't there before is an addition; an absence is found by a timer, which goes off once
a newer version has moved the watermark past the party's last one.  State and timers are in the
checkpoint, so a restarted feed goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEPT = ("name", "authority", "list", "type")
CHANGE = "change string, id string, name string, authority string, list string, type string, version timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Presence(StatefulProcessor):
    """One party's presence over versions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"{c} string" for c in KEPT) + ", seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        every = pd.concat(list(rows)).sort_values("version")
        for version, row in every.groupby("version").last().iterrows():
            now = int(pd.Timestamp(version).timestamp() * 1000)
            held = self.last.get() if self.last.exists() else None
            if held is not None:
                seen = held[len(KEPT)]
                if seen >= now:
                    continue
                self.handle.deleteTimer(seen + 1)
                between = timerValues.getCurrentWatermarkInMs()
                if seen < between < now:  # a version without it has passed, and its timer hasn't gone off yet
                    out.append(self._row("removed", key, held[: len(KEPT)], between))
                    held = None
            if held is None:
                out.append(self._row("added", key, [row[c] for c in KEPT], now))
            self.last.update((*[row[c] for c in KEPT], now))
            self.handle.registerTimer(now + 1)
        if out:
            yield pd.concat(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            held = self.last.get()
            if held[len(KEPT)] < expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield self._row("removed", key, held[: len(KEPT)], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    @staticmethod
    def _row(change: str, key, values, at: int) -> pd.DataFrame:
        return pd.DataFrame([(change, key[0], *values, pd.Timestamp(at, unit="ms"))], columns=["change", "id", *KEPT, "version"])


def changes(records: DataFrame) -> DataFrame:
    """(change, id, name, authority, list, type, version) of a stream of records with `version`, a timestamp (J13 as a stream)."""
    rows = records.select("id", *KEPT, F.col("version").cast("timestamp").alias("version")).withWatermark("version", "0 seconds")
    return rows.groupBy("id").transformWithStateInPandas(Presence(), CHANGE, "append", "eventTime")


def follow(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of all versions there are now as Parquet; each version has to come in a micro-batch of its own or with older ones."""
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return changes(records).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
