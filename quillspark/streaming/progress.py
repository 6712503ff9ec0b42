"""Cursors of channels as keyed state of a stream.

For each channel the state holds the last id of a forward run or the least id of a reverse run, the number of messages, and
with ``keep_ms`` the ids seen lately, which expire after that time. A message whose id is among those is a repetition and
counts as such, no more. State that expires needs a running clock, and a stream with one never ends by itself: bounded replays
(``availableNow``) go without. A channel tells its progress after every ``every`` messages and at the end of each batch that brought it something; the last row of a
channel is its cursor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

EVERY, KEEP_MS = 100, 60_000
PROGRESS = "channel string, last_message_id long, reverse_min_id long, messages long, repeated long, final boolean"


class ChannelProgress(StatefulProcessor):
    def __init__(self, reverse: bool = False, every: int = EVERY, keep_ms: int | None = KEEP_MS):
        self.reverse, self.every, self.keep_ms = reverse, every, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "last_id long, least_id long, messages long, repeated long")
        self.recent = handle.getMapState("recent", "message_id long", "seen boolean", ttlDurationMs=self.keep_ms) if self.keep_ms is not None else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, least, messages, repeated = self.cursor.get() if self.cursor.exists() else (None, None, 0, 0)
        told = []

        def tell(final: bool) -> None:
            told.append((key[0], last, least, messages, repeated, final))

        highest = None  # of this batch: a forward run overwrites its cursor, be it lower
        for part in rows:
            for k in part["message_id"].astype("int64").tolist():
                if self.recent is not None:
                    if self.recent.containsKey((k,)):
                        repeated += 1
                        continue
                    self.recent.updateValue((k,), (True,))
                messages += 1
                if self.reverse:
                    least = k if not least or k < least else least
                else:
                    highest = k if highest is None else max(highest, k)
                    last = highest
                if messages % self.every == 0:
                    tell(False)
        self.cursor.update((last, least, messages, repeated))
        tell(True)
        names = ["channel", "last_message_id", "reverse_min_id", "messages", "repeated", "final"]
        kinds = {"last_message_id": "Int64", "reverse_min_id": "Int64", "messages": "int64", "repeated": "int64"}
        yield pd.DataFrame(told, columns=names).astype(kinds)

    def close(self) -> None:
        pass


def channel_progress(messages: DataFrame, reverse: bool = False, every: int = EVERY, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Progress rows of a stream (channel, message_id), in update mode; it needs the state store of ``ingest.STATE``."""
    rows = messages.select("channel", "message_id").filter("channel IS NOT NULL AND message_id IS NOT NULL")
    return rows.groupBy("channel").transformWithStateInPandas(ChannelProgress(reverse, every, keep_ms), PROGRESS, "Update", "None" if keep_ms is None else "ProcessingTime")


def latest_cursors(spark: SparkSession, path: str) -> DataFrame:
    """The last final row of each channel among progress written with its batch number."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(path).filter("final")
    return rows.groupBy("channel").agg(F.max_by(F.struct("last_message_id", "reverse_min_id", "messages", "repeated"), "batch").alias("c")).select("channel", "c.*")
