"""Data sources around an injected client: messages of channels by id range, bars of symbols by day range.

``message_source`` and ``bar_source`` make a class that ``spark.dataSource.register`` takes; ``spark.read.format`` then reads
in partitions of bounded ranges, and ``readStream`` goes on from stored offsets, the last id of each channel. The client is
made on the driver and in each task by the factory that is given; it needs no more than the methods named below, so a network
client, a test's list or a file will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class MessageClient(Protocol):
    def channels(self) -> Iterable[str]: ...

    def last_id(self, channel: str) -> int:
        """The highest message id, 0 for none."""

    def messages(self, channel: str, after: int, upto: int) -> Iterable[tuple[int, datetime | None, str | None]]:
        """(message_id, posted_at, text) with after < message_id <= upto."""


class BarClient(Protocol):
    def symbols(self) -> Iterable[str]: ...

    def bars(self, symbol: str, first: date, last: date) -> Iterable[tuple[date, float, float, float, float, int]]:
        """(day, open, high, low, close, volume) of days between both, inclusive."""


MESSAGES = "channel string, message_id long, posted_at timestamp, text string"
BARS = "symbol string, day date, open double, high double, low double, close double, volume long"


@dataclass
class Ids(InputPartition):
    channel: str
    after: int
    upto: int


@dataclass
class Days(InputPartition):
    symbol: str
    first: date
    last: date


def id_ranges(start: dict[str, int], end: dict[str, int], step: int) -> list[Ids]:
    """Ranges of at most ``step`` ids from each channel's start, which is not included, to its end."""
    return [Ids(channel, after, min(after + step, upto)) for channel, upto in sorted(end.items()) for after in range(start.get(channel, 0), upto, step)]


def _wanted(options, client: MessageClient) -> list[str]:
    named = options.get("channels")
    return named.split(",") if named else sorted(client.channels())


class _Messages:
    """What the batch and the stream reader share. Options: channels (comma-separated; all), idsPerPartition, after (JSON of ids)."""

    def __init__(self, factory: Callable[[], MessageClient], options):
        self.factory, self.options = factory, options
        self.step = int(options.get("idsPerPartition", "10000"))
        self.start = json.loads(options.get("after", "{}"))

    def ends(self) -> dict[str, int]:
        client = self.factory()
        return {c: client.last_id(c) for c in _wanted(self.options, client)}

    def rows(self, partition: Ids) -> Iterator[tuple]:
        for message_id, posted_at, text in self.factory().messages(partition.channel, partition.after, partition.upto):
            yield partition.channel, message_id, posted_at, text


class _MessageReader(_Messages, DataSourceReader):
    def partitions(self):
        return id_ranges(self.start, self.ends(), self.step) or [Ids("", 0, 0)]  # Spark asks for one

    def read(self, partition: Ids) -> Iterator[tuple]:
        return self.rows(partition) if partition.upto > partition.after else iter(())


class _MessageStream(_Messages, DataSourceStreamReader):
    """Offsets are the last ids of the channels; a batch takes ``idsPerBatch`` new ids of each channel at most, if that is told."""

    def __init__(self, factory: Callable[[], MessageClient], options):
        super().__init__(factory, options)
        self.most = int(options["idsPerBatch"]) if "idsPerBatch" in options else None
        self.told: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return dict(self.start)

    def latestOffset(self) -> dict:
        ends = self.ends()
        if self.most is not None:
            before = self.told if self.told is not None else self.start
            ends = {c: min(upto, before.get(c, 0) + self.most) for c, upto in ends.items()}
        self.told = {c: max(upto, (self.told or self.start).get(c, 0)) for c, upto in ends.items()}
        return dict(self.told)

    def partitions(self, start: dict, end: dict):
        self.told = {**(self.told or {}), **{c: max(upto, (self.told or {}).get(c, 0)) for c, upto in end.items()}}
        return id_ranges(start, end, self.step)

    def read(self, partition: Ids) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held that a finished batch would free."""


def message_source(factory: Callable[[], MessageClient], name: str = "channel_messages") -> type[DataSource]:
    class MessageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return MESSAGES

        def reader(self, schema: StructType) -> DataSourceReader:
            return _MessageReader(factory, self.options)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _MessageStream(factory, self.options)

    return MessageSource


class _BarReader(DataSourceReader):
    """Options: first and last (days), symbols (comma-separated; all), daysPerPartition."""

    def __init__(self, factory: Callable[[], BarClient], options):
        self.factory, self.options = factory, options
        self.first, self.last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])
        self.step = int(options.get("daysPerPartition", "365"))

    def partitions(self):
        named = self.options.get("symbols")
        symbols = named.split(",") if named else sorted(self.factory().symbols())
        symbols = symbols if self.first <= self.last else []
        begins = [self.first + timedelta(days=k) for k in range(0, (self.last - self.first).days + 1, self.step)]
        return [Days(s, b, min(b + timedelta(days=self.step - 1), self.last)) for s in symbols for b in begins] or [Days("", self.first, self.last)]  # Spark asks for one

    def read(self, partition: Days) -> Iterator[tuple]:
        if partition.symbol:
            for bar in self.factory().bars(partition.symbol, partition.first, partition.last):
                yield (partition.symbol, *bar)


def bar_source(factory: Callable[[], BarClient], name: str = "symbol_bars") -> type[DataSource]:
    class BarSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BARS

        def reader(self, schema: StructType) -> DataSourceReader:
            return _BarReader(factory, self.options)

    return BarSource
