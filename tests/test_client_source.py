"""Sources around a client, and keyed cursors that survive a restart."""

from __future__ import annotations

import json
import sys
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark import cloudpickle

from quillspark.sources import client_source
from quillspark.streaming import ingest, progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Told:
    """A client over a JSON file of {channel: last id}; every third id is missing."""

    def __init__(self, path):
        self.path = path

    def channels(self):
        return json.load(open(self.path))

    def last_id(self, channel):
        return json.load(open(self.path)).get(channel, 0)

    def messages(self, channel, after, upto):
        return [(k, datetime(2024, 1, 1) + timedelta(minutes=k), f"{channel} {k}" if k % 5 else None) for k in range(after + 1, upto + 1) if k % 3]


class Days:
    def symbols(self):
        return ["A", "B"]

    def bars(self, symbol, first, last):
        return [(first + timedelta(days=k), 1.0, 2.0, 0.5, 1.5, 10 * k) for k in range((last - first).days + 1) if symbol == "A" or k % 2]


def expected(ends):
    return sorted((c, k) for c, upto in ends.items() for k in range(1, upto + 1) if k % 3)


@pytest.fixture
def told(spark, tmp_path):
    path = str(tmp_path / "channels.json")

    def tell(**ends):
        with open(path, "w") as f:
            json.dump(ends, f)

    tell()
    spark.dataSource.register(client_source.message_source(lambda: Told(path)))
    return tell


def test_messages_by_ranges(spark, told):
    assert spark.read.format("channel_messages").load().count() == 0
    told(a=25, b=4)
    rows = spark.read.format("channel_messages").option("idsPerPartition", 10).load()
    assert rows.rdd.getNumPartitions() == 4
    assert sorted((r["channel"], r["message_id"]) for r in rows.collect()) == expected({"a": 25, "b": 4})
    later = spark.read.format("channel_messages").option("after", '{"a": 20}').option("channels", "a").load()
    assert sorted(r["message_id"] for r in later.collect()) == [22, 23, 25]
    assert rows.filter("message_id = 5").first()["text"] is None and rows.filter("message_id = 4 AND channel = 'b'").first()["posted_at"] == datetime(2024, 1, 1, 0, 4)


def test_bars_by_days(spark):
    spark.dataSource.register(client_source.bar_source(Days))
    rows = spark.read.format("symbol_bars").options(first="2024-01-01", last="2024-01-10", daysPerPartition="4").load()
    assert rows.rdd.getNumPartitions() == 6
    assert rows.filter("symbol = 'A'").count() == 10 and {r["day"] for r in rows.collect()} <= {date(2024, 1, 1) + timedelta(days=k) for k in range(10)}
    assert spark.read.format("symbol_bars").options(first="2024-01-02", last="2024-01-01").load().count() == 0


def test_stream_goes_on_at_the_stored_offset(spark, told, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        rows = spark.readStream.format("channel_messages").option("idsPerPartition", 7).load()
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()

    for ends in ({"a": 20}, {"a": 20, "b": 5}, {"a": 31, "b": 5}, {"a": 31, "b": 5}):
        told(**ends)
        run()
        got = spark.read.parquet(target)
        assert sorted((r["channel"], r["message_id"]) for r in got.collect()) == expected(ends)


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in ingest.STATE}
    for k, v in ingest.STATE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_progress(spark, source, target, checkpoint, **settings):
    rows = spark.readStream.schema("channel string, message_id long").option("maxFilesPerTrigger", 1).parquet(source)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
    trigger = {"availableNow": True} if settings.get("keep_ms", 0) is None else {"processingTime": "1 second"}
    return progress.channel_progress(rows, **settings).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


@pytest.mark.parametrize("reverse", [False, True])
def test_restarted_cursors_equal_those_of_one_run(spark, tmp_path, rocks, reverse):
    source = str(tmp_path / "in")
    batches = [[("a", k) for k in range(1, 251)] + [("b", 9), ("b", 7), (None, 1)], [("a", k) for k in range(251, 300)] + [("b", 4)], [("c", 5), ("a", 1000)]]
    one, two = (str(tmp_path / n) for n in ("one", "two"))
    for rows in batches:
        spark.createDataFrame(rows, "channel string, message_id long").coalesce(1).write.mode("append").parquet(source)
        assert start_progress(spark, source, f"{two}/rows", f"{two}/cp", reverse=reverse, keep_ms=None).awaitTermination(60)  # stopped, and started again
    assert start_progress(spark, source, f"{one}/rows", f"{one}/cp", reverse=reverse, keep_ms=None).awaitTermination(60)
    cursors = [sorted(tuple(r) for r in progress.latest_cursors(spark, f"{p}/rows").collect()) for p in (one, two)]
    counts = {"a": (300, 0), "b": (3, 0), "c": (1, 0)}
    ends = {"a": (None, 1), "b": (None, 4), "c": (None, 5)} if reverse else {"a": (1000, None), "b": (4, None), "c": (5, None)}
    assert cursors[0] == cursors[1] == sorted((c, *ends[c], *counts[c]) for c in counts)
    steps = spark.read.parquet(f"{one}/rows").filter("NOT final AND channel = 'a'")
    assert sorted(r["messages"] for r in steps.collect()) == [100, 200, 300]


def test_repeated_messages_are_known_for_a_while(spark, tmp_path, rocks):
    source, target = str(tmp_path / "in"), str(tmp_path / "rows")
    for rows in ([("a", 1), ("a", 2)], [("a", 2), ("a", 3), ("b", 1), ("b", 1)]):
        spark.createDataFrame(rows, "channel string, message_id long").coalesce(1).write.mode("append").parquet(source)
    query = start_progress(spark, source, target, str(tmp_path / "cp"), keep_ms=3_600_000)
    try:
        for _ in range(45):
            time.sleep(1)
            if sum(p["numInputRows"] for p in query.recentProgress) == 6:
                break
    finally:
        query.stop()
    assert sorted(tuple(r) for r in progress.latest_cursors(spark, target).collect()) == [("a", 3, None, 3, 1), ("b", 1, None, 1, 1)]
