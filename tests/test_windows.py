"""Closing windows: kept and late rows are all rows, days are told once, state falls behind the watermark."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from quillspark.streaming import ingest, windows

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_late_rows_are_kept_apart_and_state_falls(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [
        [(k, start + timedelta(hours=k), k % 3, "view", 1.0) for k in range(72)],
        [(100 + k, start + timedelta(hours=72 + k), k % 3, "view", 1.0) for k in range(24)] + [(200, start, 1, "view", 1.0), (201, start + timedelta(hours=40), 1, "late", 1.0), (202, start + timedelta(hours=60), 1, "view", 1.0)],
        [(300, None, 1, "view", 1.0), (301, start + timedelta(hours=90), 1, None, 1.0)],
    ]
    source, folder = str(tmp_path / "in"), str(tmp_path / "gate")
    told, states = [], []
    stream = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).parquet(source)
        windows.gate(events, folder).awaitTermination()
        if k == len(batches) - 1:
            windows.end_replay(spark, folder)
        target = str(tmp_path / "days")
        stream = windows.closed_days(windows.in_time(spark, folder)).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination()
        told.append(spark.read.parquet(target).count())
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress if p["stateOperators"]][-1])
        assert sum(o["numRowsDroppedByWatermark"] for p in stream.recentProgress for o in p["stateOperators"]) == 0  # the gate told them before
    late = sorted(r["event_id"] for r in windows.late_rows(spark, folder).collect())
    assert late == [200, 201]
    kept = Counter((r[1].date(), r[3]) for rows in batches for r in rows if r[0] not in late and r[1] is not None)
    days = {(r["day"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert days == dict(kept) and told[0] < told[-1] and states[-1] <= 2 < max(kept.values())
    everything = spark.read.parquet(f"{folder}/rows").filter("NOT _end").count()
    assert everything == sum(map(len, batches)) == len(late) + sum(kept.values()) + 1  # one row has no time, and is in no window


def test_a_gate_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    windows.gate(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "gate")).awaitTermination()
    windows.end_replay(spark, str(tmp_path / "gate"))
    assert ingest.exists(spark, str(tmp_path / "gate"))
