"""The merged table: rows written, crashes, repeated batches, deletes, compaction; counters of a run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import ingest
from quillspark.streaming.merge_table import MergeTable

SCHEMA = "channel string, message_id long, block_no int, body string, broker string, analyst string, stock_name string, title_normalized string, title string, stock_code string, pdf_url string, opinion string, target_price long"


def parsed(spark, ids, opinion="'매수'", first=0):
    return ids.selectExpr("'@c' AS channel", f"id + {first} AS message_id", "0 AS block_no", "'b' AS body", "concat('broker', id % 7) AS broker", "if(id % 2 = 0, null, 'a') AS analyst", "concat('s', id) AS stock_name", "concat('t', id) AS title_normalized", "'T' AS title", "'000001' AS stock_code", "cast(null AS string) AS pdf_url", f"{opinion} AS opinion", "id AS target_price")


def test_rows_written_follow_the_batch(spark, tmp_path):
    path = str(tmp_path / "reports")
    assert ingest.upsert_batch(parsed(spark, spark.range(20_000)), path, 0) == 20_000
    later = parsed(spark, spark.range(19_900, 20_200), "if(id % 3 = 0, null, '매도')", 50_000)
    assert ingest.upsert_batch(later, path, 1) == 200 + sum(k % 3 != 0 for k in range(19_900, 20_000))
    segments = ingest.report_table(spark, path).state()["segments"]
    assert [s["rows"] for s in segments] == [20_000, 267] and spark.read.parquet(f"{path}/{segments[1]['path']}").count() == 267
    rows = {r["stock_name"]: r["opinion"] for r in ingest.stored_reports(spark, path).collect()}
    assert len(rows) == 20_200 and rows["s19901"] == "매도" and rows["s19902"] == "매수" and rows["s20001"] is None and rows["s20000"] == "매도"
    assert ingest.upsert_batch(later, path, 1) == 0 and ingest.stored_reports(spark, path).count() == 20_200  # the batch again


def test_crash_before_the_swap_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = MergeTable(spark, str(tmp_path / "t"), ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    assert table.read() is None and table.dead_share() == 0 and not table.compact() and table.vacuum() == []
    table.commit(0, rows(("a", 1), (None, 2), ("c", 3)))

    def crash(state):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_swap", crash)
        with pytest.raises(RuntimeError):
            table.commit(1, rows(("a", 9)))
        with pytest.raises(RuntimeError):
            table.compact(dead_share=0)
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), (None, 2), ("c", 3)}
    assert len(table.vacuum()) == 2  # what the two attempts left
    table.commit(1, rows(("a", 9), (None, 8), ("d", 4)), F.col("k").isNull())
    assert {tuple(r) for r in table.read().collect()} == {("a", 9), ("c", 3), ("d", 4)}
    assert table.commit(1, rows(("a", 0))) == 0 and table.commit(0, rows(("a", 0))) == 0
    table.commit(2, rows().limit(0))
    assert table.state()["number"] == 2 and len(table.state()["segments"]) == 2


def test_compaction_by_dead_rows(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), ["k"])
    for number in range(4):
        table.commit(number, spark.range(100).selectExpr("id AS k", f"{number} AS v"), F.col("k") == number)
    assert table.dead_share() == pytest.approx(1 - 99 / 400)
    before = {tuple(r) for r in table.read().collect()}
    assert not table.compact(dead_share=0.9) and table.compact(dead_share=0.5) and not table.compact(dead_share=0.5)
    assert {tuple(r) for r in table.read().collect()} == before and len(before) == 99
    assert [s["base"] for s in table.state()["segments"]] == [True] and table.dead_share() == 0
    assert table.vacuum() == []  # the state before is still there for its readers
    table.commit(4, spark.createDataFrame([(5, 50), (3, 30)], "k long, v int"))
    assert len(table.vacuum()) == 4
    assert {tuple(r) for r in table.read().collect()} == {r for r in before if r[0] != 5} | {(5, 50), (3, 30)}


def test_counters_equal_a_recount(spark, tmp_path):
    schema = "channel string, message_id long, text string, posted_at timestamp"
    good, poor = "LG(003550) title here 키움증권 목표가 90,000원 HOLD", "hm"
    batches = [[("@c", 1, good), ("@c", 1, good + " edited"), ("@c", 2, poor), ("@x", 3, good)], [("@c", 1, good), ("@c", 4, good), ("@c", 5, poor), ("@c", 6, poor)]]
    source, target, runs = (str(tmp_path / n) for n in ("in", "out", "runs"))
    active = lambda s: s.createDataFrame([("@c",)], "channel string")
    for rows in batches:
        df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("posted_at", F.when(F.col("text").endswith("edited"), F.lit("2024-01-03").cast("timestamp")).otherwise(F.lit("2024-01-02").cast("timestamp")))
        df.coalesce(1).write.mode("append").parquet(source)
        ingest.start_ingest(spark.readStream.schema(df.schema).parquet(source), target, str(tmp_path / "cp"), active, runs=runs).awaitTermination()
    counted = [tuple(r[c] for c in ingest.COUNTERS) for r in spark.read.parquet(runs).orderBy("number").collect()]
    assert counted == [(4, 2, 1, 1, 0), (4, 3, 1, 2, 0)]
    stored = spark.read.parquet(target)
    recount = {(r["batch"], r["branch"]): r["n"] for r in stored.groupBy("batch", "branch").agg(F.count("*").alias("n")).collect()}
    assert recount == {(0, "report"): 1, (0, "pending"): 1, (1, "report"): 1, (1, "pending"): 2}
    assert stored.filter("batch = 0 AND message_id = 1").first()["body"].endswith("edited")  # the version posted last
