"""Tasks grow in number with a table, so that what one of them holds doesn't."""

from __future__ import annotations

from collections import Counter

from quillspark.operators import page_selection
from quillspark.plans import ingest, research, upkeep, worklists
from quillspark.sources import tables as t

DATA = "/root/testdata/sf0.001"



def test_tasks_grow_with_the_table(spark):
    rows = spark.range(1000)
    assert t.dealt(rows, "id", of=rows, each=50).rdd.getNumPartitions() == 20
    assert t.dealt(rows, of=rows, each=10).rdd.getNumPartitions() == 100
    assert t.dealt(rows, "id", of=rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_derived_tables_follow(spark, monkeypatch):
    """Mentions, payloads, pages and messages are dealt over more tasks for more rows; a report's rows stay together."""
    monkeypatch.setattr(t.dealt, "__defaults__", None)
    monkeypatch.setattr(t.dealt, "__kwdefaults__", {"each": 500})
    monkeypatch.setattr(ingest, "MESSAGES_A_TASK", 100)
    lines, orders = t.table(spark, DATA, "lineitem").count(), t.table(spark, DATA, "orders").count()
    for rows in (t.stock_mentions(spark, DATA), t.sector_mentions(spark, DATA)):
        assert rows.rdd.getNumPartitions() == -(-lines // 500)
        assert max(Counter(rows.rdd.mapPartitionsWithIndex(lambda k, p: {(k, r["report_id"]) for r in p}).map(lambda x: x[1]).collect()).values()) == 1
    assert worklists.item_pages(spark, DATA).rdd.getNumPartitions() == -(-lines // 500)
    assert ingest.parsed_messages(spark, DATA).rdd.getNumPartitions() == -(-orders // 100)


def test_mentions_of_a_report_need_no_further_shuffle(spark):
    """Pages and payloads are dealt once: windows and groups by their report find them together."""
    pages = page_selection.selected_pages(worklists.item_pages(spark, DATA))
    assert pages._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "Expand" not in research.weighted_sentiment(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_symbol_match_its_trades_alone(spark):
    plan = upkeep.pairs_of_symbol(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = plan.count("FileScan parquet")
    assert scans == plan.count("EqualTo(l_partkey,17)") > 0


def test_outcomes_join_nothing_back(spark):
    plan = ingest.import_outcomes(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
