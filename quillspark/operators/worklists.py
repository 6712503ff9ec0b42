"""Work queues over reports and trades: what to parse, fetch or retry next, and the small updates behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as t

# Longest column values that metadata may set.
LONGEST = {"broker": 50, "stock_name": 100, "analyst": 100, "opinion": 20, "sector": 100, "report_type": 50, "prev_opinion": 20, "stock_code": None}


def reparse_targets(reports: DataFrame) -> DataFrame:
    """Reports of unknown houses or without normalised title."""
    return reports.filter((F.col("broker") == "Unknown") | F.col("title_normalized").isNull())


def download_queue(reports: DataFrame, statuses: list[str], channel: str | None = None, most: int | None = None) -> DataFrame:
    """Reports in one of the states without stored file, by id."""
    waiting = reports.filter(F.col("pipeline_status").isin(*statuses) & F.col("pdf_path").isNull())
    if channel is not None:
        waiting = waiting.filter(F.col("source_channel") == channel)
    ordered = waiting.orderBy("id")
    return ordered if most is None else ordered.limit(most)


def retry_queue(reports: DataFrame, retryable_only: bool = True, channel: str | None = None) -> DataFrame:
    failed = reports.filter(F.col("pipeline_status") == "pdf_failed")
    if retryable_only:
        failed = failed.filter(F.col("pdf_fail_retryable"))
    return failed if channel is None else failed.filter(F.col("source_channel") == channel)


def suspect_dates(reports: DataFrame, analyses: DataFrame, first: str, last: str, scan_all: bool = False) -> DataFrame:
    """Analysed reports with a file whose date lies in a suspect range, or all of them."""
    rows = reports.filter(F.col("pdf_path").isNotNull()).join(analyses.select(F.col("report_id").alias("id")).distinct(), "id", "left_semi")
    return rows if scan_all else rows.filter(F.col("report_date").between(first, last))


def reset_failures(reports: DataFrame, channel: str | None = None) -> DataFrame:
    """The reports with failed downloads that have a URL set back, and which rows that changed (``reset``)."""
    hit = F.col("pdf_download_failed") & F.col("pdf_url").isNotNull()
    if channel is not None:
        hit = hit & (F.col("source_channel") == channel)
    marked = reports.withColumn("reset", F.coalesce(hit, F.lit(False)))
    return marked.withColumn("pdf_download_failed", F.when(F.col("reset"), False).otherwise(F.col("pdf_download_failed")))


def quota_split(rows: DataFrame, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """The first rows in ``order``, dealt to the named quotas in turn. Only as many rows as the quotas sum to are ranked."""
    first = rows.orderBy(*order).limit(sum(quotas.values()))
    placed = first.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    name, start = F.lit(None).cast("string"), 0
    for quota, size in quotas.items():
        name = F.when(F.col("place").between(start + 1, start + size), quota).otherwise(name)
        start += size
    return placed.withColumn("quota", name).drop("place")


def seeded_sample(rows: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows in an order hashed from seed and keys: reruns agree whatever the partitions."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def daily_cap(rows: DataFrame, per_day: int, done_today: int, order: list[str]) -> DataFrame:
    """The first rows in ``order`` that a day's quota still allows."""
    return rows.orderBy(*order).limit(max(0, per_day - done_today))


def opinion_timeline(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("opinion").isNotNull()).orderBy("report_date", "id")


def pairs_of_symbol(pairs: DataFrame, trades: DataFrame, symbol) -> DataFrame:
    """Matched pairs with a trade of the symbol on either side, each once."""
    ids = trades.filter(F.col("symbol") == symbol).select("id", "side")
    bought = pairs.join(ids.filter("side = 'buy'").select(F.col("id").alias("buy_trade_id")), "buy_trade_id", "left_semi")
    sold = pairs.join(ids.filter("side = 'sell'").select(F.col("id").alias("sell_trade_id")), "sell_trade_id", "left_semi")
    return bought.unionByName(sold).distinct()


def symbol_totals(trades: DataFrame) -> DataFrame:
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("amount"))), F.lit(0)).alias(f"{s}_amount")
    return trades.groupBy("symbol").agg(side("buy"), side("sell"))


def run_counters(actions: DataFrame, run: str = "run_id") -> DataFrame:
    """Messages scanned, saved, pending and skipped in each run, and the last message met."""
    counts = [F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("saved", "pending", "skipped")]
    return actions.groupBy(run).agg(F.count("*").alias("n_scanned"), *counts, F.max("message_id").alias("to_message_id"))


def with_metadata(reports: DataFrame, told: DataFrame, key: str = "id") -> DataFrame:
    """Reports with the values that extracted metadata gives, normalised and cut; blank ones leave the old value."""
    normal = {"broker": t.normalize_broker, "opinion": t.normalize_opinion, "prev_opinion": t.normalize_opinion}

    def new(name: str) -> Column:
        value = F.nullif(F.col(f"told.{name}"), F.lit(""))
        value = normal[name](value) if name in normal else value
        return value if LONGEST[name] is None else F.substring(value, 1, LONGEST[name])

    names = [c for c in told.columns if c in LONGEST and c in reports.columns]
    prices = [c for c in ("target_price", "prev_target_price") if c in told.columns and c in reports.columns]
    # of several rows of metadata with one key the greatest one counts, column by column from the left
    first = told.groupBy(key).agg(F.max(F.struct(*[c for c in told.columns if c != key])).alias("m")).select(key, "m.*")
    joined = reports.alias("old").join(first.alias("told"), F.col(f"old.{key}") == F.col(f"told.{key}"), "left")
    priced = {c: F.when(F.col(f"told.{c}") > 0, F.col(f"told.{c}")) if dict(told.dtypes)[c] != "string" else F.nullif(t.parse_price(F.col(f"told.{c}")), F.lit(0)) for c in prices}
    return joined.select(*[F.coalesce(new(c), F.col(f"old.{c}")).alias(c) if c in names else F.coalesce(priced[c], F.col(f"old.{c}")).alias(c) if c in prices else F.col(f"old.{c}").alias(c) for c in reports.columns])
