"""Counts and totals: trades, overview, language-model cost, channels, queues, chats.

One pass computes what can be told together: counts with different conditions are one aggregate, not one scan each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUALITIES = ("good", "partial", "poor", "unknown")


def where(df: DataFrame, conditions: dict[str, Column | None]) -> DataFrame:
    """All conditions whose value was given."""
    for condition in conditions.values():
        if condition is not None:
            df = df.filter(condition)
    return df


def trade_conditions(symbol=None, date_from=None, date_to=None, broker=None, side=None, account_type=None) -> dict[str, Column | None]:
    """``date_to`` is a moment: later times of its day are out."""

    def equal(name: str, value) -> Column | None:
        return None if value is None else F.col(name) == value

    return {
        "symbol": equal("symbol", symbol),
        "from": None if date_from is None else F.col("traded_at") >= F.lit(date_from).cast("timestamp"),
        "to": None if date_to is None else F.col("traded_at") <= F.lit(date_to).cast("timestamp"),
        "broker": equal("broker", broker),
        "side": equal("side", side),
        "account_type": equal("account_type", account_type),
    }


def trade_page(trades: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """A page of trades, newest first."""
    return where(trades, trade_conditions(**filters)).orderBy(F.col("traded_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def trade_stats(trades: DataFrame, **filters) -> DataFrame:
    """Totals under all filters; the counts by side leave the filter on the side out."""
    conditions = trade_conditions(**filters)
    side = conditions.pop("side")
    chosen = F.lit(True) if side is None else side
    return where(trades, conditions).agg(
        F.count_if(chosen).alias("total_count"),
        F.count_if(F.col("side") == "buy").alias("buy_count"),
        F.count_if(F.col("side") == "sell").alias("sell_count"),
        F.coalesce(F.sum(F.when(chosen, F.col("amount"))), F.lit(0)).cast("decimal(20,2)").alias("total_amount"),
        F.coalesce(F.sum(F.when(chosen, F.col("fees"))), F.lit(0)).cast("decimal(20,2)").alias("total_fees"),
    )


def symbol_frequency(trades: DataFrame, most: int = 20, **filters) -> DataFrame:
    counted = where(trades, trade_conditions(**filters)).groupBy("symbol").agg(F.count("*").alias("n_trades"), F.sum("amount").cast("decimal(20,2)").alias("amount"))
    return counted.orderBy(F.col("n_trades").desc(), "symbol").limit(most)


def chart_markers(trades: DataFrame, symbol, date_from=None, date_to=None) -> DataFrame:
    return where(trades, trade_conditions(symbol=symbol, date_from=date_from, date_to=date_to)).orderBy("traded_at", "id")


def top(df: DataFrame, key: str, most: int, name: str = "n") -> DataFrame:
    """The keys with the most rows; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), F.col(key).asc_nulls_last()).limit(most)


def overview(reports: DataFrame, as_of: str) -> DataFrame:
    """Counts of reports; pending is what no other state holds."""
    state = F.col("pipeline_status")
    counts = reports.agg(
        F.count("*").alias("total_reports"),
        F.count_if(F.col("report_date") == F.lit(as_of).cast("date")).alias("reports_today"),
        F.count("pdf_url").alias("reports_with_pdf"),
        F.count_if(state == "F").alias("analysis_done"),
        F.count_if(state == "P").alias("analysis_failed"),
        F.count_if(state == "T").alias("analysis_truncated"),
    )
    return counts.withColumn("analysis_pending", F.col("total_reports") - F.col("analysis_done") - F.col("analysis_failed") - F.col("analysis_truncated"))


def recent_top_brokers(reports: DataFrame, as_of: str, days: int = 30, most: int = 10) -> DataFrame:
    return top(reports.filter(F.col("report_date") >= F.date_sub(F.lit(as_of).cast("date"), days)), "broker", most)


def status_histogram(rows: DataFrame, column: str = "pipeline_status") -> DataFrame:
    return rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))


def cost_by(usage: DataFrame, keys: list[Column | str], since: str | None = None) -> DataFrame:
    """Calls, tokens and cost by any keys, from a day on. The cast in the filter is undone by the optimiser and pushed."""
    rows = usage if since is None else usage.filter(F.to_date("called_at") >= F.lit(since).cast("date"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").cast("decimal(20,2)").alias("cost")
    )


def channel_runs(runs: DataFrame) -> DataFrame:
    """All totals of a channel's runs in one pass."""
    return runs.groupBy("channel").agg(
        F.max(F.to_date("called_at")).alias("last_run_date"),
        F.max("called_at").alias("last_finished_at"),
        F.max("message_id").alias("latest_message_id"),
        F.min("message_id").alias("earliest_from_id"),
        F.count("*").alias("total_runs"),
        F.sum("input_tokens").alias("total_scanned"),
        F.sum("output_tokens").alias("total_saved"),
    )


def with_active_channels(channels: DataFrame, runs: DataFrame) -> DataFrame:
    """Every active channel, with zero totals where it never ran."""
    joined = channels.filter("is_active").select("channel").join(channel_runs(runs), "channel", "left")
    return joined.na.fill(0, ["total_runs", "total_scanned", "total_saved"])


def quality_pivot(rows: DataFrame) -> DataFrame:
    """Rows of a channel by parse quality, unnamed ones as unknown; the columns are fixed."""
    named = rows.withColumn("q", F.coalesce("parse_quality", F.lit("unknown")))
    return named.groupBy("channel").pivot("q", list(QUALITIES)).count().na.fill(0)


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a channel and how many hold each column."""
    return rows.groupBy("channel").agg(F.count("*").alias("total"), *[F.count(c).alias(f"has_{c}") for c in columns])


def failure_alert(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of failed among those with an address, and whether it reaches the threshold."""
    ratio = F.col("n_failed") / F.nullif(F.col("n_with_url"), F.lit(0))
    counted = rows.groupBy("channel").agg(F.count_if("has_url").alias("n_with_url"), F.count_if(F.col("has_url") & F.col("failed")).alias("n_failed"))
    return counted.withColumn("ratio", F.round(ratio, 4)).withColumn("alert", F.coalesce(ratio >= threshold, F.lit(False)))


def pending_page(pending: DataFrame, status: str | None = "pending", channel: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Waiting messages, newest first, each with the number of all that match."""
    rows = where(pending, {"status": None if status is None else F.col("review_status") == status, "channel": None if channel is None else F.col("channel") == channel})
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.col("called_at").desc(), F.col("id").desc()).offset(offset).limit(limit)
    return page.join(F.broadcast(total))  # one row


def session_list(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Every session with its number of messages, also those without any."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    return sessions.join(counts, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n_messages"))


def last_messages(messages: DataFrame, most: int = 20) -> DataFrame:
    """The last messages of each session, in order of time."""
    newest = W.partitionBy("session_id").orderBy(F.col("turn").desc())
    return messages.withColumn("from_end", F.row_number().over(newest)).filter(F.col("from_end") <= most)


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Per cent of the sum over all rows, joined as a single row rather than through one window."""
    total = df.agg(F.sum(value).alias("all_of_it"))
    return df.join(F.broadcast(total)).withColumn(name, F.round(F.col(value) / F.nullif(F.col("all_of_it"), F.lit(0)) * 100, 2)).drop("all_of_it")


def weighted_mean(value: str, weight: str) -> Column:
    known = F.col(value).isNotNull()
    return F.sum(F.when(known, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(known, F.col(weight))), F.lit(0))


def completion(done: Column, total: Column) -> Column:
    """Whole per cent done; nothing to do is all done."""
    return F.when(total == 0, F.lit(100)).otherwise(F.round(done / total * 100).cast("int"))
