"""Parquet tables of a directory, and the library's relations derived from the driver's tables.

Every derivation comes with the SQL that makes the same relation, so that queries can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.money import unit_price


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores dealt over all cores, for work on each row that costs more than moving it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of a table that one task takes after ``dealt``.
ROWS_A_TASK = 250_000


def dealt(rows: DataFrame, *keys: str, of: DataFrame, each: int = ROWS_A_TASK) -> DataFrame:
    """Rows dealt by ``keys``, or evenly without any, over tasks for ``each`` rows of the table ``of``, and over all cores at least.

    The number of tasks grows with the table, so that what one of them holds doesn't. Steps by the same keys that follow
    need no further shuffle. Counting a Parquet table reads its footers alone.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-of.count() // each))
    return rows.repartition(tasks, *keys)


def trades(spark: SparkSession, directory: str) -> DataFrame:
    """Line items as trades: returned ones are sales, the part is the symbol."""
    rows = table(spark, directory, "lineitem")
    amount = F.col("l_extendedprice").cast("decimal(14,2)")
    return rows.select(
        (F.col("l_orderkey") * 10_000_000_000 + F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("id"),
        F.col("l_partkey").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_shipdate").cast("timestamp").alias("traded_at"),
        unit_price(amount, F.col("l_quantity").cast("int")).alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
        amount.alias("amount"),
        F.round(amount * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(14,2)").alias("fees"),
        F.col("l_suppkey").alias("broker"),
        F.col("l_linestatus").alias("account_type"),
    )


#: Amounts in cents (c_...), so that every rounding is a whole-number one.
TRADES_SQL = """
trades_raw AS (
  SELECT l_orderkey * 10000000000 + l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS id, l_partkey AS symbol,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_shipdate AS traded_at, l_quantity::INTEGER AS quantity,
         (round(l_extendedprice * 100))::BIGINT AS c_amount, (round(l_tax * 100))::BIGINT AS tax, l_suppkey AS broker, l_linestatus AS account_type
  FROM lineitem),
trades AS (
  SELECT *, c_amount // quantity + CASE WHEN 2 * (c_amount % quantity) > quantity OR (2 * (c_amount % quantity) = quantity AND (c_amount // quantity) % 2 = 1) THEN 1 ELSE 0 END AS c_price,
         (c_amount * tax + 50) // 100 AS c_fees
  FROM trades_raw)"""


def bars(spark: SparkSession, directory: str, symbol: str = "l_suppkey") -> DataFrame:
    """Daily bars of the suppliers, or of another column, from the prices of their line items."""
    rows = table(spark, directory, "lineitem").select(
        F.col(symbol).alias("symbol"),
        F.to_date("l_shipdate").alias("day"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("at"),
        F.round("l_extendedprice", 2).alias("price"),
        F.col("l_quantity").alias("quantity"),
    )
    return rows.groupBy("symbol", "day").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("quantity").alias("volume")
    )


def bars_between(bars: DataFrame, symbol, first: str, last: str) -> DataFrame:
    """The bars of one symbol from one day to another, in order."""
    return bars.filter((F.col("symbol") == symbol) & F.col("day").between(first, last)).orderBy("day")


BARS_SQL = """
bars AS (
  SELECT l_suppkey AS symbol, l_shipdate::DATE AS day,
         arg_min(round(l_extendedprice, 2), (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open, max(round(l_extendedprice, 2)) AS high,
         min(round(l_extendedprice, 2)) AS low, arg_max(round(l_extendedprice, 2), (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def reports(spark: SparkSession, directory: str) -> DataFrame:
    """Orders as research reports of the customer's house; the first item's part is the stock of a report."""
    rows = table(spark, directory, "orders")
    rating = F.element_at(F.array(*[F.lit(x) for x in ("매수", "중립", "매도")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("report_date"),
        F.col("o_custkey").alias("broker"),
        F.col("o_orderpriority").alias("report_type"),
        F.col("o_orderstatus").alias("pipeline_status"),
        F.concat(F.lit("Report "), F.col("o_orderpriority"), F.lit(" no. "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderkey") % 7 != 0, rating).alias("opinion"),
        F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice")).cast("bigint")).alias("target_price"),
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).alias("pdf_url"),
    )


REPORTS_SQL = """
reports AS (
  SELECT o_orderkey AS id, o_orderdate::DATE AS report_date, o_custkey AS broker, o_orderpriority AS report_type, o_orderstatus AS pipeline_status,
         'Report ' || o_orderpriority || ' no. ' || o_orderkey AS title, CASE WHEN o_orderkey % 7 <> 0 THEN ['매수', '중립', '매도'][(o_orderkey % 3 + 1)::INT] END AS opinion,
         CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice)::BIGINT END AS target_price, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://x.example/' || o_orderkey || '.pdf' END AS pdf_url
  FROM orders)"""


def analyses(spark: SparkSession, directory: str) -> DataFrame:
    """(report_id, document): a JSON analysis of every report whose status says so; the sentiment follows from its price."""
    rows = reports(spark, directory).filter("pipeline_status = 'F'")
    sentiment = (F.pmod(F.coalesce("target_price", F.col("id")), F.lit(201)) - 100).cast("string")
    document = F.concat(F.lit('{"thesis": {"summary": "s'), F.col("id").cast("string"), F.lit('", "sentiment": '), sentiment, F.lit('}, "meta": {"title": "'), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Told "), F.col("id").cast("string"))).otherwise(F.lit("  ")), F.lit('"}}'))
    return rows.select(F.col("id").alias("report_id"), document.alias("document"))


ANALYSES_SQL = """
analyses AS (
  SELECT id AS report_id, (coalesce(target_price, id) % 201 - 100)::BIGINT AS sentiment, CASE WHEN id % 2 = 0 THEN 'Told ' || id END AS told_title FROM reports WHERE pipeline_status = 'F')"""


def stock_mentions(spark: SparkSession, directory: str) -> DataFrame:
    """(report_id, stock_code, company_name, relevance): each part of an order once."""
    lines, parts = table(spark, directory, "lineitem"), table(spark, directory, "part")
    items = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("report_id"), "l_partkey", "p_name")
    code = F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit("_"), F.col("p_name"))).otherwise(F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    return dealt(items, "report_id", of=lines).distinct().select("report_id", code.alias("stock_code"), F.col("p_name").alias("company_name"), (F.col("l_partkey") % 11 / 10.0).alias("relevance"))


STOCK_MENTIONS_SQL = """
stock_mentions AS (
  SELECT DISTINCT l_orderkey AS report_id, CASE WHEN l_partkey % 10 = 0 THEN '_' || p_name ELSE lpad(l_partkey::VARCHAR, 6, '0') END AS stock_code, p_name AS company_name, l_partkey % 11 / 10.0 AS relevance, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sector_mentions(spark: SparkSession, directory: str) -> DataFrame:
    """(report_id, sector, mention_type): the types of an order's parts, by their brand's parity."""
    lines, parts = table(spark, directory, "lineitem"), table(spark, directory, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "primary").otherwise("related")
    items = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("report_id"), F.col("p_type").alias("sector"), kind.alias("mention_type"))
    return dealt(items, "report_id", of=lines).distinct()


SECTOR_MENTIONS_SQL = """
sector_mentions AS (
  SELECT DISTINCT l_orderkey AS report_id, p_type AS sector, CASE WHEN p_size % 2 = 0 THEN 'primary' ELSE 'related' END AS mention_type
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def usage(spark: SparkSession, directory: str) -> DataFrame:
    """Events as language-model calls and channel messages."""
    rows = table(spark, directory, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return rows.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("called_at"),
        F.concat(F.lit("@c"), (F.col("user_id") % 12).cast("string")).alias("channel"),
        F.col("event_type").alias("purpose"),
        F.element_at(F.array(*[F.lit(m) for m in ("small", "medium", "large")]), (F.col("user_id") % 3 + 1).cast("int")).alias("model"),
        F.col("value").cast("decimal(12,2)").alias("cost"),
        (k * 10).alias("input_tokens"),
        k.alias("output_tokens"),
        F.when(k % 4 != 0, F.element_at(F.array(F.lit("good"), F.lit("partial"), F.lit("poor")), (k % 3 + 1).cast("int"))).alias("parse_quality"),
        F.col("event_id").alias("message_id"),
    )


USAGE_SQL = """
usage AS (
  SELECT event_id AS id, ts AS called_at, '@c' || (user_id % 12) AS channel, event_type AS purpose, ['small', 'medium', 'large'][(user_id % 3 + 1)::INT] AS model,
         value::DECIMAL(12,2) AS cost, k * 10 AS input_tokens, k AS output_tokens, CASE WHEN k % 4 <> 0 THEN ['good', 'partial', 'poor'][(k % 3 + 1)::INT] END AS parse_quality, event_id AS message_id
  FROM (SELECT *, (props::JSON ->> '$.k')::INT AS k FROM events))"""


def event_bars(spark: SparkSession, directory: str) -> DataFrame:
    """Daily bars of the users from the values of their events."""
    rows = table(spark, directory, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("at"), "value")
    return rows.groupBy("symbol", "day").agg(
        F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count("*").cast("double").alias("volume")
    )
