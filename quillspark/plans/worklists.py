"""Queries on page selection and work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import page_selection as p
from quillspark.operators import worklists as w
from quillspark.plans.research import ALL_SQL
from quillspark.sources import tables as t

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def item_pages(spark: SparkSession, d: str) -> DataFrame:
    """The items of an order as the pages of a document."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = t.table(spark, d, "lineitem")
    return t.dealt(lines, "l_orderkey", of=lines).select(
        F.col("l_orderkey").alias("doc_id"),
        (F.row_number().over(order) - 1).alias("page_idx"),
        (F.col("l_discount") * 5).alias("text_coverage"),
        (F.col("l_quantity") + 10).cast("int").alias("vector_count"),
        (F.col("l_tax") * 10).alias("largest_image_ratio"),
        (F.col("l_returnflag") == "R").alias("has_keyword"),
        ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25)).alias("section_header_keyword"),
    )


PAGES_SQL = """WITH pages_of AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS page_idx, l_discount * 5 AS text_coverage,
  (l_quantity + 10)::INT AS vector_count, l_tax * 10 AS largest_image_ratio, l_returnflag = 'R' AS has_keyword, l_linestatus = 'F' AND l_quantity > 25 AS header FROM lineitem),
near AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, coalesce(lag(has_keyword OR header) OVER o, false) OR coalesce(lead(has_keyword OR header) OVER o, false) AS near FROM pages_of WINDOW o AS (PARTITION BY doc_id ORDER BY page_idx)),
scored AS (SELECT *, CASE WHEN total > 3 AND (page_idx < 1 OR page_idx >= total - 1) THEN 0 ELSE 3 * has_keyword::INT + 2 * header::INT + 2 * (vector_count >= 50)::INT + 2 * (largest_image_ratio >= 0.5)::INT + near::INT END AS score FROM near)
SELECT doc_id, page_idx::INT AS page_idx, score::INT AS score, CASE WHEN text_coverage <= 0.3 OR largest_image_ratio >= 0.5 THEN 'page_render' ELSE 'embedded' END AS source
FROM scored WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) <= 15"""


@query(PAGES_SQL)
def selected_pages(spark: SparkSession, d: str) -> DataFrame:
    return p.selected_pages(item_pages(spark, d)).select("doc_id", "page_idx", "score", "source")


@query("""SELECT user_id, count(*) AS image_count, count(*) FILTER (props <> '') AS success_count, sum(event_id)::BIGINT AS input_tokens, sum(event_id * 2)::BIGINT AS output_tokens, sum(length(props))::BIGINT AS total_chars,
  sum(length(regexp_replace(props, '[^0-9]', '', 'g')))::BIGINT AS digit_chars, 0::BIGINT AS table_rows FROM events GROUP BY 1""")
def digitized_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select("user_id", F.col("props").alias("text"), F.col("event_id").alias("input_tokens"), (F.col("event_id") * 2).alias("output_tokens"))
    return p.digitized_totals(rows, "user_id")


@query(f"""{ALL_SQL} SELECT id, CASE WHEN row_number() OVER (ORDER BY report_date DESC, id) <= 30 THEN 'first' ELSE 'second' END AS quota FROM reports ORDER BY report_date DESC, id LIMIT 50""")
def quota_split(spark: SparkSession, d: str) -> DataFrame:
    rows = t.reports(spark, d).withColumn("age", F.datediff(F.lit("2100-01-01").cast("date"), "report_date"))
    return w.quota_split(rows, ["age", "id"], {"first": 30, "second": 20}).select("id", "quota")


@query(f"""{ALL_SQL} SELECT id, report_date, opinion FROM reports WHERE opinion IS NOT NULL""")
def opinion_timeline(spark: SparkSession, d: str) -> DataFrame:
    return w.opinion_timeline(t.reports(spark, d)).select("id", "report_date", "opinion")


@query(f"""{ALL_SQL} SELECT id FROM reports WHERE pipeline_status IN ('O', 'P') AND pdf_url IS NULL""")
def download_queue(spark: SparkSession, d: str) -> DataFrame:
    return w.download_queue(t.reports(spark, d).withColumn("pdf_path", F.col("pdf_url")), ["O", "P"]).select("id")


@query(f"""{ALL_SQL} SELECT id FROM reports WHERE target_price IS NULL OR opinion IS NULL""")
def reparse_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = t.reports(spark, d).select("id", F.when(F.col("target_price").isNull(), "Unknown").otherwise("house").alias("broker"), F.col("opinion").alias("title_normalized"))
    return w.reparse_targets(rows).select("id")


@query(f"""{ALL_SQL} SELECT pipeline_status, count(*) FILTER (opinion IS NULL AND pdf_url IS NOT NULL) AS n_reset, count(*) FILTER (opinion IS NULL AND pdf_url IS NULL) AS n_failed FROM reports GROUP BY 1""")
def reset_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = w.reset_failures(t.reports(spark, d).withColumn("pdf_download_failed", F.col("opinion").isNull()))
    return rows.groupBy("pipeline_status").agg(F.count_if("reset").alias("n_reset"), F.count_if("pdf_download_failed").alias("n_failed"))


@query("""SELECT l_partkey AS symbol, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice::DECIMAL(14, 2) END), 0)::DOUBLE AS buy_amount,
  coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(14, 2) END), 0)::DOUBLE AS sell_amount FROM lineitem GROUP BY 1""")
def symbol_totals(spark: SparkSession, d: str) -> DataFrame:
    return w.symbol_totals(t.trades(spark, d)).select("symbol", F.col("buy_amount").cast("double"), F.col("sell_amount").cast("double"))


@query("""SELECT user_id, count(*) AS n_scanned, count(*) FILTER (event_type = 'purchase') AS n_saved, count(*) FILTER (event_type = 'click') AS n_pending,
  count(*) FILTER (event_type NOT IN ('purchase', 'click')) AS n_skipped, max(event_id) AS to_message_id FROM events GROUP BY 1""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "saved").when(F.col("event_type") == "click", "pending").otherwise("skipped")
    return w.run_counters(t.table(spark, d, "events").select("user_id", kind.alias("action"), F.col("event_id").alias("message_id")), "user_id")


@query(f"""{ALL_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN '매도' ELSE opinion END AS opinion, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 85000 ELSE target_price END AS target_price FROM reports""")
def with_metadata(spark: SparkSession, d: str) -> DataFrame:
    reports = t.reports(spark, d)
    told = reports.select("id", F.when(F.col("id") % 2 == 0, "매도").otherwise("").alias("opinion"), F.when((F.col("id") % 2 == 0) & (F.col("id") % 3 != 0), "8.5만").otherwise("").alias("target_price"))
    return w.with_metadata(reports, told).select("id", "opinion", "target_price")
