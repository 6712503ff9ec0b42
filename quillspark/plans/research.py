"""Queries on reports, mentions, usage and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import dashboards as dash
from quillspark.operators import reports as r
from quillspark.sources import tables as t

QUERIES, ORACLE_SQL = {}, {}
#: The day that stands for today.
AS_OF = "1998-06-01"
ALL_SQL = f"WITH {t.REPORTS_SQL}, {t.ANALYSES_SQL}, {t.STOCK_MENTIONS_SQL}, {t.SECTOR_MENTIONS_SQL}"


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


@query(f"""{ALL_SQL}, page AS (SELECT * FROM reports WHERE title ILIKE '%urgent%' AND opinion = '매수' AND report_date >= DATE '1996-01-01' ORDER BY report_date DESC, id DESC LIMIT 20 OFFSET 5)
SELECT id, report_date, broker, opinion, coalesce(told_title, title) AS title, pdf_url IS NOT NULL AS has_pdf, a.report_id IS NOT NULL AS has_ai, sentiment::DOUBLE AS sentiment
FROM page LEFT JOIN analyses a ON a.report_id = id""")
def report_search(spark: SparkSession, d: str) -> DataFrame:
    return r.search(t.reports(spark, d), t.analyses(spark, d), q="urgent", opinion="매수", date_from="1996-01-01", offset=5)


@query(f"""{ALL_SQL} SELECT id, report_date, broker, opinion, title, pdf_url IS NOT NULL AS has_pdf, false AS has_ai, NULL::DOUBLE AS sentiment
FROM reports WHERE id NOT IN (SELECT report_id FROM analyses) AND report_type = '2-HIGH' ORDER BY report_date DESC, id DESC LIMIT 30""")
def report_search_without_ai(spark: SparkSession, d: str) -> DataFrame:
    return r.search(t.reports(spark, d), t.analyses(spark, d), report_type="2-HIGH", has_analysis=False, limit=30)


@query(f"""{ALL_SQL} SELECT DISTINCT f.filter, f.value FROM (
  SELECT 'opinion' AS filter, opinion AS value FROM reports UNION ALL SELECT 'report_type', report_type FROM reports UNION ALL SELECT 'pipeline_status', pipeline_status FROM reports) f WHERE value IS NOT NULL""")
def filter_options(spark: SparkSession, d: str) -> DataFrame:
    return r.filter_options(t.reports(spark, d), ["opinion", "report_type", "pipeline_status"])


@query(f"""{ALL_SQL} SELECT report_id, len(stocks) AS n_stocks, len(sectors) AS n_sectors, stocks[1] AS first_stock FROM (
  SELECT id AS report_id, (SELECT list(stock_code ORDER BY stock_code, company_name) FROM stock_mentions m WHERE m.report_id = id) AS stocks,
         (SELECT list(sector ORDER BY sector) FROM sector_mentions m WHERE m.report_id = id) AS sectors
  FROM reports WHERE id IN (3, 7, 12, 99, 500))""")
def report_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = r.report_detail(t.reports(spark, d), t.analyses(spark, d), t.stock_mentions(spark, d), t.sector_mentions(spark, d), [3, 7, 12, 99, 500])
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint")
    return rows.select("report_id", n("stocks").alias("n_stocks"), n("sectors").alias("n_sectors"), F.col("stocks")[0]["stock_code"].alias("first_stock"))


STOCK_LIST_SQL = """, told AS (
  SELECT m.stock_code, m.report_id, m.company_name, report_date, sentiment FROM stock_mentions m JOIN reports ON id = m.report_id LEFT JOIN analyses a ON a.report_id = m.report_id
  WHERE regexp_full_match(stock_code, '[0-9]{6}'))"""


@query(f"""{ALL_SQL}{STOCK_LIST_SQL} SELECT stock_code, count(DISTINCT report_id) AS report_count, max(report_date) AS latest_report_date, round(avg(sentiment), 6) AS avg_sentiment, arg_max(company_name, (report_date, report_id)) AS stock_name
FROM told GROUP BY 1 ORDER BY report_count DESC, latest_report_date DESC, stock_code LIMIT 50 OFFSET 10""")
def stock_list(spark: SparkSession, d: str) -> DataFrame:
    rows = r.stock_list(t.reports(spark, d), t.analyses(spark, d), t.stock_mentions(spark, d), offset=10)
    return rows.withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query(f"""{ALL_SQL}{STOCK_LIST_SQL} SELECT stock_code, count(DISTINCT report_id) AS report_count, max(report_date) AS latest_report_date, round(avg(sentiment), 6) AS avg_sentiment, arg_max(company_name, (report_date, report_id)) AS stock_name
FROM told WHERE stock_code IN (SELECT stock_code FROM told WHERE company_name ILIKE '%ring%' OR stock_code LIKE '%ring%') GROUP BY 1 ORDER BY latest_report_date DESC, report_count DESC, stock_code LIMIT 20""")
def stock_list_search(spark: SparkSession, d: str) -> DataFrame:
    rows = r.stock_list(t.reports(spark, d), t.analyses(spark, d), t.stock_mentions(spark, d), text="ring", sort="latest_date", limit=20)
    return rows.withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query(f"""{ALL_SQL} SELECT id, report_date, broker, opinion, target_price, coalesce(told_title, title) AS title, sentiment::DOUBLE AS sentiment
FROM reports LEFT JOIN analyses a ON a.report_id = id WHERE id IN (SELECT report_id FROM stock_mentions WHERE stock_code = '000017')""")
def stock_history(spark: SparkSession, d: str) -> DataFrame:
    return r.stock_history(t.reports(spark, d), t.analyses(spark, d), t.stock_mentions(spark, d), "000017")


@query(f"""{ALL_SQL}, grouped AS (
  SELECT sector, count(DISTINCT m.report_id) AS report_count, round(avg(sentiment), 6) AS avg_sentiment FROM sector_mentions m JOIN reports ON id = m.report_id LEFT JOIN analyses a ON a.report_id = m.report_id WHERE sector <> '' GROUP BY 1),
counted AS (
  SELECT sector, stock_code, company_name, count(DISTINCT s.report_id) AS n FROM sector_mentions s JOIN stock_mentions m ON s.report_id = m.report_id WHERE regexp_full_match(stock_code, '[0-9]{{6}}') GROUP BY 1, 2, 3),
best AS (SELECT sector, stock_code, max(n) AS n FROM counted GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY n DESC, stock_code) AS rank FROM best),
tops AS (SELECT sector, string_agg(stock_code || ':' || n, ',' ORDER BY rank) AS top_stocks FROM ranked WHERE rank <= 5 GROUP BY 1)
SELECT sector, report_count, avg_sentiment, top_stocks FROM grouped LEFT JOIN tops USING (sector)""")
def sector_list(spark: SparkSession, d: str) -> DataFrame:
    rows = r.sector_list(t.reports(spark, d), t.analyses(spark, d), t.sector_mentions(spark, d), t.stock_mentions(spark, d))
    told = F.array_join(F.transform("top_stocks", lambda s: F.concat(s["stock_code"], F.lit(":"), s["n"].cast("string"))), ",")
    return rows.select("sector", "report_count", F.round("avg_sentiment", 6).alias("avg_sentiment"), told.alias("top_stocks"))


@query(f"""{ALL_SQL}, told AS (
  SELECT m.stock_code, m.company_name, m.report_id, report_date, opinion, target_price, sentiment FROM stock_mentions m JOIN reports ON id = m.report_id LEFT JOIN analyses a ON a.report_id = m.report_id
  WHERE regexp_full_match(stock_code, '[0-9]{{6}}') AND m.report_id IN (SELECT report_id FROM sector_mentions WHERE sector = 'ECONOMY')),
named AS (SELECT stock_code, company_name, count(DISTINCT report_id) AS report_count, avg(sentiment) AS s FROM told GROUP BY 1, 2),
first_name AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY report_count DESC, company_name) = 1),
newest AS (SELECT stock_code, arg_max({{'o': opinion, 'p': target_price}}, (report_date, report_id)) AS x FROM told GROUP BY 1)
SELECT stock_code, company_name AS stock_name, report_count, round(s, 6) AS avg_sentiment, x.o AS latest_opinion, x.p AS latest_target_price FROM first_name JOIN newest USING (stock_code)""")
def sector_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = r.sector_detail(t.reports(spark, d), t.analyses(spark, d), t.sector_mentions(spark, d), t.stock_mentions(spark, d), "ECONOMY")
    return rows.withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query(f"""{ALL_SQL} SELECT id, broker FROM reports WHERE id NOT IN (SELECT report_id FROM analyses) AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def resume_exclusion(spark: SparkSession, d: str) -> DataFrame:
    reports = t.reports(spark, d)
    return r.without_analysis(reports, t.analyses(spark, d), reports.filter("pipeline_status = 'P'")).select("id", "broker")


@query(f"{ALL_SQL} SELECT id, broker, report_type, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY broker, report_type ORDER BY id DESC) AS n FROM reports) WHERE n <= 2")
def diverse_sample(spark: SparkSession, d: str) -> DataFrame:
    return r.diverse_sample(t.reports(spark, d)).select("id", "broker", "report_type", F.col("n").cast("bigint").alias("n"))


@query(f"""{ALL_SQL}, newest AS (SELECT report_date, broker, arg_max_null(target_price, id) AS p FROM reports WHERE broker IN (1, 2, 3, 4) GROUP BY 1, 2)
SELECT report_date, max(p) FILTER (broker = 1) AS b1, max(p) FILTER (broker = 2) AS b2, max(p) FILTER (broker = 3) AS b3, max(p) FILTER (broker = 4) AS b4 FROM newest GROUP BY 1""")
def target_price_pivot(spark: SparkSession, d: str) -> DataFrame:
    brokers = [1, 2, 3, 4]
    rows = r.target_pivot(t.reports(spark, d).filter(F.col("broker").isin(brokers)), brokers)
    return rows.select("report_date", *[F.col(str(b)).alias(f"b{b}") for b in brokers])


SCORES_SQL = """, by_stock AS (SELECT report_id, least(1.0, max(relevance + 0.3)) AS s, 0 AS p FROM stock_mentions WHERE stock_code IN ('000017', '000021', '000102') GROUP BY 1),
by_sector AS (SELECT report_id, 0.4 AS s, 1 AS p FROM sector_mentions WHERE sector = 'ECONOMY'),
by_word AS (SELECT id AS report_id, 0.3 AS s, 2 AS p FROM reports WHERE report_type = '1-URGENT'),
scores AS (SELECT report_id, arg_min(s, p)::DOUBLE AS relevance FROM (SELECT * FROM by_stock UNION ALL SELECT * FROM by_sector UNION ALL SELECT * FROM by_word) GROUP BY 1)"""


@query(f"""{ALL_SQL}{SCORES_SQL}
SELECT report_id, round(relevance * 0.7 + greatest(0.0, 1.0 - date_diff('day', report_date, DATE '{AS_OF}') / 365.0) * 0.3, 9) AS score
FROM scores JOIN reports ON id = report_id JOIN analyses USING (report_id) ORDER BY score DESC, report_id DESC LIMIT 25""")
def context_rank(spark: SparkSession, d: str) -> DataFrame:
    reports = t.reports(spark, d)
    codes = spark.createDataFrame([("000017",), ("000021",), ("000102",)], "stock_code string")
    words = spark.createDataFrame([("ECONOMY",), ("1-URGENT",)], "keyword string")
    keywords = reports.select(F.col("id").alias("report_id"), F.col("report_type").alias("keyword"))
    scores = r.relevance(codes, words, t.stock_mentions(spark, d), t.sector_mentions(spark, d), keywords)
    return r.ranked_context(reports, t.analyses(spark, d), scores, AS_OF).select("report_id", "score")


@query(f"""{ALL_SQL} SELECT count(*) AS total_reports, count(*) FILTER (report_date = DATE '{AS_OF}') AS reports_today, count(pdf_url) AS reports_with_pdf, count(*) FILTER (pipeline_status = 'F') AS analysis_done,
       count(*) FILTER (pipeline_status = 'P') AS analysis_failed, count(*) FILTER (pipeline_status = 'T') AS analysis_truncated, count(*) FILTER (pipeline_status NOT IN ('F', 'P', 'T')) AS analysis_pending FROM reports""")
def overview(spark: SparkSession, d: str) -> DataFrame:
    return dash.overview(t.reports(spark, d), AS_OF)


@query(f"{ALL_SQL} SELECT broker, count(*) AS n FROM reports WHERE report_date >= DATE '{AS_OF}' - 30 GROUP BY 1 ORDER BY n DESC, broker LIMIT 10")
def recent_top_brokers(spark: SparkSession, d: str) -> DataFrame:
    return dash.recent_top_brokers(t.reports(spark, d), AS_OF)


@query(f"{ALL_SQL} SELECT pipeline_status AS status, count(*) AS n FROM reports GROUP BY 1")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return dash.status_histogram(t.reports(spark, d))


COST_SQL = "count(*) AS n_calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::DECIMAL(20,2) AS cost"


@query(f"WITH {t.USAGE_SQL} SELECT model, purpose, {COST_SQL} FROM usage WHERE called_at::DATE >= DATE '2024-01-10' GROUP BY 1, 2")
def cost_by_purpose(spark: SparkSession, d: str) -> DataFrame:
    return dash.cost_by(t.usage(spark, d), ["model", "purpose"], "2024-01-10")


@query(f"WITH {t.USAGE_SQL} SELECT called_at::DATE AS day, {COST_SQL} FROM usage GROUP BY 1")
def cost_by_day(spark: SparkSession, d: str) -> DataFrame:
    return dash.cost_by(t.usage(spark, d), [F.to_date("called_at").alias("day")])


@query(f"""WITH {t.USAGE_SQL}, runs AS (
  SELECT channel, max(called_at::DATE) AS last_run_date, max(called_at) AS last_finished_at, max(message_id) AS latest_message_id, min(message_id) AS earliest_from_id, count(*) AS total_runs, sum(input_tokens)::BIGINT AS total_scanned, sum(output_tokens)::BIGINT AS total_saved
  FROM usage GROUP BY 1)
SELECT channel, last_run_date, last_finished_at, latest_message_id, earliest_from_id, coalesce(total_runs, 0) AS total_runs, coalesce(total_scanned, 0) AS total_scanned, coalesce(total_saved, 0) AS total_saved
FROM (SELECT '@c' || x AS channel FROM range(15) c(x)) LEFT JOIN runs USING (channel)""")
def channel_runs(spark: SparkSession, d: str) -> DataFrame:
    channels = spark.range(15).select(F.concat(F.lit("@c"), F.col("id").cast("string")).alias("channel"), F.lit(True).alias("is_active"))
    return dash.with_active_channels(channels, t.usage(spark, d))


@query(f"WITH {t.USAGE_SQL} SELECT channel, count(*) AS total, count(parse_quality) AS has_parse_quality, count(output_tokens) AS has_output_tokens FROM usage GROUP BY 1")
def channel_coverage(spark: SparkSession, d: str) -> DataFrame:
    return dash.coverage(t.usage(spark, d), ["parse_quality", "output_tokens"])


@query(f"""WITH {t.USAGE_SQL} SELECT channel, count(*) FILTER (parse_quality = 'good') AS good, count(*) FILTER (parse_quality = 'partial') AS "partial", count(*) FILTER (parse_quality = 'poor') AS poor, count(*) FILTER (parse_quality IS NULL) AS unknown FROM usage GROUP BY 1""")
def quality_pivot(spark: SparkSession, d: str) -> DataFrame:
    return dash.quality_pivot(t.usage(spark, d))


@query(f"""WITH {t.USAGE_SQL}, counted AS (SELECT channel, count(*) FILTER (output_tokens > 20) AS n_with_url, count(*) FILTER (output_tokens > 20 AND purpose = 'error') AS n_failed FROM usage GROUP BY 1)
SELECT channel, n_with_url, n_failed, round(n_failed / nullif(n_with_url, 0), 4) AS ratio, coalesce(n_failed / nullif(n_with_url, 0) >= 0.2, false) AS alert FROM counted""")
def failure_alert(spark: SparkSession, d: str) -> DataFrame:
    rows = t.usage(spark, d).select("channel", (F.col("output_tokens") > 20).alias("has_url"), (F.col("purpose") == "error").alias("failed"))
    return dash.failure_alert(rows, 0.2)


@query(f"WITH {t.USAGE_SQL} SELECT id, channel, total FROM (SELECT *, count(*) OVER () AS total FROM usage WHERE purpose = 'click' AND channel = '@c3') ORDER BY called_at DESC, id DESC LIMIT 10 OFFSET 5")
def pending_page(spark: SparkSession, d: str) -> DataFrame:
    return dash.pending_page(t.usage(spark, d).withColumnRenamed("purpose", "review_status"), "click", "@c3", 10, 5).select("id", "channel", "total")


@query("""SELECT s.session_id, count(c.conv_id) AS n_messages FROM (SELECT DISTINCT conv_id AS session_id FROM conversations UNION SELECT -1) s LEFT JOIN conversations c ON c.conv_id = s.session_id GROUP BY 1""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    messages = t.table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    sessions = messages.select("session_id").distinct().unionByName(spark.createDataFrame([(-1,)], "session_id long"))
    return dash.session_list(sessions, messages)


@query("SELECT conv_id AS session_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20")
def last_history(spark: SparkSession, d: str) -> DataFrame:
    messages = t.table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    return dash.last_messages(messages).select("session_id", "turn", "role")


@query(f"{ALL_SQL}, counted AS (SELECT broker, count(*) AS n FROM reports GROUP BY 1) SELECT broker, n, round(n / (SELECT count(*) FROM reports) * 100, 2) AS share FROM counted")
def broker_share(spark: SparkSession, d: str) -> DataFrame:
    return dash.share_of_total(t.reports(spark, d).groupBy("broker").agg(F.count("*").alias("n")), "n")


@query(f"""{ALL_SQL}, counted AS (SELECT m.stock_code, count(DISTINCT m.report_id) AS n, avg(sentiment) AS s FROM stock_mentions m LEFT JOIN analyses a USING (report_id) GROUP BY 1)
SELECT round(sum(n * s) FILTER (s IS NOT NULL) / sum(n) FILTER (s IS NOT NULL), 6) AS weighted_sentiment, count(*) AS n_stocks FROM counted""")
def weighted_sentiment(spark: SparkSession, d: str) -> DataFrame:
    rows = t.stock_mentions(spark, d).join(t.analyses(spark, d).select("report_id", r.sentiment("document").alias("s")), "report_id", "left")
    # a report's mentions of a code meet first, where they lie; no task keeps all reports of its codes to count them
    by_report = rows.groupBy("stock_code", "report_id").agg(F.sum("s").alias("s"), F.count("s").alias("n_s"))
    counted = by_report.groupBy("stock_code").agg(F.count("*").alias("n"), (F.sum("s") / F.nullif(F.sum("n_s"), F.lit(0))).alias("s"))
    return counted.agg(F.round(dash.weighted_mean("s", "n"), 6).alias("weighted_sentiment"), F.count("*").alias("n_stocks"))
