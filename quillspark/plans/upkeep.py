"""Queries on states, cursors, retries, entities, completeness and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as x
from quillspark.operators import dashboards as dash
from quillspark.operators import grounding as g
from quillspark.operators import lots
from quillspark.operators import reports as r
from quillspark.operators import upserts as u
from quillspark.operators import worklists as w
from quillspark.plans.research import ALL_SQL
from quillspark.plans.trading import LOTS_SQL
from quillspark.sources import tables as t

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


REASONS = ("http_404", "timeout", "unsupported_host:t.me", "not_pdf")


@query(f"""{ALL_SQL} SELECT id, ['http_404', 'timeout', 'unsupported_host:t.me', 'not_pdf'][(id % 4 + 1)::INT] AS reason FROM reports WHERE pipeline_status = 'P' AND id % 4 = 1""")
def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    """Failed downloads whose reason may pass."""
    reason = F.element_at(F.array(*[F.lit(c) for c in REASONS]), (F.col("id") % 4 + 1).cast("int"))
    failed = t.reports(spark, d).withColumn("reason", reason).withColumn("pdf_fail_retryable", x.retryable("reason"))
    rows = failed.withColumn("pipeline_status", F.when(F.col("pipeline_status") == "P", "pdf_failed").otherwise(F.col("pipeline_status")))
    return w.retry_queue(rows).select("id", "reason")


@query(f"""{ALL_SQL} SELECT id FROM reports WHERE pdf_url IS NOT NULL AND id IN (SELECT report_id FROM analyses) AND report_date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'""")
def suspect_dates(spark: SparkSession, d: str) -> DataFrame:
    return w.suspect_dates(t.reports(spark, d).withColumn("pdf_path", F.col("pdf_url")), t.analyses(spark, d), "1995-01-01", "1995-12-31").select("id")


@query(f"{LOTS_SQL} SELECT symbol, buy_id AS buy_trade_id, sell_id AS sell_trade_id, q::BIGINT AS matched_qty FROM pairs WHERE symbol = 17")
def pairs_of_symbol(spark: SparkSession, d: str) -> DataFrame:
    trades = t.trades(spark, d)
    # a pair never leaves its symbol, so only that one's trades are matched
    return w.pairs_of_symbol(lots.match_lots(trades.filter(F.col("symbol") == 17)), trades, 17).select("symbol", "buy_trade_id", "sell_trade_id", "matched_qty")


@query(f"WITH {t.TRADES_SQL} SELECT id, side, quantity FROM trades WHERE symbol = 17 AND traded_at >= TIMESTAMP '1995-01-01'")
def chart_markers(spark: SparkSession, d: str) -> DataFrame:
    return dash.chart_markers(t.trades(spark, d), 17, date_from="1995-01-01").select("id", "side", "quantity")


@query(f"""{ALL_SQL}, stored AS (
  SELECT id, id IN (SELECT report_id FROM analyses) AS analysed, CASE WHEN id % 3 <> 0 THEN 'a.pdf' END AS pdf_path, CASE id % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS pdf_download_failed,
         ['http_404', 'timeout', 'unsupported_host:t.me', 'not_pdf:text/html', NULL][(id % 5 + 1)::INT] AS pdf_fail_reason FROM reports)
SELECT id, CASE WHEN analysed THEN 'done' WHEN pdf_download_failed = true AND NOT analysed THEN 'pdf_failed' WHEN pdf_path IS NOT NULL AND pdf_download_failed = false AND NOT analysed THEN 'pdf_done' ELSE 'new' END AS pipeline_status,
       CASE WHEN pdf_fail_reason IN ('http_404', 'http_410', 'no_url') OR pdf_fail_reason LIKE 'not_pdf%' OR pdf_fail_reason LIKE 'unsupported_host:%' THEN false WHEN pdf_fail_reason IS NOT NULL THEN true END AS pdf_fail_retryable FROM stored""")
def backfill_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    reason = F.element_at(F.array(*[F.lit(c) for c in ("http_404", "timeout", "unsupported_host:t.me", "not_pdf:text/html", None)]), (k % 5 + 1).cast("int"))
    rows = t.reports(spark, d).select("id", F.when(k % 3 != 0, "a.pdf").alias("pdf_path"), F.when(k % 4 != 3, k % 4 == 0).alias("pdf_download_failed"), reason.alias("pdf_fail_reason"))
    return u.backfill_status(rows, t.analyses(spark, d).select(F.col("report_id").alias("id"))).select("id", "pipeline_status", "pdf_fail_retryable")


@query("""WITH told AS (
  SELECT event_id, ['new', 's2a_done', 'pdf_done', 'analysis_pending'][(user_id % 4 + 1)::INT] AS pipeline_status, CASE WHEN user_id % 3 = 0 THEN 'pending' END AS analysis_status, CASE WHEN user_id % 2 = 0 THEN false END AS failed,
         ['classified', 'downloaded', 'download_failed', 'submitted', 'analysed', 'truncated', 'analysis_failed', 'batch_failed', 'seen'][(event_id % 9 + 1)::INT] AS event, ['http_410', 'timeout', NULL, 'not_pdf:' || repeat('x', 600)][(user_id % 4 + 1)::INT] AS reason FROM events)
SELECT event_id,
  CASE event WHEN 'classified' THEN 's2a_done' WHEN 'downloaded' THEN 'pdf_done' WHEN 'download_failed' THEN 'pdf_failed' WHEN 'submitted' THEN 'analysis_pending' WHEN 'analysed' THEN 'done' WHEN 'truncated' THEN 'done' WHEN 'analysis_failed' THEN 'analysis_failed' WHEN 'batch_failed' THEN 'analysis_failed' ELSE pipeline_status END AS pipeline_status,
  CASE event WHEN 'analysed' THEN 'done' WHEN 'truncated' THEN 'truncated' WHEN 'analysis_failed' THEN 'failed' ELSE analysis_status END AS analysis_status,
  CASE WHEN event = 'download_failed' THEN true ELSE failed END AS pdf_download_failed, CASE WHEN event = 'download_failed' THEN left(coalesce(reason, 'unknown'), 500) END AS pdf_fail_reason,
  CASE WHEN event = 'download_failed' THEN coalesce(reason, 'unknown') NOT IN ('http_404', 'http_410', 'not_pdf:html_response', 'not_pdf', 'no_url') AND NOT starts_with(coalesce(reason, 'unknown'), 'unsupported_host:') END AS pdf_fail_retryable FROM told""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Each event as what happens to a report in some state."""
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    user, number = F.col("user_id"), F.col("event_id")
    rows = t.table(spark, d, "events").select(
        "event_id",
        pick(("new", "s2a_done", "pdf_done", "analysis_pending"), user % 4).alias("pipeline_status"),
        F.when(user % 3 == 0, "pending").alias("analysis_status"),
        F.when(user % 2 == 0, F.lit(False)).alias("pdf_download_failed"),
        F.lit(None).cast("string").alias("pdf_fail_reason"),
        F.lit(None).cast("boolean").alias("pdf_fail_retryable"),
        pick((*u.EVENT_STATES, "seen"), number % 9).alias("event"),
        pick(("http_410", "timeout", None, "not_pdf:" + "x" * 600), user % 4).alias("reason"),
    )
    return u.after_event(rows).drop("event", "reason")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = t.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return u.cascade(t.table(spark, d, "lineitem"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'reviewed' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders""")
def point_updates(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "orders")
    changes = rows.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("reviewed").alias("o_orderpriority"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("seq"))
    return u.point_updates(rows, changes, ["o_orderkey"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""WITH cursors AS (SELECT DISTINCT 'u' || user_id AS channel, 900 AS last_message_id, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 100 END AS reverse_min_id FROM events WHERE user_id % 5 <> 0),
ends AS (SELECT 'u' || user_id AS channel, max(event_id) AS high, min(event_id) AS low FROM events WHERE event_id % 7 = 0 GROUP BY 1)
SELECT channel, 'forward' AS direction, CASE WHEN high IS NOT NULL THEN high ELSE last_message_id END::BIGINT AS last_message_id, reverse_min_id::BIGINT AS reverse_min_id FROM cursors FULL JOIN ends USING (channel)
UNION ALL SELECT channel, 'reverse', last_message_id, CASE WHEN low IS NOT NULL AND (reverse_min_id IS NULL OR reverse_min_id = 0 OR low < reverse_min_id) THEN low ELSE reverse_min_id END FROM cursors FULL JOIN ends USING (channel)""")
def advanced_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Users as channels, a seventh of the events as the messages of a run; a fifth of the channels is new."""
    user = F.col("user_id")
    events = t.table(spark, d, "events").withColumn("channel", F.concat(F.lit("u"), user.cast("string")))
    unset = F.when(user % 3 == 1, 0).when(user % 3 == 2, 100).cast("bigint")
    cursors = events.filter(user % 5 != 0).select("channel", F.lit(900).cast("bigint").alias("last_message_id"), unset.alias("reverse_min_id")).distinct()
    seen = events.filter(F.col("event_id") % 7 == 0).select("channel", F.col("event_id").alias("message_id"))
    ways = [u.advanced_cursors(cursors, seen, reverse).withColumn("direction", F.lit("reverse" if reverse else "forward")) for reverse in (False, True)]
    return ways[0].unionByName(ways[1])


@query(f"""WITH {t.BARS_SQL}, last AS (SELECT symbol, max(day) AS last_day FROM bars GROUP BY 1)
SELECT symbol, unnest(generate_series(last_day + 1, DATE '2003-01-31', INTERVAL 1 DAY))::DATE AS day FROM last WHERE last_day < DATE '2003-01-31'""")
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    return u.missing_days(t.bars(spark, d), "2003-01-31")


@query(f"WITH {t.BARS_SQL} SELECT symbol, day, open, high, low, close, volume FROM bars WHERE symbol = 3 AND day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def bars_between(spark: SparkSession, d: str) -> DataFrame:
    return t.bars_between(t.bars(spark, d), 3, "1995-01-01", "1996-12-31")


@query("""SELECT c_custkey AS question_id, list_sort(list_distinct([lpad((c_custkey % 150 + 1)::VARCHAR, 6, '0'), lpad((c_custkey % 97 + 1)::VARCHAR, 6, '0')])) AS stock_codes, ['전망', '어때요'] AS keywords FROM customer""")
def question_entities(spark: SparkSession, d: str) -> DataFrame:
    """Questions that name one stock and tell the code of another."""
    stocks = t.table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"), F.concat(F.lit("종목"), F.col("p_partkey").cast("string")).alias("name"))
    k = F.col("c_custkey")
    asked = F.concat(F.lit("종목"), (k % 150 + 1).cast("string"), F.lit(", 전망 ("), F.lpad((k % 97 + 1).cast("string"), 6, "0"), F.lit(") 전망 어때요?"))
    return r.query_entities(t.table(spark, d, "customer").select(k.alias("question_id"), asked.alias("question")), stocks.withColumn("name_normalized", x.normalize_stock_name("name")))


@query(f"""{ALL_SQL} SELECT id AS report_id, broker, report_date::VARCHAR AS day, opinion IS NULL AS dropped FROM reports WHERE id IN (SELECT report_id FROM analyses)""")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of all analysed reports, read back: null fields are left out."""
    ranked = t.reports(spark, d).withColumnRenamed("id", "report_id").join(t.analyses(spark, d), "report_id")
    block = lambda k: F.get_json_object("block", f"$.{k}")
    return r.context_blocks(ranked).select("report_id", block("broker").cast("bigint").alias("broker"), block("date").alias("day"), (~F.col("block").contains('"opinion"')).alias("dropped"))


@query(f"{ALL_SQL} SELECT report_id FROM analyses WHERE report_id % 3 <> 1")
def with_json_key(spark: SparkSession, d: str) -> DataFrame:
    """Analyses that hold a chain, be it null."""
    chain = F.element_at(F.array(F.lit('"chain": [], '), F.lit(""), F.lit('"chain": null, ')), (F.col("report_id") % 3 + 1).cast("int"))
    rows = t.analyses(spark, d).withColumn("document", F.concat(F.lit("{"), chain, F.substr("document", F.lit(2))))
    return r.with_key(rows, "document", "chain").select("report_id")


@query(f"{ALL_SQL} SELECT count(*) AS n_groups FROM (SELECT stock_code FROM stock_mentions WHERE regexp_full_match(stock_code, '[0-9]{{6}}') GROUP BY 1)")
def count_of_stocks(spark: SparkSession, d: str) -> DataFrame:
    return r.count_of_groups(t.stock_mentions(spark, d).filter(F.col("stock_code").rlike(r.VALID_CODE)), ["stock_code"])


@query("""WITH told AS (
  SELECT o_orderdate::DATE AS stored, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE + (o_orderkey % 9)::INT END AS found, CASE WHEN o_orderkey % 10 <> 7 THEN o_orderdate::DATE + (o_orderkey % 11)::INT END AS message_day FROM orders),
chosen AS (SELECT *, CASE WHEN message_day IS NULL THEN NULL WHEN found IS NOT NULL AND abs(date_diff('day', found, message_day)) <= 3 THEN 'regex' ELSE 'msg' END AS source FROM told)
SELECT source, CASE WHEN source IS NULL THEN 'not_found' WHEN (CASE source WHEN 'regex' THEN found ELSE message_day END) = stored THEN 'no_change' ELSE 'update' END AS outcome, count(*) AS n FROM chosen GROUP BY ALL""")
def arbitrated_dates(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = t.table(spark, d, "orders").select(day.alias("stored"), F.when(k % 4 != 0, F.date_add(day, (k % 9).cast("int"))).alias("found"), F.when(k % 10 != 7, F.date_add(day, (k % 11).cast("int"))).alias("message_day"))
    return g.arbitrated_date(rows).groupBy("source", "outcome").agg(F.count("*").alias("n"))


@query("""WITH told AS (SELECT ['valuation_impact', 'cause', 'valuation_impact'][(conv_id % 3 + 1)::INT] AS step, conv_id, text FROM conversations WHERE role = 'assistant'),
numbers AS (SELECT step, list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda n: length(n) >= 2)) AS a, list_distinct(list_filter(regexp_extract_all(coalesce((SELECT c_name FROM customer WHERE c_custkey = conv_id), ''), '[0-9]+'), lambda n: length(n) >= 2)) AS b FROM told)
SELECT step, count(*) AS n_steps, round(count(*) FILTER (len(a) > 0) * 100 / count(*), 1) AS with_number_pct, sum(len(a))::BIGINT AS n_numbers, coalesce(round(sum(len(list_intersect(a, b))) * 100 / nullif(sum(len(a)), 0), 1), 0) AS grounded_pct,
       coalesce(round(sum(len(a) - len(list_intersect(a, b))) * 100 / nullif(sum(len(a)), 0), 1), 0) AS ungrounded_pct FROM numbers WHERE step = 'valuation_impact' GROUP BY 1""")
def valuation_grounding(spark: SparkSession, d: str) -> DataFrame:
    """The assistant's turns, digits only, as steps of a chain, held against the name of a customer."""
    k = F.col("conv_id")
    step = F.element_at(F.array(F.lit("valuation_impact"), F.lit("cause"), F.lit("valuation_impact")), (k % 3 + 1).cast("int"))
    digits = lambda c: F.regexp_replace(c, "[^0-9]+", " ")
    turns = t.table(spark, d, "conversations").filter("role = 'assistant'").select(k.alias("c_custkey"), F.array(F.struct(step.alias("step"), digits("text").alias("text"))).alias("chain"))
    sources = t.table(spark, d, "customer").select("c_custkey", digits("c_name").alias("body"))
    return g.step_grounding(turns.join(sources, "c_custkey", "left").withColumnRenamed("c_custkey", "report_id"), ["valuation_impact"])


@query(f"""{ALL_SQL}, told AS (SELECT count(*) AS n, count(opinion) AS a, count(target_price) AS b, count(pdf_url) AS c FROM reports)
SELECT * FROM (SELECT 'opinion' AS field, a AS filled, round(a * 100 / n, 2) AS pct FROM told UNION ALL SELECT 'target_price', b, round(b * 100 / n, 2) FROM told UNION ALL SELECT 'pdf_url', c, round(c * 100 / n, 2) FROM told)""")
def field_fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return g.fill_rates(t.reports(spark, d), ["opinion", "target_price", "pdf_url"])


@query("""SELECT key, count(*) AS n FROM (SELECT 'calls' AS key FROM events UNION ALL SELECT event_type FROM events) GROUP BY 1 ORDER BY n DESC, key LIMIT 15""")
def metric_keys(spark: SparkSession, d: str) -> DataFrame:
    """Events as maps of what they measure: their calls and the value of their type."""
    metrics = F.create_map(F.lit("calls"), F.lit(1.0), F.col("event_type"), F.col("value"))
    return g.key_histogram(t.table(spark, d, "events").select(metrics.alias("metrics")), "metrics")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'direct: http_404' WHEN o_orderkey % 3 = 1 THEN 'direct: http_404 | chat: no_link' ELSE 'unknown' END AS detail FROM orders""")
def failure_details(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    attempts = F.when(k % 3 == 0, F.array(F.lit("direct: http_404"))).when(k % 3 == 1, F.array(F.lit("direct: http_404"), F.lit("chat: no_link"))).otherwise(F.array().cast("array<string>"))
    return t.table(spark, d, "orders").select("o_orderkey", x.failure_detail(attempts).alias("detail"))


@query("""SELECT c_custkey, CASE WHEN n = 0 THEN 100 ELSE round(done / n * 100)::INT END AS pct FROM (
  SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def completion_by_customer(spark: SparkSession, d: str) -> DataFrame:
    orders = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    rows = t.table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").na.fill(0, ["n", "done"])
    return rows.select("c_custkey", dash.completion(F.col("done"), F.col("n")).alias("pct"))


@query(f"""{ALL_SQL} SELECT id, report_date FROM (SELECT id, report_date, row_number() OVER (ORDER BY id) AS n FROM reports WHERE id NOT IN (SELECT report_id FROM analyses)) WHERE n <= 300 - 40""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    """What may still be analysed today of 300 reports, 40 being done."""
    return w.daily_cap(r.without_analysis(t.reports(spark, d), t.analyses(spark, d)), 300, 40, ["id"]).select("id", "report_date")
