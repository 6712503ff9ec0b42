"""Queries on parsing, upserts, grounding and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import messages as m
from quillspark.functions import text as x
from quillspark.functions.money import model_cost, sentiment_label
from quillspark.functions.payloads import import_outcomes as import_results
from quillspark.operators import grounding as g
from quillspark.operators import upserts as u
from quillspark.plans.research import ALL_SQL
from quillspark.sources import tables as t
from quillspark.streaming import ingest, windows

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT doc_id, lower(regexp_replace(text, '[^가-힣a-zA-Z0-9]', '', 'g')) AS text_normalized, (length(text) * 2 // 3)::BIGINT AS token_estimate,
  length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS digits, len(list_filter(regexp_split_to_array(text, '[\\s,.!?()\\[\\]]+'), lambda w: length(w) >= 2))::BIGINT AS n_tokens FROM documents""")
def text_features(spark: SparkSession, d: str) -> DataFrame:
    return t.spread(t.table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", x.normalize_title("text").alias("text_normalized"), x.token_estimate("text").alias("token_estimate"), x.digit_count("text").cast("bigint").alias("digits"), F.size(x.tokens("text")).cast("bigint").alias("n_tokens")
    )


@query("""WITH told AS (
  SELECT o_orderkey, lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS a, lpad(o_custkey::VARCHAR, 6, '0') AS b FROM orders),
texts AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 0 THEN '1234567 and 12345' WHEN o_orderkey % 2 = 0 THEN a || '원, 1234567 ' || b || ' 원' ELSE '(' || a || ')A' || b || '.12345 _' || a END AS text FROM told)
SELECT o_orderkey, list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_가-힣])([0-9]{6})(?:$|[^0-9A-Za-z_가-힣])', 1))) AS codes FROM texts""")
def six_digit_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of each order beside longer and shorter numbers, and some that touch letters."""
    k, six = F.col("o_orderkey"), lambda c: F.lpad(c.cast("string"), 6, "0")
    a, b = six(k % 1_000_000), six(F.col("o_custkey"))
    text = F.when(k % 1000 == 0, "1234567 and 12345").when(k % 2 == 0, F.concat(a, F.lit("원, 1234567 "), b, F.lit(" 원"))).otherwise(F.concat(F.lit("("), a, F.lit(")A"), b, F.lit(".12345 _"), a))
    return t.table(spark, d, "orders").select("o_orderkey", F.array_sort(F.array_distinct(x.six_digit_codes(text))).alias("codes"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']+)["'']', 1))::BIGINT AS n_links, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").select("page_id", F.size(x.links("html")).cast("bigint").alias("n_links"), x.host("url").alias("host"))


@query("""SELECT kind, count(*) AS n FROM (SELECT ['direct', 'short_url', 'google_drive', 'unsupported'][(page_id % 4 + 1)::INT] AS kind FROM pages) GROUP BY 1""")
def url_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The pages' own addresses beside short, drive and chat addresses of them."""
    others = [F.lit(f"https://{host}/x?page=") for host in ("bit.ly", "Drive.Google.com/file/d", "t.me")]
    address = F.element_at(F.array(F.col("url"), *[F.concat(o, F.col("page_id").cast("string")) for o in others]), (F.col("page_id") % 4 + 1).cast("int"))
    return t.table(spark, d, "pages").groupBy(x.url_kind(address).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name, lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INT, '0') AS code FROM customer""")
def code_norm(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "customer").select("c_custkey", "c_name", x.normalize_stock_code(F.concat(F.lit(" A"), F.col("c_custkey").cast("string"))).alias("code"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice)::BIGINT WHEN 1 THEN (o_orderkey % 100) * 10000 ELSE (o_orderkey % 10) * 100000000 END::BIGINT AS price FROM orders""")
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    told = F.when(k % 3 == 0, F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit("원"))).when(k % 3 == 1, F.concat((k % 100).cast("string"), F.lit("만원"))).otherwise(F.concat((k % 10).cast("string"), F.lit(" 억")))
    return t.table(spark, d, "orders").select("o_orderkey", x.parse_price(told).alias("price"))


#: Reading a message costs much more than a row elsewhere: a task takes fewer.
MESSAGES_A_TASK = 20_000


@query()
def parsed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Orders told as messages of three channels, and read back: digests of two blocks, changed prices, chat links, continuations."""
    k = F.col("o_orderkey")
    channel = F.element_at(F.array(F.lit(m.DIGEST_CHANNEL), F.lit(m.COMPANY_CHANNEL), F.lit("@other")), (k % 3 + 1).cast("int"))
    code, price = F.lpad((k % 1_000_000).cast("string"), 6, "0"), F.format_number(F.floor("o_totalprice"), 0)
    head = F.concat(F.lit("▶ **종목"), F.lit("가("), code, F.lit(")** 실적 점검 - KB증권 홍길동\n목표가: "))
    target = F.when(k % 2 == 0, F.concat(F.lit("1,000원 → "), price)).otherwise(price)
    link = F.when(k % 5 == 0, "https://t.me/room/7").otherwise(F.concat(F.lit("https://x.example/"), k.cast("string"), F.lit(".pdf")))
    block = F.concat(head, target, F.lit("원 (BUY)\n"), link)
    text = F.when(k % 3 == 0, F.concat(F.lit("오늘의 리포트\n\n"), block, F.lit("\n\n▶ 반도체 산업 - 삼성증권 [링크]\nhttps://y.example/a.pdf"))).when(k % 6 == 5, F.concat(F.lit("(Continuing) "), block)).otherwise(block)
    orders = t.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    told = t.dealt(orders, of=orders, each=MESSAGES_A_TASK).select(channel.alias("channel"), k.alias("message_id"), text.alias("text"))
    names = ["channel", "message_id", "block_no", "title", "stock_name", "stock_code", "broker", "analyst", "opinion", "prev_target_price", "target_price", "pdf_url", "quality"]
    return m.parse_messages(told).select(*names, F.element_at("chat_links", 1).alias("chat_link"))


ORACLE_SQL["parsed_messages"] = """
WITH told AS (
  SELECT o_orderkey AS k, lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS code, floor(o_totalprice)::BIGINT AS price, CASE WHEN o_orderkey % 5 <> 0 THEN 'https://x.example/' || o_orderkey || '.pdf' END AS url,
         CASE WHEN o_orderkey % 5 = 0 THEN 'https://t.me/room/7' END AS chat_link FROM orders)
SELECT '@repostory123' AS channel, k AS message_id, 0 AS block_no, '실적 점검' AS title, '종목가' AS stock_name, code AS stock_code, 'KB증권' AS broker, '홍길동' AS analyst, '매수' AS opinion,
       CASE WHEN k % 2 = 0 THEN 1000 END::BIGINT AS prev_target_price, price AS target_price, url AS pdf_url, 'poor' AS quality, chat_link FROM told WHERE k % 3 = 0
UNION ALL SELECT '@repostory123', k, 1, '반도체 산업', NULL, NULL, '삼성증권', NULL, NULL, NULL, NULL, 'https://y.example/a.pdf', 'partial', NULL FROM told WHERE k % 3 = 0
UNION ALL SELECT CASE WHEN k % 3 = 1 THEN '@companyreport' ELSE '@other' END, k, 0, '▶ **종목가(' || code || ')** 실적 점검 - KB증권 홍길동', '종목가', code, 'KB증권', NULL, '매수', NULL,
       CASE WHEN k % 2 = 0 THEN 1000 ELSE price END, url, 'good', chat_link FROM told WHERE k % 3 <> 0 AND k % 6 <> 5"""


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN s >= 0.6 THEN 'very positive' WHEN s >= 0.2 THEN 'positive' WHEN s > -0.2 THEN 'neutral' WHEN s > -0.6 THEN 'negative' ELSE 'very negative' END AS label FROM (SELECT ((props::JSON ->> '$.k')::INT - 50) / 50.0::DOUBLE AS s FROM events)) GROUP BY 1""")
def sentiment_labels(spark: SparkSession, d: str) -> DataFrame:
    s = (F.get_json_object("props", "$.k").cast("int") - 50) / F.lit(50.0)
    return t.table(spark, d, "events").groupBy(sentiment_label(s).alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, round(((k * 10 + k * 1.25) * 3.00 + k * 15.00) / 1000000.0 * CASE WHEN k % 2 = 0 THEN 0.5 ELSE 1.0 END, 8)::DECIMAL(18,8) AS cost FROM (SELECT event_id, (props::JSON ->> '$.k')::DECIMAL(10,0) AS k FROM events)""")
def model_costs(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    prices = {"m": (3.00, 15.00)}
    return t.table(spark, d, "events").select("event_id", model_cost(F.lit("m"), k * 10, k, k, None, k % 2 == 0, prices).alias("cost"))


@query(f"""{ALL_SQL}, stored AS (SELECT * FROM reports WHERE pipeline_status IN ('O', 'P')), incoming AS (
  SELECT id, CASE WHEN id % 3 <> 0 THEN '매도' END AS opinion, CASE WHEN id % 3 <> 0 THEN pdf_url END AS pdf_url, target_price + 1 AS target_price FROM reports WHERE pipeline_status IN ('F', 'P'))
SELECT coalesce(s.id, i.id) AS id, CASE WHEN i.id IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'inserted' WHEN i.opinion IS NOT NULL OR i.pdf_url IS NOT NULL THEN 'updated' ELSE 'skipped' END AS action,
  CASE WHEN s.id IS NULL OR i.opinion IS NOT NULL OR i.pdf_url IS NOT NULL THEN i.opinion ELSE s.opinion END AS opinion, CASE WHEN s.id IS NULL OR i.opinion IS NOT NULL OR i.pdf_url IS NOT NULL THEN i.target_price ELSE s.target_price END AS target_price
FROM stored s FULL JOIN incoming i ON s.id = i.id""")
def upsert_conditional(spark: SparkSession, d: str) -> DataFrame:
    """All reports: open ones are stored, filled ones come in, and partly filled ones are stored and come in again."""
    reports = t.reports(spark, d).withColumn("title_normalized", x.normalize_title("title"))
    stored = reports.filter(F.col("pipeline_status").isin("O", "P")).select("id", "broker", "report_date", "title_normalized", "opinion", "pdf_url", "target_price")
    incoming = reports.filter(F.col("pipeline_status").isin("F", "P")).select(
        "id", "broker", "report_date", "title_normalized", F.when(F.col("id") % 3 != 0, "매도").alias("opinion"), F.when(F.col("id") % 3 != 0, F.col("pdf_url")).alias("pdf_url"), (F.col("target_price") + 1).alias("target_price"), F.col("id").alias("seq")
    )
    return u.upsert_reports(stored, incoming, ["broker", "report_date", "title_normalized"], ["opinion", "pdf_url", "target_price"]).select("id", "action", "opinion", "target_price")


@query(f"""{ALL_SQL}, lines AS (
  SELECT id * 2 AS line, id AS report_id, CASE WHEN id % 11 = 0 THEN 'error' ELSE 'success' END AS status, id % 6 AS kind FROM reports
  UNION ALL SELECT id * 2 + 1, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN -id ELSE id END, 'success', 0 FROM reports),
told AS (SELECT line, report_id, kind NOT IN (2, 3, 5) AS valid, id IS NOT NULL AS known, coalesce(pipeline_status = 'F', false) AS was_done FROM lines LEFT JOIN reports ON id = report_id WHERE status = 'success' AND kind <> 4),
firsts AS (SELECT report_id, min(line) AS first FROM told WHERE valid AND known AND NOT was_done GROUP BY 1)
SELECT line, CASE WHEN was_done OR coalesce(line > first, false) THEN 'skipped' WHEN valid AND known AND line = first THEN 'imported' ELSE 'failed' END AS outcome,
       CASE WHEN valid THEN '제목 ' || line END AS title, CASE WHEN valid THEN 'cause' END AS step FROM told LEFT JOIN firsts USING (report_id)""")
def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Two lines for each report: the first may have failed, hold nothing, no JSON, no chain or a strange category; filled reports are done."""
    reports = t.reports(spark, d).select("id", F.when(F.col("pipeline_status") == "F", "done").otherwise("new").alias("pipeline_status"))
    k = F.col("id")
    first = reports.select((k * 2).alias("line"), k.alias("report_id"), F.when(k % 11 == 0, "error").otherwise("success").alias("status"), (k % 6).alias("kind"))
    second = reports.select((k * 2 + 1).alias("line"), F.when(k % 13 != 0, F.when(k % 17 == 0, -k).otherwise(k)).alias("report_id"), F.lit("success").alias("status"), F.lit(0).cast("bigint").alias("kind"))
    body = F.concat(F.lit('"meta": {"title": "제목 '), F.col("line").cast("string"), F.lit('"}, "chain": '))
    chain = F.when(F.col("kind") == 1, '{"step": "cause"}').when(F.col("kind") == 2, "7").otherwise('[{"step": "cause"}]')
    category = F.when(F.col("kind") == 5, "other").when(F.col("kind") == 1, "산업").otherwise("stock")
    whole = F.concat(F.lit('{"report_category": "'), category, F.lit('", '), body, chain, F.lit("}"))
    lines = first.unionByName(second).withColumn("payload", F.when(F.col("kind") == 3, "{broken").when(F.col("kind") != 4, whole))
    read = lambda path: F.try_variant_get("document", path, "string")
    return import_results(lines, reports).select("line", "outcome", read("$.meta.title").alias("title"), read("$.chain[0].step").alias("step"))


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    stored = t.table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    incoming = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    return u.insert_ignore(stored, incoming, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, coalesce(p, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    stored = t.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    incoming = t.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("seq"))
    return u.latest_wins(stored, incoming, ["c_custkey"])


#: Orders that are filled come with new items; all others keep the child that is stored.
ITEMS_SQL = "items AS (SELECT l_orderkey AS report_id, p.* , l_partkey FROM lineitem JOIN part p ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')"


def order_payloads(spark: SparkSession, d: str, *told: Column) -> tuple[DataFrame, DataFrame]:
    """(report_id, child_key) stored for every order, and (report_id, items array) of the filled ones."""
    orders = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("status"))
    lines, parts = t.table(spark, d, "lineitem"), t.table(spark, d, "part")
    items = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_orderkey", "report_id")
    filled = t.dealt(items, "report_id", of=lines).join(orders.filter("status = 'F'"), "report_id")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", F.struct(*told).alias("item"))))
    return orders.select("report_id", F.lit("old").alias("child_key")), filled.groupBy("report_id").agg(F.transform(ordered, lambda i: i["item"]).alias("items"))


def _children_sql(key: str, where: str = "true") -> str:
    return f"WITH {ITEMS_SQL} SELECT DISTINCT report_id, {key} AS child_key FROM items WHERE {where} UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey NOT IN (SELECT report_id FROM items)"


@query(_children_sql("CASE WHEN l_partkey % 3 = 0 THEN '_name_' || p_name ELSE lpad(l_partkey::VARCHAR, 6, '0') END"))
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    """Stock mentions by code, or by name where there is none."""
    code = F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    stored, payloads = order_payloads(spark, d, F.col("p_name").alias("company_name"), code.alias("stock_code"))
    return u.replace_children(stored, payloads, "items", u.stock_key())


@query(_children_sql("p_type || '/' || CASE WHEN p_size % 2 = 0 THEN 'primary' ELSE 'related' END", "p_size <> 7"))
def replace_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Sector mentions by sector and type; blank sectors are dropped."""
    stored, payloads = order_payloads(spark, d, F.when(F.col("p_size") != 7, F.col("p_type")).otherwise(" ").alias("sector"), F.when(F.col("p_size") % 2 == 0, "primary").otherwise("related").alias("mention_type"))
    return u.replace_children(stored, payloads, "items", u.sector_key(), keep=u.told("sector"))


@query(_children_sql("p_brand"))
def replace_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords, the first of each."""
    stored, payloads = order_payloads(spark, d, F.col("p_brand").alias("keyword"), F.col("p_type").alias("keyword_type"))
    return u.replace_children(stored, payloads, "items", F.col("keyword"), keep=u.told("keyword"))


@query(f"""{ALL_SQL} SELECT id, 'title' AS field, title AS old, lower(regexp_replace(title, '[^가-힣a-zA-Z0-9]', '', 'g')) AS new FROM reports WHERE title <> lower(regexp_replace(title, '[^가-힣a-zA-Z0-9]', '', 'g'))""")
def changed_titles(spark: SparkSession, d: str) -> DataFrame:
    return u.changed_fields(t.reports(spark, d), {"title": x.normalize_title("title")}, "id")


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN found IS NULL THEN 'miss' WHEN gap = 0 THEN 'same' WHEN gap > 90 THEN 'diff' ELSE 'update' END AS class FROM (
  SELECT found, abs(date_diff('day', stored, found)) AS gap FROM (SELECT o_orderdate::DATE AS stored, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + ((o_orderkey % 7) * 20)::INT END AS found FROM orders))) GROUP BY 1""")
def date_classes(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = t.table(spark, d, "orders").select(day.alias("stored"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, ((F.col("o_orderkey") % 7) * 20).cast("int"))).alias("found"))
    return g.date_repair(rows).groupBy("class").agg(F.count("*").alias("n"))


NUMBERS_SQL = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({}, ''), '\\b[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?|\\b[0-9]+\\.[0-9]+|\\b[0-9]{{2,}}\\b'), lambda n: replace(n, ',', '')), lambda n: length(replace(n, '.', '')) >= 2))"


@query(f"""WITH turns AS (
  SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY text) FILTER (role = 'assistant'), '') AS analysis, coalesce(string_agg(text, ' ' ORDER BY text) FILTER (role IS DISTINCT FROM 'assistant'), '') AS charts FROM conversations GROUP BY 1),
numbers AS (SELECT coalesce(lang, 'unknown') AS report_type, {NUMBERS_SQL.format("analysis")} AS a, {NUMBERS_SQL.format("text")} AS b, {NUMBERS_SQL.format("charts")} AS c FROM documents LEFT JOIN turns ON conv_id = doc_id),
counted AS (
  SELECT report_type, len(a) AS n, len(list_filter(a, lambda x: list_contains(b, x) AND NOT list_contains(c, x))) AS md, len(list_filter(a, lambda x: list_contains(c, x) AND NOT list_contains(b, x))) AS chart,
         len(list_filter(a, lambda x: list_contains(b, x) AND list_contains(c, x))) AS two, len(list_filter(a, lambda x: NOT list_contains(b, x) AND NOT list_contains(c, x))) AS none FROM numbers)
SELECT report_type, count(*) AS n_reports, sum(n)::BIGINT AS layer2_total, coalesce(round(sum(md) * 100 / nullif(sum(n), 0), 2), 0) AS md_only_pct, coalesce(round(sum(chart) * 100 / nullif(sum(n), 0), 2), 0) AS chart_only_pct,
       coalesce(round(sum(two) * 100 / nullif(sum(n), 0), 2), 0) AS both_pct, coalesce(round(sum(none) * 100 / nullif(sum(n), 0), 2), 0) AS neither_pct FROM counted GROUP BY 1""")
def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the assistant's turns that stand in the whole document or in the other turns of its conversation."""
    told = lambda whose: F.array_join(F.array_sort(F.collect_list(F.when(whose, F.col("text")))), " ")
    assistant = F.col("role").eqNullSafe("assistant")
    turns = t.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(told(assistant).alias("analysis"), told(~assistant).alias("charts"))
    rows = t.table(spark, d, "documents").join(turns, "doc_id", "left").select(F.col("doc_id").alias("report_id"), F.col("lang").alias("report_type"), "analysis", F.col("text").alias("body"), "charts")
    return g.grounding_by_type(g.grounded(rows))


@query("""SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value)::DECIMAL(30,6), 4)::DOUBLE AS value FROM events GROUP BY 1, 2""")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.daily_counts(ingest.parquet_stream(spark, d, "events"))
    return ingest.run_to_files(rows, "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of events that each user has had, each told once."""
    rows = ingest.first_seen(ingest.parquet_stream(spark, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type")
    return ingest.run_to_files(rows, "append")


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM numbered GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.sessions(ingest.parquet_stream(spark, d, "events"))
    told = ingest.run_to_files(rows, "complete")
    return told.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


def gated(spark: SparkSession, d: str) -> str:
    """The folder of a gated replay of all events, with its end mark."""
    folder = f"{ingest.shared_folder(spark)}/gate-{uuid.uuid4().hex}"
    windows.gate(ingest.parquet_stream(spark, d, "events"), folder).awaitTermination()
    windows.end_replay(spark, folder)
    return folder


@query(ORACLE_SQL["stream_daily_counts"])
def stream_closed_days(spark: SparkSession, d: str) -> DataFrame:
    """Days told once each, in append mode, when the watermark has passed them."""
    return ingest.run_to_files(windows.closed_days(windows.in_time(spark, gated(spark, d))), "append")


@query(ORACLE_SQL["stream_sessions"])
def stream_closed_sessions(spark: SparkSession, d: str) -> DataFrame:
    told = ingest.run_to_files(windows.closed_sessions(windows.in_time(spark, gated(spark, d))), "append")
    return told.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")
