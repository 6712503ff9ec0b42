from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import payloads
from quillspark.operators import grounding, page_selection, worklists
from quillspark.operators import upserts as u
from quillspark.plans import ingest as plans
from quillspark.sources import broker_csv, files
from quillspark.streaming import ingest

FIRST = """미래에셋증권 거래내역
,,
계좌,,

거래일자,거래종류,종목명,거래수량,거래금액,외화거래금액,수수료,예수금잔고
2026.03.20,매수,가나,"1,000","1,250,050",0,"1,000",0
2026.03.21,자기융자매도상환,가나,3,100,0,x,0
2026.03.22,대금입금,,0,500,0,0,0
bad,매수,가나,1,1,0,0,0
2026.03.23,매수,가나,1.5,1,0,0,0
"""
SECOND = """거래일자,거래명,상품명,거래수량,거래단가/이율,거래금액,정산금액,현금잔액,수수료,잔고수량,평가금액
,,,,,,,,,,
2026-03-13,장내(매수),다라,10,"1,234","12,340",0,0,5,0,0
2026-03-13,매수취소,다라,10,1,1,0,0,0,0,0
2026-03-14,장내(매도),다라,0,1,1,0,0,0,0,0
"""


def test_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(FIRST.encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes(SECOND.encode("cp949"))
    (tmp_path / "c.csv").write_bytes(b"")
    rows = broker_csv.read_exports(spark, str(tmp_path)).orderBy("broker", "line").collect()
    assert [(r["name"], r["side"], r["price"], r["quantity"], r["fees"], r["account_type"]) for r in rows] == [
        ("가나", "buy", Decimal("1250.05"), 1000, Decimal("1000.00"), "매수"),
        ("가나", "sell", Decimal("33.33"), 3, Decimal("0.00"), "자기융자"),
        ("다라", "buy", Decimal("1234.00"), 10, Decimal("5.00"), "퇴직연금"),
    ]
    named = broker_csv.with_codes(broker_csv.read_exports(spark, str(tmp_path)), spark.createDataFrame([("가나", "000001")], "name string, code string"))
    assert {(r["name"], r["symbol"]) for r in named.collect()} == {("가나", "000001"), ("다라", "")}


def test_json_lines_skip_broken_ones(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1}\n{broken\n{"id": 3}\n')
    got = files.read_json_lines(spark, str(tmp_path / "x.json"), T.StructType([T.StructField("id", T.LongType())]))
    assert sorted(r["id"] for r in got.collect()) == [1, 3]


def test_upsert_takes_nulls_of_a_telling_row(spark):
    schema = "broker string, report_date date, analyst string, stock_name string, title_normalized string, pdf_url string, opinion string, target_price long, raw_text string, source_channel string"
    stored = spark.createDataFrame([("b", None, None, "s", "t", "url", None, 5, "r", "c"), ("b", None, None, "s", "u", None, "매수", 7, "r", "c")], schema)
    incoming = spark.createDataFrame(
        [("b", None, None, "s", "t", None, "매도", None, "r2", "c", 1), ("b", None, None, "s", "u", None, None, 9, "r2", "c", 2), ("b", None, None, "s", "new", None, None, 1, "r", "c", 3), ("b", None, None, "s", "new", "x", None, 2, "r", "c", 4), ("b", None, None, "s", "", "x", None, 2, "r", "c", 5)],
        schema + ", seq long",
    )
    got = {r["title_normalized"]: r for r in u.upsert_reports(stored, incoming).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"t": "updated", "u": "skipped", "new": "inserted"}
    assert (got["t"]["pdf_url"], got["t"]["opinion"], got["t"]["target_price"]) == (None, "매도", None)
    assert (got["u"]["opinion"], got["u"]["target_price"]) == ("매수", 7)
    assert (got["new"]["pdf_url"], got["new"]["target_price"]) == ("x", 2)
    kept = {r["title_normalized"]: r for r in u.upsert_reports(stored, incoming, preserve_existing=True).collect()}
    assert (kept["t"]["pdf_url"], kept["t"]["target_price"]) == ("url", 5)


def test_ingest_stream_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    rows = [("@c", 1, "LG(003550) title here 키움증권 목표가 90,000원 HOLD"), ("@c", 1, "LG(003550) title here 키움증권 목표가 90,000원 HOLD"), ("@c", 2, "hm"), ("@d", 3, "LG(003550) other title 키움증권")]
    df = spark.createDataFrame(rows, "channel string, message_id long, text string")
    df.write.parquet(str(source))
    active = lambda s: s.createDataFrame([("@c",)], "channel string")
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(source))
        ingest.start_ingest(stream, str(target), str(tmp_path / "cp"), active).awaitTermination()
    got = spark.read.parquet(str(target)).groupBy("branch").agg(F.count("*").alias("n")).collect()
    assert {r["branch"]: r["n"] for r in got} == {"report": 1, "pending": 1}


def test_later_batches_drop_known_messages_and_upsert_reports(spark, tmp_path):
    schema = "channel string, message_id long, text string, posted_at timestamp_ntz"
    source, target, reports = (str(tmp_path / n) for n in ("in", "out", "reports"))
    first = "LG(003550) title here 키움증권 목표가 90,000원 HOLD"
    batches = [
        [("@c", 1, first), ("@c", 1, first), ("@c", 2, "LG(003550) other title 키움증권 목표가 1,000원"), ("@c", 4, "hm")],
        [("@c", 1, first), ("@c", 4, "hm"), ("@d", 1, "SK(034730) a third title 하나증권 매수"), ("@c", 9, "LG(003550) title here 키움증권 목표가 95,000원 BUY"), ("@c", 10, "LG(003550) other title 키움증권 목표가 2,000원")],
        [],
        [("@d", 1, "SK(034730) a third title 하나증권 매수")],
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("posted_at", F.lit("2024-01-02 10:00:00").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        ingest.start_ingest(stream, target, str(tmp_path / "cp"), reports=reports).awaitTermination()
    stored = spark.read.parquet(target)
    assert sorted((r["channel"], r["message_id"]) for r in stored.collect()) == [("@c", 1), ("@c", 2), ("@c", 4), ("@c", 9), ("@c", 10), ("@d", 1)]
    told = {r["title"]: (r["target_price"], r["opinion"], str(r["report_date"])) for r in ingest.stored_reports(spark, reports).collect()}
    assert len(told) == 5 and told["LG(003550) title here 키움증권 목표가 95,000원 BUY"] == (95000, "매수", "2024-01-02")
    again = ingest.stored_reports(spark, reports).count()
    ingest.upsert_batch(stored.filter("batch = 1 and branch = 'report'"), reports, 1)  # a batch that runs twice
    assert ingest.stored_reports(spark, reports).count() == again


def test_upserts_of_one_report_in_two_batches(spark, tmp_path):
    schema = "channel string, message_id long, block_no int, body string, broker string, analyst string, stock_name string, title_normalized string, title string, stock_code string, pdf_url string, opinion string, target_price long"
    row = lambda k, opinion, price, name="s": ("@c", k, 0, "b", "KB증권", None, name, "t", "T", "000001", None, opinion, price)
    path = str(tmp_path / "reports")
    for number, rows in enumerate([[row(1, None, 5), row(2, "매수", 6), row(3, None, 1, "other")], [row(4, None, 9), row(5, None, 2, "other"), row(6, "매도", 3, "new")]]):
        for _ in range(2):  # each batch runs twice
            ingest.upsert_batch(spark.createDataFrame(rows, schema), path, number)
    got = {r["stock_name"]: (r["opinion"], r["target_price"]) for r in ingest.stored_reports(spark, path).collect()}
    assert got == {"s": ("매수", 6), "other": (None, 1), "new": ("매도", 3)}
    assert ingest.report_table(spark, path).state()["number"] == 1


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("b1", ["report-1", "report-2", "x"]), ("b2", ["report-2"])], "batch_id string, custom_ids array<string>")
    path = str(tmp_path / "spool")
    for _ in range(2):
        files.append_json_lines(rows.filter("batch_id = 'b1'"), path)
    files.append_json_lines(rows.filter("batch_id = 'b2'"), path)
    spool = files.read_json_lines(spark, path, rows.schema)
    assert spool.count() == 3 and sorted(r["id"] for r in files.spooled_ids(spool).collect()) == [1, 2]
    assert [r["batch_id"] for r in files.without_batch(spool, "b1").collect()] == ["b2"]
    told = spark.createDataFrame([(1, "가", "miss"), (2, "나", "diff"), (3, None, "diff")], "id long, title string, class string")
    files.write_classes_for_spreadsheets(told.coalesce(1), str(tmp_path / "csv"))
    texts = {p.parent.name: p.read_bytes() for p in (tmp_path / "csv").glob("class=*/*.csv")}
    assert set(texts) == {"class=miss", "class=diff"} and all(x.startswith("\ufeffid,title".encode()) for x in texts.values())
    back = files.read_reports_csv(spark, str(tmp_path / "csv/class=diff"), T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())]))
    assert sorted((r["id"], r["title"]) for r in back.collect()) == [(2, "나"), (3, None)]
    files.append(told, str(tmp_path / "t"))
    files.append(told, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    (tmp_path / "pdf" / "2024").mkdir(parents=True)
    (tmp_path / "pdf" / "2024" / "a.pdf").write_bytes(b"x")
    paths = spark.createDataFrame([("2024/a.pdf",), ("2024/b.pdf",)], "path string")
    assert [r["path"] for r in files.with_existing_file(paths, str(tmp_path / "pdf")).collect()] == ["2024/a.pdf"]
    seed = [("000001", "seed")]
    assert [r["name"] for r in files.master_data(spark, str(tmp_path / "none"), "code string, name string", seed).collect()] == ["seed"]
    spark.createDataFrame([("1", "loaded")], "code string, name string").write.parquet(str(tmp_path / "codes"))
    assert [r["name"] for r in files.master_data(spark, str(tmp_path / "codes"), "code string, name string", seed).collect()] == ["loaded"]
    messages = spark.createDataFrame([("a", k) for k in range(1, 6)] + [("b", 7)], "channel string, message_id long")
    cursors = spark.createDataFrame([("a", 3, 2)], "channel string, last_message_id long, first_message_id long")
    assert [tuple(r) for r in files.messages_after(messages, cursors).collect()] == [("a", 4), ("a", 5), ("b", 7)]
    assert [tuple(r) for r in files.messages_before(messages, cursors).collect()] == [("a", 1), ("b", 7)]


def test_import_of_results(spark, tmp_path):
    good = '{"report_category": "stock", "chain": [], "thesis": {"summary": "s", "sentiment": 0.5}, "extraction_quality": "high", "other": 1}'
    lines = [(1, "report-1", "bad", False), (2, "report-1", good, False), (3, "report-2", good, True), (4, "x", good, False), (5, "report-3", "bad", None)]
    clean = payloads.imported_results(spark.createDataFrame(lines, "line long, custom_id string, payload string, truncated boolean"))
    assert {r["report_id"]: r["reject_reason"] for r in clean.collect()} == {1: None, 2: None, 3: "json_parse_failed"}
    stored = {r["report_id"]: r for r in payloads.stored_documents(clean).collect()}
    assert {k: d["extraction_quality"] for k, d in stored.items()} == {1: "high", 2: "truncated"}
    document = stored[1]["document"].toPython()
    assert document["thesis"] == {"summary": "s", "sentiment": 0.5} and "other" not in document and document["meta"] == {}


def test_imported_document_is_whole(spark, tmp_path):
    told = {
        "report_category": "Stock",
        "category_confidence": "0.7",
        "secondary_category": "industry",
        "target": {"price": 85000, "previous": None},
        "opinion": None,
        "chain": {"step": "valuation_impact", "text": "1,200 \"more\""},
        "financials": {"key_metrics": {"PER": "12.5"}, "years": [2024, {"e": 2025}]},
        "meta": {"title": "제목", "broker": "KB증권"},
        "stock_mentions": [{"company_name": "가나", "mention_type": "primary", "impact": "positive", "relevance_score": 0.9}, "x", {"stock_code": "000001"}, {"mention_type": "primary"}],
        "sector_mentions": [{"sector": "반도체", "mention_type": "primary", "impact": "mixed"}, {"sector": ""}],
        "keywords": [{"keyword": "k", "keyword_type": "product"}, 5],
    }
    clean = payloads.sanitized(spark.createDataFrame([(7, json.dumps(told, ensure_ascii=False))], "report_id long, payload string"))
    payloads.stored_documents(clean).write.parquet(str(tmp_path / "analyses"))
    stored = spark.read.parquet(str(tmp_path / "analyses"))
    read = stored.select(F.try_variant_get("document", "$.meta.title", "string").alias("title"), F.try_variant_get("document", "$.chain[0].step", "string").alias("step"), "*").first()
    assert (read["title"], read["step"], read["report_category"]) == ("제목", "valuation_impact", "stock")
    kept = {k: told[k] for k in ("target", "opinion", "financials", "meta", "secondary_category")}
    assert json.loads(read["document"].toJson()) == kept | {"chain": [told["chain"]], "thesis": {"summary": "", "sentiment": 0.0}, "category_confidence": 0.7}
    assert [tuple(m) for m in read["stock_mentions"]] == [("가나", None, "primary", "positive", 0.9)] and [tuple(m) for m in read["sector_mentions"]] == [("반도체", "primary", "mixed")]
    reasons = [(c["field"], c["reason"]) for c in clean.first()["corrections"]]
    assert reasons == [
        ("report_category", "lowercased"),
        ("chain", "dict_wrapped_in_list"),
        ("stock_mentions[item]", "dropped_non_dict"),
        ("stock_mentions[item]", "dropped_missing_mention_type"),
        ("stock_mentions[item]", "dropped_missing_company_name"),
        ("stock_mentions", "items_dropped_missing_required_fields"),
        ("sector_mentions[item]", "dropped_missing_sector"),
        ("sector_mentions", "items_dropped_missing_required_fields"),
        ("keywords[item]", "dropped_non_dict"),
        ("keywords", "items_dropped_missing_required_fields"),
        ("thesis", "defaulted_missing_or_non_dict"),
    ]


def test_page_signals_and_samples(spark):
    pages = spark.sql("""SELECT 1 AS doc_id, 0 AS page_idx, 10D AS width, 20D AS height, array(named_struct('x0', 0D, 'y0', 0D, 'x1', 5D, 'y1', 10D, 'text', 'a'), named_struct('x0', 0D, 'y0', 0D, 'x1', 9D, 'y1', 9D, 'text', ' ')) AS blocks,
      array(named_struct('x0', 1D, 'x1', 6D)) AS images UNION ALL SELECT 1, 1, 0D, 0D, array(), array()""")
    got = [(r["text_coverage"], r["largest_image_ratio"]) for r in page_selection.page_signals(pages).orderBy("page_idx").collect()]
    assert got == [(0.25, 0.5), (0.0, 0.0)]
    rows = spark.range(1000)
    sample = [r["id"] for r in worklists.seeded_sample(rows, 10, 3, ["id"]).collect()]
    assert sample == [r["id"] for r in worklists.seeded_sample(rows.repartition(7), 10, 3, ["id"]).collect()] and len(set(sample)) == 10
    assert sample != [r["id"] for r in worklists.seeded_sample(rows, 10, 4, ["id"]).collect()]
    document = "named_struct('thesis', named_struct('summary', 'a'), 'chain', array(named_struct('text', 'b'), named_struct('text', 'c')), 'financials', named_struct('key_metrics', map('k', 'd')))"
    assert spark.range(1).selectExpr(f"{document} AS d").select(grounding.document_text("d").alias("t")).first()["t"] == "a b c d"


def test_streams_end_in_files(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    events = spark.range(50).selectExpr("id % 40 AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 40 AS int)) AS ts", "id % 3 AS user_id", "'view' AS event_type", "1.5D AS value")
    events.coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "events.parquet")
    found = plans.stream_dedup(spark, str(tmp_path))
    assert found.inputFiles() and sorted(map(tuple, found.collect())) == [(k, "view") for k in range(3)]
    days = plans.stream_daily_counts(spark, str(tmp_path))
    assert days.inputFiles() and sorted((r["day"].toordinal() - 738886, r["n"], r["value"]) for r in days.collect()) == [(k, 2, 3.0) if k < 10 else (k, 1, 1.5) for k in range(40)]
    assert plans.stream_sessions(spark, str(tmp_path)).inputFiles()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider


def test_streams_read_all_part_files(spark, tmp_path):
    """120 files that are not in order of time, each event twice."""
    events = spark.range(480).selectExpr("id % 240 AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast((id % 240) * 7 % 240 AS int)) AS ts", "id % 240 % 5 AS user_id", "'view' AS event_type", "1.5D AS value")
    events.repartition(120).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 100
    assert sorted(map(tuple, plans.stream_dedup(spark, str(tmp_path)).collect())) == [(k, "view") for k in range(5)]
    days = plans.stream_daily_counts(spark, str(tmp_path)).collect()
    assert len(days) == 240 and {(r["n"], r["value"]) for r in days} == {(2, 3.0)}
    sessions = plans.stream_sessions(spark, str(tmp_path)).collect()
    assert len(sessions) == 240 and {r["n"] for r in sessions} == {2}


def test_number_grounding_of_whole_texts(spark, tmp_path):
    documents = [(1, "word " * 400 + "1,234 and 55", "en"), (2, "short 77", "en"), (3, None, "ko"), (4, "88 stands alone", None)]
    turns = [(1, 0, "user", "of 55 or 66"), (1, 1, "assistant", "x " * 800 + "1234, 55, 66 and 99"), (2, 0, "assistant", "77"), (2, 1, "assistant", "78 5"), (3, 0, "assistant", "12.5"), (3, 1, None, "12.5")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    numbers = lambda texts: {n.replace(",", "") for n in re.findall(r"[0-9][0-9,]*(?:[.][0-9]+)?", " ".join(texts)) if len(re.sub("[^0-9]", "", n)) >= 2}
    expected = {}
    for doc, text, lang in documents:
        analysis, charts = (numbers([x for c, _, role, x in turns if c == doc and (role == "assistant") == own]) for own in (True, False))
        body = numbers([text or ""])
        row = expected.setdefault(lang or "unknown", [0] * 6)
        parts = (len(analysis), len(analysis & body - charts), len(analysis & charts - body), len(analysis & body & charts), len(analysis - body - charts))
        row[:] = [a + b for a, b in zip(row, (1, *parts), strict=True)]
    found = {r["report_type"]: r for r in plans.number_grounding(spark, str(tmp_path)).collect()}
    assert set(found) == set(expected) and expected["en"] == [2, 6, 2, 1, 1, 2]
    for kind, (n, total, *parts) in expected.items():
        r = found[kind]
        assert (r["n_reports"], r["layer2_total"]) == (n, total)
        assert [r[f"{p}_pct"] for p in ("md_only", "chart_only", "both", "neither")] == [round(100 * p / total, 2) if total else 0.0 for p in parts]
