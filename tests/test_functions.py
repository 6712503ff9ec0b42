from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates as d
from quillspark.functions import messages as m
from quillspark.functions import money, payloads
from quillspark.functions import text as t
from quillspark.operators import upserts

L = F.lit
CASES = [
    (lambda: t.normalize_broker(L(" KB ")), "KB증권"),
    (lambda: t.normalize_opinion(L("Overweight")), "비중확대"),
    (lambda: t.normalize_title(L("삼성 AB-12!")), "삼성ab12"),
    (lambda: t.normalize_stock_name(L("(주) 삼성 · 전자")), "주삼성전자"),
    (lambda: t.normalize_stock_code(L(" A5930 ")), "005930"),
    (lambda: t.normalize_stock_code(L("1234567")), "1234567"),
    (lambda: t.normalize_stock_code(L("  ")), None),
    (lambda: t.parse_price(L("8.5만")), 85000),
    (lambda: t.parse_price(L("1.2억")), 120_000_000),
    (lambda: t.parse_price(L("none")), None),
    (lambda: t.username(L("https://t.me/foo/12?x=1")), "@foo"),
    (lambda: t.username(L("@foo/")), "@foo"),
    (lambda: t.number_tokens(L("1,000원 2.5배 7 25 25")), ["1000", "2.5", "25"]),
    (lambda: t.digest_blocks(L("head\n\n▶ a\nx\n▶ b")), ["▶ a\nx", "▶ b"]),
    (lambda: t.safe_filename(L(" a/b  c:d ")), "a_b_c_d"),
    (lambda: t.url_kind(L("https://t.me/x/1")), "unsupported"),
    (lambda: t.url_kind(L("https://bit.ly/x")), "short_url"),
    (lambda: t.drive_id(L("https://drive.google.com/file/d/AbC/view")), "AbC"),
    (lambda: t.first_outside_url(L("https://t.me/ab/1 https://x.com/b")), "https://x.com/b"),
    (lambda: t.quality_flag(L("a" * 40 + "... ")), "truncated"),
    (lambda: t.retryable(L("unsupported_host:x")), False),
    (lambda: t.token_estimate(L("abcd")), 2),
    (lambda: money.fee_share(L("10.00").cast("decimal(14,2)"), L(1), L(3)), Decimal("3.33")),
    (lambda: money.unit_price(L("0.25").cast("decimal(14,2)"), L(2)), Decimal("0.12")),
    (lambda: money.export_quantity(L("1,200")), 1200),
    (lambda: money.export_quantity(L("1.5x")), None),
    (lambda: money.export_number(L("bad")), Decimal("0.00")),
    (lambda: d.first_day_in_text(L("x 2019-01-01 2024.3.5 2023년 1월 2일"), L("2025-01-01").cast("date")), date(2024, 3, 5)),
    (lambda: d.week_end(L("2024-01-06").cast("date")), date(2024, 1, 12)),
    (lambda: d.last_business_day(L("2024-01-07").cast("date")), date(2024, 1, 5)),
    (lambda: payloads.report_id_of(L("report-12")), 12),
    (lambda: money.unit_interval(L("1.5"), 0.5), 1.0),
    (lambda: money.unit_interval(L("x"), 0.5), 0.5),
    (lambda: d.day_gap(L("2024-01-06").cast("date"), L("2024-01-09").cast("date")), 3),
    (lambda: d.preferred_day(L(None).cast("date"), L("2024-01-09")), date(2024, 1, 9)),
    (lambda: d.preferred_day(L("2024-01-08").cast("date"), L("2024-01-09")), date(2024, 1, 8)),
    (lambda: t.cut_to(L("abcdef"), 3), "abc"),
    (lambda: t.archive_path(L("2024-03-05").cast("date"), L("KB증권"), L("삼성 전자"), L("x"), L("a/b")), "2024/03/20240305_KB증권_삼성_전자_a_b.pdf"),
    (lambda: t.archive_path(L("2024-03-05").cast("date"), L(" "), L(None), L("반도체"), L("t")), "2024/03/20240305_Unknown_산업_반도체_t.pdf"),
    (lambda: t.pdf_link(L('<a href="https://docs.google.com/viewer?url=https%3A%2F%2Fx.com%2Fa.pdf">')), "https://x.com/a.pdf"),
    (lambda: t.pdf_link(L("/stock/report/url/77")), t.REPORT_PAGE + "77"),
    (lambda: t.review_link(L("@room"), L(5)), "https://t.me/room/5"),
    (lambda: F.to_json(t.fenced_json(L('so:\n```json\n{"a": 1}\n```'))), '{"a":1}'),
    (lambda: F.to_json(t.fenced_json(L('so {"a": 2} it is'))), '{"a":2}'),
    (lambda: t.fenced_json(L("none")).cast("string"), None),
    (lambda: t.page_content(L("text"), F.array(L("c1"), L("c2"))), "## Body\ntext\n\n## Charts\nc1\n\nc2"),
    (lambda: t.page_content(L(" "), F.array().cast("array<string>")), ""),
    (lambda: t.failure_detail(F.array(L("a"), L("b"))), "a | b"),
    (lambda: upserts.merged_value(L(" "), L("old")), "old"),
    (lambda: upserts.merged_value(L("new"), L("old")), "new"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_value(spark, k):
    make, expected = CASES[k]
    assert spark.range(1).select(make().alias("x")).first()["x"] == expected


def test_messages(spark):
    told = [
        (m.DIGEST_CHANNEL, 1, "▶ 삼성전자(005930) 반도체 업황 개선 - 미래에셋증권\n- 목표가: 80,000원 → 85,000원 (매수)\nhttps://x.com/a.pdf"),
        (m.DIGEST_CHANNEL, 2, "오늘\n\n▶ 반도체 산업 점검 - KB증권 홍길동\n▶ LG(003550) 지주 - 하나증권 <link>"),
        ("x", 3, "LG(003550) title here 키움증권 목표가 90,000원 HOLD https://t.me/ab/1"),
        ("x", 4, "(Continuing"),
        ("x", 5, None),
        ("x", 6, ""),
    ]
    rows = {(r["message_id"], r["block_no"]): r for r in m.parse_messages(spark.createDataFrame(told, "channel string, message_id long, text string")).collect()}
    assert set(rows) == {(1, 0), (2, 0), (2, 1), (3, 0)}
    first = rows[1, 0]
    assert (first["stock_code"], first["prev_target_price"], first["target_price"], first["opinion"], first["broker"], first["quality"]) == ("005930", 80000, 85000, "매수", "미래에셋증권", "good")
    assert rows[2, 0]["analyst"] == "홍길동"
    assert (rows[3, 0]["opinion"], rows[3, 0]["pdf_url"], rows[3, 0]["chat_links"]) == ("중립", None, ["https://t.me/ab/1"])


def test_payloads(spark):
    told = [
        (1, '{"report_category": "종목", "category_confidence": 3, "chain": {"step": "a"}, "stock_mentions": [{"company_name": "x", "mention_type": "primary"}, {"company_name": ""}], "keywords": [{"keyword": "k"}, 5], "thesis": {"summary": "s", "sentiment": 0.5}, "meta": {}, "extraction_quality": "HIGH"}'),
        (2, "not json"),
        (3, '{"report_category": "x", "chain": []}'),
        (4, '{"report_category": "stock"}'),
        (5, None),
        (6, '{"report_category": "macro", "chain": [], "keywords": {}}'),
    ]
    rows = {r["report_id"]: r for r in payloads.sanitized(spark.createDataFrame(told, "report_id long, payload string")).collect()}
    assert [rows[k]["reject_reason"] for k in range(1, 7)] == [None, "json_parse_failed", "invalid_report_category", "missing_chain", "json_parse_failed", "keywords_not_list"]
    good = rows[1]
    assert (good["report_category"], good["category_confidence"], good["extraction_quality"], good["thesis_sentiment"]) == ("stock", 1.0, "high", 0.5)
    assert len(good["stock_mentions"]) == 1
    assert {c["reason"] for c in good["corrections"]} >= {"korean_mapped", "clamped_0_1", "dict_wrapped_in_list", "items_dropped_missing_required_fields", "lowercased"}
