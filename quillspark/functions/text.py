"""Text columns: names, titles, codes, tokens, links, prices. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, down to REPORT_PAGE: aliases of brokers and opinions, units, token patterns, hosts, failures that last, addresses.
BROKER_ALIASES = {
    "미래에셋": "미래에셋증권",
    "미래에셋대우": "미래에셋증권",
    "한투": "한국투자증권",
    "한국투자": "한국투자증권",
    "KB": "KB증권",
    "KB금융": "KB증권",
    "NH": "NH투자증권",
    "NH투자": "NH투자증권",
    "삼성": "삼성증권",
    "하나": "하나증권",
    "하나금융": "하나증권",
    "메리츠": "메리츠증권",
    "신한": "신한투자증권",
    "신한금융": "신한투자증권",
    "대신": "대신증권",
    "키움": "키움증권",
    "유진": "유진투자증권",
    "이베스트": "이베스트투자증권",
    "교보": "교보증권",
    "흥국": "흥국증권",
    "현대차": "현대차증권",
    "SK": "SK증권",
    "LS": "LS증권",
    "BNK": "BNK투자증권",
    "한화": "한화투자증권",
    "부국": "부국증권",
    "DB": "DB금융투자",
    "IBK": "IBK투자증권",
}
OPINION_ALIASES = {
    "BUY": "매수",
    "buy": "매수",
    "Buy": "매수",
    "강력매수": "매수",
    "HOLD": "중립",
    "hold": "중립",
    "Hold": "중립",
    "보유": "중립",
    "SELL": "매도",
    "sell": "매도",
    "Sell": "매도",
    "비중확대": "비중확대",
    "Overweight": "비중확대",
    "OW": "비중확대",
    "비중축소": "비중축소",
    "Underweight": "비중축소",
    "UW": "비중축소",
    "Trading Buy": "Trading Buy",
    "시장수익률": "중립",
    "시장수익률상회": "비중확대",
    "시장수익률하회": "비중축소",
}
PRICE_UNITS = {"만": 10_000, "억": 100_000_000}
CHAT_HOSTS = ("t.me", "telegram.me")
TOKEN_BREAKS = r"[\s,.!?()\[\]]+"
NUMBER_TOKEN = r"(?U)\b\d{1,3}(?:,\d{3})+(?:\.\d+)?|\b\d+\.\d+|\b\d{2,}\b"
SHORT_HOSTS = ("bit.ly", "tinyurl.com", "goo.gl", "is.gd", "t.co", "buly.kr", "naver.me", "stockinfo7.com", "www.stockinfo7.com")
DRIVE_HOST, UNSUPPORTED_HOST = "drive.google.com", "t.me"
LASTING_FAILURES, LASTING_PREFIX = ("http_404", "http_410", "not_pdf:html_response", "not_pdf", "no_url"), "unsupported_host:"
REPORT_PAGE = "https://stockinfo7.com/stock/report/url/"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends; trim alone takes spaces only."""
    return F.regexp_replace(F.regexp_replace(_column(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def alias(c: Column | str, names: dict[str, str]) -> Column:
    """Stripped, and renamed where a name is known."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    bare = strip(c)
    return F.coalesce(F.try_element_at(known, bare), bare)


def normalize_broker(c: Column | str) -> Column:
    return alias(c, BROKER_ALIASES)


def normalize_opinion(c: Column | str) -> Column:
    return alias(c, OPINION_ALIASES)


def normalize_title(c: Column | str) -> Column:
    """Hangul syllables, Latin letters and digits in lower case."""
    return F.lower(F.regexp_replace(_column(c), "[^가-힣a-zA-Z0-9]", ""))


def normalize_stock_name(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), r"(?U)[\s()（）㈜·\-]", "")


def normalize_stock_code(c: Column | str) -> Column:
    """Leading letters off, zeros in front up to six characters; longer codes stay; empty gives null."""
    bare = F.regexp_replace(strip(c), r"^\p{L}+", "")
    padded = F.when(F.length(bare) < 6, F.lpad(bare, 6, "0")).otherwise(bare)
    return F.when(strip(c) != "", padded)


def parse_price(c: Column | str) -> Column:
    """First number with its unit, as a whole number cut towards zero; null without one."""
    bare = F.regexp_replace(_column(c), "[, ]", "")
    pattern = "([0-9]+(?:\\.[0-9]+)?)(만|억)?"
    number = F.regexp_extract(bare, pattern, 1).try_cast("double")
    unit = F.regexp_extract(bare, pattern, 2)
    factor = F.lit(1)
    for name, value in PRICE_UNITS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return (number * factor).try_cast("bigint")


def cut_to(c: Column | str, length: int) -> Column:
    return F.substring(_column(c), 1, length)


def username(c: Column | str) -> Column:
    """``@name`` from a channel link or a name with or without the sign."""
    bare = F.rtrim(strip(c), F.lit("/"))
    linked = F.regexp_extract(bare, r"^.*t\.me/([^/?]*)", 1)
    return F.concat(F.lit("@"), F.ltrim(F.when(bare.contains("t.me/"), linked).otherwise(bare), F.lit("@")))


def tokens(c: Column | str, shortest: int = 2) -> Column:
    """Parts between breaks that are ``shortest`` characters long at least."""
    return F.filter(F.split(_column(c), TOKEN_BREAKS), lambda t: F.length(t) >= shortest)


def hangul_keywords(c: Column | str, most: int = 20) -> Column:
    """The first distinct all-Hangul tokens."""
    return F.slice(F.array_distinct(F.filter(tokens(c), lambda t: t.rlike("^[가-힣]+$"))), 1, most)


def six_digit_codes(c: Column | str) -> Column:
    """Words of six digits; one that touches a letter of any script is none."""
    return F.regexp_extract_all(_column(c), F.lit(r"(?U)\b(\d{6})\b"), F.lit(1))


def number_tokens(c: Column | str) -> Column:
    """Distinct numbers of two digits at least, without thousands commas."""
    found = F.transform(F.regexp_extract_all(_column(c), F.lit(NUMBER_TOKEN), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.array_distinct(F.filter(found, lambda n: F.length(F.regexp_replace(n, r"\.", "")) >= 2))


def digest_blocks(c: Column | str) -> Column:
    """Parts of a digest message that hold an arrow; a message with one arrow or none is one part."""
    text = _column(c)
    parts = F.filter(F.split(text, r"\n+(?=\*?\*?\s*[▶►])"), lambda b: b.rlike("[▶►]"))
    return F.when(F.regexp_count(text, F.lit("[▶►]")) > 1, F.transform(parts, strip)).otherwise(F.array(text))


def without_bold(c: Column | str) -> Column:
    return F.replace(_column(c), F.lit("**"), F.lit(""))


def safe_filename(c: Column | str, most: int = 20) -> Column:
    """Characters that file names cannot hold, and white space, become single underscores."""
    cleaned = F.regexp_replace(F.regexp_replace(_column(c), r'(?U)[\\/:*?"<>|\s]', "_"), "_+", "_")
    return F.substring(F.btrim(cleaned, F.lit("_")), 1, most)


def archive_path(day, broker, stock_name, sector, title) -> Column:
    """year/month/day_broker_subject_title.pdf; the subject is the stock, else the sector."""
    when = _column(day)
    subject = F.coalesce(safe_filename(blank_to_null(stock_name), 10), F.concat(F.lit("산업_"), safe_filename(blank_to_null(sector), 10)), F.lit("기타"))
    house = safe_filename(F.coalesce(blank_to_null(broker), F.lit("Unknown")), 10)
    file = F.concat_ws("_", F.date_format(when, "yyyyMMdd"), house, subject, safe_filename(title, 30))
    return F.concat_ws("/", F.date_format(when, "yyyy"), F.date_format(when, "MM"), F.concat(file, F.lit(".pdf")))


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(_column(c)) * 2 / 3).cast("bigint")


def is_continuation(c: Column | str) -> Column:
    return _column(c).startswith("(Continuing")


def quality_flag(c: Column | str) -> Column:
    """truncated (ends on dots), long (over 3,500 characters), short (under 30) or ok."""
    text = _column(c)
    return F.when(F.regexp_replace(text, r"(?U)\s+$", "").rlike("(\\.\\.\\.|…)$"), "truncated").when(F.length(text) > 3500, "long").when(F.length(text) < 30, "short").otherwise("ok")


def digit_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_column(c), "[^0-9]", "")).cast("bigint")


def table_rows(c: Column | str) -> Column:
    """Lines of a pipe table."""
    return F.regexp_count(_column(c), F.lit(r"(?m)^\s*\|.*\|\s*$")).cast("bigint")


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(_column(url), F.lit("HOST")))


def url_kind(url: Column | str) -> Column:
    """direct, short_url, google_drive or unsupported, by the host."""
    h = F.coalesce(host(url), F.lit(""))
    return F.when(h == UNSUPPORTED_HOST, "unsupported").when(h.isin(*SHORT_HOSTS), "short_url").when(h.contains(DRIVE_HOST), "google_drive").otherwise("direct")


def drive_id(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_column(url), "/file/d/([a-zA-Z0-9_-]+)", 1), F.lit(""))


def viewer_target(url: Column | str) -> Column:
    """The address that a document viewer shows, percent-decoded; null for other pages."""
    u = _column(url)
    shown = host(u).contains("docs.google.com") & F.try_parse_url(u, F.lit("PATH")).contains("/viewer")
    return F.when(shown, F.try_url_decode(F.try_parse_url(u, F.lit("QUERY"), F.lit("url"))))


def links(html: Column | str) -> Column:
    return F.regexp_extract_all(_column(html), F.lit("""href\\s*=\\s*["']([^"']+)["']"""), F.lit(1))


def pdf_link(html: Column | str) -> Column:
    """The first address of a PDF, unwrapped from a viewer; else the report page that the HTML names."""
    text = _column(html)
    found = F.filter(F.regexp_extract_all(text, F.lit("""(?i)https?://[^\\s"'<>]+\\.pdf[^\\s"'<>]*"""), F.lit(0)), lambda u: viewer_target(u).isNotNull() | (F.coalesce(host(u), F.lit(UNSUPPORTED_HOST)) != UNSUPPORTED_HOST))
    first = F.get(found, F.lit(0))
    page = F.nullif(F.regexp_extract(text, r"/stock/report/url/(\d+)", 1), F.lit(""))
    return F.coalesce(viewer_target(first), first, F.concat(F.lit(REPORT_PAGE), page))


def urls(c: Column | str, pattern: str = r"https?://\S+") -> Column:
    return F.regexp_extract_all(_column(c), F.lit(pattern), F.lit(0))


def first_outside_url(c: Column | str, pattern: str = r"https?://\S+") -> Column:
    """The first address whose host is no chat host."""
    return F.get(F.filter(urls(c, pattern), lambda u: ~F.coalesce(F.lower(F.regexp_extract(u, r"^https?://(?:[^/@\s]*@)?([^/:?#\s]*)", 1)), F.lit("")).isin(*CHAT_HOSTS)), F.lit(0))


def chat_message_links(c: Column | str) -> Column:
    return urls(c, r"https?://(?:t\.me|telegram\.me)/[a-zA-Z_]\w+/\d+")


def retryable(reason: Column | str) -> Column:
    """Whether a failed download may be tried again."""
    r = _column(reason)
    return ~r.isin(*LASTING_FAILURES) & ~r.startswith(LASTING_PREFIX)


def failure_detail(attempts: Column | str) -> Column:
    """What was tried, in order; unknown if nothing was."""
    return F.coalesce(F.nullif(F.array_join(_column(attempts), " | "), F.lit("")), F.lit("unknown"))


def review_link(channel: Column | str, message_id: Column | str) -> Column:
    return F.concat(F.lit("https://t.me/"), F.ltrim(_column(channel), F.lit("@")), F.lit("/"), _column(message_id).cast("string"))


def fenced_json(c: Column | str) -> Column:
    """VARIANT of the JSON in a text: a json fence, any fence, the whole text, then the outer braces."""
    text = _column(c)
    return F.coalesce(
        F.try_parse_json(F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1)),
        F.try_parse_json(F.regexp_extract(text, r"(?s)```\s*(.*?)```", 1)),
        F.try_parse_json(text),
        F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)),
    )


def page_content(body: Column | str, charts: Column | str) -> Column:
    """Body and chart blocks under headers; empty ones are left out."""
    chart_text = blank_to_null(F.array_join(_column(charts), "\n\n"))
    return F.concat_ws("\n\n", F.concat(F.lit("## Body\n"), blank_to_null(body)), F.concat(F.lit("## Charts\n"), chart_text))
