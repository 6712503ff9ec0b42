"""Research messages of chat channels as columns: header, broker, target price, opinion, analyst, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as t

# Broker names and message patterns of the channels.
DIGEST_CHANNEL, COMPANY_CHANNEL = "@repostory123", "@companyreport"
BROKER_NAMES = "미래에셋|한국투자|KB|NH|삼성|하나|메리츠|신한|대신|키움|유진|이베스트|교보|흥국|현대차|SK|LS|BNK|한화|부국|DB|IBK|유안타|하이|토러스|케이프|신영|한양|동부|리딩"
PLAIN_BROKERS = "미래에셋|한국투자|KB|NH|삼성|하나|메리츠|신한|대신|키움|유진|이베스트|교보|흥국|현대차|SK|LS|BNK|한화|DB|IBK"
STOCK_HEADER = r"(?m)[▶►*]*\s*(.+?)\((\d{6})\)\s*(.+?)\s*[-–]\s*(.+?)(?:\s*[\[<(]|$)"
INDUSTRY_HEADER = rf"(?m)[▶►*]*\s*(.+?)\s*[-–]\s*((?:{BROKER_NAMES})(?:증권|투자증권|금융투자)?.*?)(?:\s*[\[<(]|$)"
TARGET = r"목표가[:\s]*([0-9,]+)\s*원"
TARGET_CHANGE = r"목표가[:\s]*([0-9,]+)\s*원?\s*(?:→|->)+\s*([0-9,]+)\s*원"
OPINION_IN_TARGET = r"목표가[^(]*\(([^)]+)\)"
OPINION_LABELLED = r"투자의견[:\s]*(매수|중립|매도|비중확대|비중축소|Trading\s*Buy|BUY|HOLD|SELL)"
ANALYST = r"(?m)[-–]\s*\S+(?:증권|투자증권|금융투자)\s+([가-힣]{2,4})$"
STOCK_MENTION = r"([가-힣a-zA-Z]+)\((\d{6})\)"
OPINION_WORDS = r"(매수|중립|매도|비중확대|비중축소|Trading\s*Buy|BUY|HOLD|SELL)"
OPINION_WORDS_CASED = r"(매수|중립|매도|비중확대|비중축소|Trading\s*Buy|BUY|HOLD|SELL|Buy|Hold|Sell)"
PDF_URL = r"(?i)https?://\S+\.pdf[^\s)]*"
BARE_URL = r"https?://[^\s)\]>]+"
MACRO_TYPES = ("시황/전략", "채권/금리", "공모주", "매매동향", "경제/시황")


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def clean_broker(c: Column | str) -> Column:
    """Up to a bracket, then up to the word for a securities house, normalised."""
    bare = t.strip(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"^([^\[<(]*)", 1))
    return t.normalize_broker(F.coalesce(_group(bare, "^(.+?(?:증권|투자증권|금융투자))"), bare))


def _outside_pdf(c: Column) -> Column:
    first = F.nullif(F.regexp_extract(c, f"({PDF_URL})", 1), F.lit(""))
    own = F.lower(F.regexp_extract(first, r"^(?i)https?://([^/:?#\s]*)", 1))
    return F.when(first.isNotNull() & ~own.isin(*t.CHAT_HOSTS), first).otherwise(t.first_outside_url(c, BARE_URL))


def _fields(rows: DataFrame) -> DataFrame:
    """The told fields of each ``body`` by its ``dialect``: digest, company or general.

    Each pattern is searched once: what it matched is a column of its own, and groups are cut from that. Spark keeps such
    steps apart, since later columns use them several times.
    """
    digest = F.col("dialect") == "digest"
    clean = rows.withColumn("clean", F.when(digest, t.without_bold("body")).otherwise(F.col("body")))
    brokers = {"company": rf"(?:{PLAIN_BROKERS}|부국)\s*(?:증권|투자증권|금융투자)?", "general": rf"(?:{PLAIN_BROKERS})\s*증권?"}
    opinions = {"company": OPINION_WORDS_CASED, "general": OPINION_WORDS}

    def plain(patterns: dict[str, str], k: int) -> Column:
        return F.when(F.col("dialect") == "company", _group(F.col("body"), patterns["company"], k)).otherwise(_group(F.col("body"), patterns["general"], k))

    text, body = F.col("clean"), F.col("body")
    met = clean.withColumns(
        {
            "stock": F.when(digest, F.regexp_substr(text, F.lit(STOCK_HEADER))).otherwise(F.regexp_substr(text, F.lit(STOCK_MENTION))),
            "change": F.when(digest, F.regexp_substr(text, F.lit(TARGET_CHANGE))),
            "price": F.regexp_substr(body, F.lit(TARGET)),
            "told_opinion": F.when(digest, F.coalesce(_group(text, OPINION_IN_TARGET), _group(text, OPINION_LABELLED))).otherwise(plain(opinions, 1)),
        }
    )
    stock, change = F.col("stock"), F.col("change")
    headed = met.withColumn("industry", F.when(digest & stock.isNull(), F.regexp_substr(text, F.lit(INDUSTRY_HEADER))))
    industry = F.col("industry")
    house = F.when(~digest, plain(brokers, 0)).when(stock.isNotNull(), F.regexp_extract(stock, STOCK_HEADER, 4)).otherwise(F.regexp_extract(industry, INDUSTRY_HEADER, 2))
    named = headed.withColumn("house", house)
    title = F.when(stock.isNotNull(), F.regexp_extract(stock, STOCK_HEADER, 3)).otherwise(F.regexp_extract(industry, INDUSTRY_HEADER, 1))
    return named.withColumns(
        {
            "title": F.when(digest, t.blank_to_null(title)).otherwise(t.strip(F.regexp_extract(body, r"^([^\r\n]*)", 1))),
            "stock_name": F.when(digest, t.strip(F.regexp_extract(stock, STOCK_HEADER, 1))).otherwise(F.regexp_extract(stock, STOCK_MENTION, 1)),
            "stock_code": F.when(digest, F.regexp_extract(stock, STOCK_HEADER, 2)).otherwise(F.regexp_extract(stock, STOCK_MENTION, 2)),
            "broker": F.when(digest, clean_broker("house")).otherwise(t.normalize_broker("house")),
            "prev_target_price": t.parse_price(F.regexp_extract(change, TARGET_CHANGE, 1)),
            "target_price": F.when(change.isNotNull(), t.parse_price(F.regexp_extract(change, TARGET_CHANGE, 2))).otherwise(t.parse_price(F.regexp_extract("price", TARGET, 1))),
            "opinion": t.normalize_opinion("told_opinion"),
            "analyst": F.when(digest, _group(text, ANALYST)),
            "pdf_url": F.when(digest, _outside_pdf(body)).otherwise(t.first_outside_url(body)),
        }
    ).drop("clean", "stock", "change", "price", "told_opinion", "industry", "house", "dialect")


def parse_quality(broker: Column, title: Column, stock_name: Column, stock_code: Column, report_type: Column) -> Column:
    """good, partial (no stock and no macro topic) or poor (no broker or hardly a title)."""
    named = F.coalesce((t.strip(broker) != "") & (t.strip(broker) != "미상"), F.lit(False)) & F.coalesce(F.length(t.strip(title)) > 5, F.lit(False))
    about = F.coalesce(F.nullif(stock_name, F.lit("")), F.nullif(stock_code, F.lit(""))).isNotNull() | F.coalesce(report_type.isin(*MACRO_TYPES), F.lit(False))
    return F.when(~named, "poor").when(about, "good").otherwise("partial")


def parse_messages(messages: DataFrame) -> DataFrame:
    """(channel, message_id, text) -> one row for each report found; digests give several, empty messages none.

    Other columns of a message pass to its reports.
    """
    channel = F.lower("channel")
    is_digest = channel == DIGEST_CHANNEL
    blocks = F.when(is_digest, t.digest_blocks(F.col("text"))).otherwise(F.array("text"))
    rows = messages.select("*", F.posexplode(blocks).alias("block_no", "body"))
    rows = rows.withColumn("body", t.strip("body")).filter((F.col("body") != "") & ((channel == COMPANY_CHANNEL) | ~t.is_continuation("body")))
    dialect = F.when(is_digest, "digest").when(channel == COMPANY_CHANNEL, "company").otherwise("general")
    kept = [c for c in messages.columns if c != "text"]
    parsed = _fields(rows.select(*kept, "block_no", "body", dialect.alias("dialect")))
    graded = parsed.filter(F.col("title").isNotNull()).withColumn("title_normalized", t.normalize_title("title"))
    return graded.withColumn("chat_links", F.when(F.col("pdf_url").isNull(), t.chat_message_links("body"))).withColumn(
        "quality", parse_quality(F.col("broker"), F.col("title"), F.col("stock_name"), F.col("stock_code"), F.lit(None).cast("string"))
    )
