"""Trade exports of securities houses: bytes in, trade rows out.

Files come through Spark's binary reader, one task reading many small files; encodings and header rows differ, so the
lines are found by a small parser for each dialect inside ``mapInPandas``. Every later step is a DataFrame step.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.dates import dotted_date, hyphen_date
from quillspark.functions.money import export_number, export_quantity, unit_price

HEADER_START = "거래일자"


@dataclass(frozen=True)
class Dialect:
    """Fixed values of one house: column names, words for sides and accounts."""

    name: str
    columns: dict[str, str]
    sides: tuple[tuple[str, str], ...]
    broker: str
    account_type: str | None
    dotted: bool


DIALECTS = {
    "mirae": Dialect(
        "mirae",
        {"day": "거래일자", "kind": "거래종류", "name": "종목명", "quantity": "거래수량", "amount": "거래금액", "fees": "수수료"},
        (("매수", "buy"), ("매도", "sell"), ("매수입고", "buy"), ("매도상환", "sell")),
        "미래에셋",
        None,
        True,
    ),
    "samsung": Dialect(
        "samsung",
        {"day": "거래일자", "kind": "거래명", "name": "상품명", "quantity": "거래수량", "price": "거래단가/이율", "amount": "거래금액", "fees": "수수료"},
        (("(매수)", "buy"), ("(매도)", "sell")),
        "삼성",
        "퇴직연금",
        False,
    ),
}
RAW = "path string, dialect string, line long, day string, kind string, name string, quantity string, price string, amount string, fees string"


def decode(content: bytes) -> str:
    """UTF-8, with or without a mark, else CP949."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp949", "replace")


def detect_broker(text: str) -> str:
    """mirae, kiwoom, samsung or unknown: by the first line, the first four lines, then the header's columns."""
    lines = text.split("\n")
    first, preamble = lines[0].lower(), "\n".join(lines[:4])
    for word in ("mirae", "kiwoom", "samsung"):
        if word in first:
            return word
    for word, house in (("미래에셋", "mirae"), ("키움", "kiwoom"), ("삼성", "samsung")):
        if word in preamble:
            return house
    for words, house in ((("거래일자", "거래종류"), "mirae"), (("거래단가/이율", "정산금액"), "samsung")):
        if any(all(w in line for w in words) for line in lines[:10]):
            return house
    return "unknown"


def raw_rows(path: str, content: bytes) -> list[tuple]:
    text = decode(content)
    house = detect_broker(text)
    dialect = DIALECTS.get(house)
    if dialect is None:
        return []
    lines = list(csv.reader(io.StringIO(text)))
    start = next((k for k, row in enumerate(lines) if row and row[0].strip() == HEADER_START), None)
    if start is None:
        return []
    header = [c.strip() for c in lines[start]]
    if any(c not in header for c in dialect.columns.values()):
        return []
    at = {field: header.index(c) for field, c in dialect.columns.items()}
    out = []
    for k, row in enumerate(lines[start + 1 :], start + 1):
        if any(c.strip() for c in row):
            cell = {f: row[i].strip() if i < len(row) else "" for f, i in at.items()}
            out.append((path, house, k, *(cell.get(f, "") for f in ("day", "kind", "name", "quantity", "price", "amount", "fees"))))
    return out


def read_exports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The trade rows of all exports under ``paths``."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return parse_exports(files)


def parse_exports(files: DataFrame) -> DataFrame:
    """(path, content) -> trades. Rows of other kinds, without day, name or whole non-zero quantity are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RAW.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(raw_rows(path, bytes(content or b"")), columns=names)

    rows = files.select("path", "content").mapInPandas(run, RAW)
    is_mirae = F.col("dialect") == "mirae"
    side, account = F.lit(None).cast("string"), F.lit(None).cast("string")
    broker, day = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    for name, dialect in DIALECTS.items():
        here = F.col("dialect") == name
        for word, meaning in reversed(dialect.sides):
            side = F.when(here & F.col("kind").contains(word), meaning).otherwise(side)
        broker = F.when(here, dialect.broker).otherwise(broker)
        day = F.when(here, dotted_date("day") if dialect.dotted else hyphen_date("day")).otherwise(day)
        own = F.when(F.col("kind").contains("자기융자"), "자기융자").when(F.col("kind").contains("유통융자"), "유통융자").otherwise(F.col("kind"))
        account = F.when(here, own if dialect.account_type is None else F.lit(dialect.account_type)).otherwise(account)
    quantity, amount = export_quantity("quantity"), export_number("amount")
    price = F.when(is_mirae, F.when(quantity > 0, unit_price(amount, quantity)).otherwise(0)).otherwise(export_number("price"))
    parsed = rows.select(
        "path", "line", "name", side.alias("side"), day.alias("traded_at"), price.cast("decimal(12,2)").alias("price"), quantity.alias("quantity"), amount.alias("amount"), export_number("fees").alias("fees"), broker.alias("broker"), account.alias("account_type")
    )
    named = ~is_mirae_name_missing()
    return parsed.filter(F.col("side").isNotNull() & F.col("traded_at").isNotNull() & F.col("quantity").isNotNull() & (F.col("quantity") != 0) & named)


def is_mirae_name_missing():
    """Transfers of money in the first dialect have no name."""
    return (F.col("broker") == DIALECTS["mirae"].broker) & (F.col("name") == "")


def with_codes(trades: DataFrame, stocks: DataFrame) -> DataFrame:
    """The trades with the code of their name as symbol; an unknown name keeps its symbol."""
    named = stocks.groupBy("name").agg(F.max("code").alias("code"))
    old = F.col("symbol") if "symbol" in trades.columns else F.lit("")
    return trades.join(named, "name", "left").withColumn("symbol", F.coalesce("code", old)).drop("code")
