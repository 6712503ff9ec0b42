"""Dates: parsing, buckets, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dotted_date(c) -> Column:
    return F.try_to_timestamp(F.trim(_column(c)), F.lit("yyyy.M.d"))


def hyphen_date(c) -> Column:
    return F.try_to_timestamp(F.trim(_column(c)), F.lit("yyyy-M-d"))


# Patterns of a day in running text, with groups for year, month and day.
DAY_PATTERNS = (
    r"(20[2-3]\d)\.\s*(\d{1,2})\.\s*(\d{1,2})",
    r"(20[2-3]\d)-(\d{1,2})-(\d{1,2})",
    r"(20[2-3]\d)/(\d{1,2})/(\d{1,2})",
    r"(20[2-3]\d)\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일",
)


def first_day_in_text(c, as_of, first_year: str = "2020-01-01") -> Column:
    """The valid day that stands first in a text, from ``first_year`` to a week after ``as_of``."""
    text = _column(c)

    def placed(pattern: str) -> Column:
        parts = [lambda m, k=k: F.regexp_extract(m, pattern, k) for k in (1, 2, 3)]
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m: F.struct(F.instr(text, m).alias("at"), F.try_to_date(F.concat_ws("-", *[part(m) for part in parts]), "y-M-d").alias("day")),
        )

    found = [placed(pattern) for pattern in DAY_PATTERNS]
    days = F.filter(F.concat(*found), lambda x: x["day"].between(F.to_date(F.lit(first_year)), F.date_add(_column(as_of), 7)))
    return F.array_min(days)["day"]


def whole_days(start, end) -> Column:
    """Whole 24-hour days between two times, floored; datediff would count midnights."""
    return F.floor((F.unix_seconds(_column(end).cast("timestamp")) - F.unix_seconds(_column(start).cast("timestamp"))) / 86400).cast("bigint")


def week_end(day) -> Column:
    """The Friday that ends the week of a day."""
    return F.next_day(F.date_sub(_column(day), 1), "FRI")


def month_end(day) -> Column:
    return F.last_day(_column(day))


def day_gap(a, b) -> Column:
    return F.abs(F.datediff(_column(a), _column(b)))


def recency(day, as_of, span: int = 365) -> Column:
    """1 on the day, falling to 0 after ``span`` days."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.datediff(_column(as_of), _column(day)) / F.lit(float(span)))


def last_business_day(as_of, tries: int = 10) -> Column:
    """The last day up to ``as_of`` that is neither Saturday nor Sunday."""
    days = F.sequence(F.date_sub(_column(as_of), tries), _column(as_of))
    return F.array_max(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)))


def preferred_day(found_in_text, told) -> Column:
    """A day read in the text goes before one that was told."""
    return F.coalesce(_column(found_in_text), F.try_to_date(_column(told).cast("string")))
