"""Amounts: language-model cost, pro-rata fees, rates and numbers from exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dollars for a million input and output tokens, by model; other models have the default price.
MODEL_PRICES = {
    "claude-haiku-4-5-20251001": (0.80, 4.00),
    "claude-haiku-3-5-20241022": (0.80, 4.00),
    "claude-sonnet-4-6": (3.00, 15.00),
    "claude-opus-4-6": (15.00, 75.00),
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-2.5-flash-lite": (0.10, 0.40),
}
DEFAULT_PRICE = (1.00, 5.00)
CACHE_WRITE, CACHE_READ, BATCH = 1.25, 0.10, 0.50


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def model_cost(model, input_tokens, output_tokens, cache_write=None, cache_read=None, is_batch=None, prices: dict[str, tuple[float, float]] = MODEL_PRICES) -> Column:
    """Dollars, rounded to 8 places. Cached tokens cost their share of the input price; batches cost half."""
    name = _column(model)

    # scales are kept small enough for the whole product to be exact
    def price(k: int) -> Column:
        out = F.lit(DEFAULT_PRICE[k]).cast("decimal(5,2)")
        for key, pair in prices.items():
            out = F.when(name == key, F.lit(pair[k]).cast("decimal(5,2)")).otherwise(out)
        return out

    def tokens(c) -> Column:
        return F.coalesce(_column(c) if c is not None else F.lit(0), F.lit(0)).cast("decimal(14,0)")

    weighted = tokens(input_tokens) + tokens(cache_write) * F.lit(CACHE_WRITE).cast("decimal(3,2)") + tokens(cache_read) * F.lit(CACHE_READ).cast("decimal(3,2)")
    total = weighted * price(0) + tokens(output_tokens) * price(1)
    batch = F.coalesce(_column(is_batch) if is_batch is not None else F.lit(False), F.lit(False))
    factor = F.when(batch, F.lit(BATCH).cast("decimal(2,1)")).otherwise(F.lit(1).cast("decimal(2,1)"))
    return F.round(total * factor * F.lit("0.000001").cast("decimal(6,6)"), 8).cast("decimal(18,8)")


def wide(c) -> Column:
    """A quantity for decimal division: an int divisor would leave six places only."""
    return _column(c).cast("decimal(12,0)")


def fee_share(fees, part, whole) -> Column:
    """fees x part / whole, half up to cents; nothing of nothing."""
    share = F.round(_column(fees).cast("decimal(14,2)") * wide(part) / F.nullif(wide(whole), F.lit(0)), 2)
    return F.coalesce(share, F.lit(0)).cast("decimal(14,2)")


def profit_rate(net, bought) -> Column:
    return F.when(_column(bought) > 0, F.round(_column(net).cast("decimal(18,2)") / _column(bought).cast("decimal(18,2)"), 4).cast("decimal(18,4)"))


def unit_price(amount, quantity) -> Column:
    """Half even to cents, as the exports' own prices are."""
    return F.bround(_column(amount).cast("decimal(14,2)") / F.nullif(wide(quantity), F.lit(0)), 2).cast("decimal(12,2)")


def export_number(c) -> Column:
    """A number with thousands commas; blank and malformed ones are 0."""
    bare = F.trim(F.replace(_column(c), F.lit(","), F.lit("")))
    return F.coalesce(bare.try_cast("decimal(14,2)"), F.lit(0).cast("decimal(14,2)"))


def export_quantity(c) -> Column:
    """Like export_number in whole numbers, but null when malformed: such rows are skipped."""
    bare = F.trim(F.replace(_column(c), F.lit(","), F.lit("")))
    return F.when(bare == "", F.lit(0)).otherwise(bare.try_cast("int"))


def unit_interval(c, default: float = 1.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_column(c).try_cast("double"), F.lit(default))))


def sentiment_label(c, steps: tuple[float, float] = (0.2, 0.6)) -> Column:
    """Five classes around zero."""
    v, (low, high) = _column(c), steps
    return F.when(v.isNull(), None).when(v >= high, "very positive").when(v >= low, "positive").when(v > -low, "neutral").when(v > -high, "negative").otherwise("very negative")
