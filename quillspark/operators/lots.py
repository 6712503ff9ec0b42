"""First-in-first-out lot matching for all symbols at once.

Walking through a symbol's trades by (traded_at, id), a sale takes from the oldest open lots and what finds no open lot
is dropped. With S the running signed quantity and B the running bought quantity, the open inventory after a row is
S - min(0, lowest S so far). A purchase covers (B - quantity, B] on the axis of bought units, a sale the stretch of that
axis by which the inventory fell, and lots match where both overlap. Windows and one range join per symbol say all of
it; the axis is cut into cells, so that the range join stays an equi-join on (symbol, cell) however many trades a symbol
has.

Defined cases: null fees count as 0; rows with null symbol, time, side or quantity, and quantities that are not
positive, take no part; ties of time go by id; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.dates import whole_days
from quillspark.functions.money import fee_share, profit_rate

#: Bought units in one cell of the axis.
CELL_UNITS = 4096
#: Time that one task walks through at once, a unit of ``date_trunc``.
SPAN = "quarter"
SPANS = ("year", "quarter", "month", "week", "day", "hour", "minute")


def walked(trades: DataFrame, span: str = SPAN) -> DataFrame:
    """The trades with ``lo`` and ``hi``: the stretch of the axis of bought units that each covers.

    A scan in two levels: running sums and minima within (symbol, ``span`` of time), and over the spans of a symbol the sums
    before each and the lowest point so far, which shift them. No task holds more than a span of a symbol's trades.
    """
    if span not in SPANS:
        raise ValueError(f"span is one of {', '.join(SPANS)}")
    usable = trades.filter(F.col("symbol").isNotNull() & F.col("traded_at").isNotNull() & F.col("side").isin("buy", "sell") & (F.col("quantity") > 0))
    quantity = F.col("quantity").cast("bigint")
    is_buy = F.col("side") == "buy"
    order = W.partitionBy("symbol", "span").orderBy("traded_at", "id")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = usable.withColumn("span", F.date_trunc(span, "traded_at")).withColumn("moved", F.when(is_buy, quantity).otherwise(-quantity))
    summed = moved.withColumn("net", F.sum("moved").over(so_far)).withColumn("own_bought", F.sum(F.when(is_buy, quantity).otherwise(0)).over(so_far))
    within = summed.withColumn("own_low", F.min("net").over(so_far)).withColumn("low_before", F.lag("own_low").over(order))
    spans = within.groupBy("symbol", "span").agg(F.sum("moved").alias("moved"), F.min("net").alias("low"), F.max("own_bought").alias("bought"))
    earlier = W.partitionBy("symbol").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    shifts = spans.withColumn("base", F.coalesce(F.sum("moved").over(earlier), F.lit(0))).withColumn("base_bought", F.coalesce(F.sum("bought").over(earlier), F.lit(0)))
    shifts = shifts.withColumn("base_low", F.least(F.lit(0), F.min(F.col("base") + F.col("low")).over(earlier))).select("symbol", "span", "base", "base_bought", "base_low")
    rows = within.join(shifts, ["symbol", "span"])
    held = rows.withColumn("bought", F.col("base_bought") + F.col("own_bought")).withColumn("inventory", F.col("base") + F.col("net") - F.least("base_low", F.col("base") + F.col("own_low")))
    before = F.col("base") + F.col("net") - F.col("moved") - F.least("base_low", F.col("base") + F.col("low_before"))
    told = held.withColumn("lo", F.when(is_buy, F.col("bought") - quantity).otherwise(F.col("bought") - before)).withColumn("hi", F.when(is_buy, F.col("bought")).otherwise(F.col("bought") - F.col("inventory")))
    return told.select(*trades.columns, "bought", "inventory", "lo", "hi")


def match_lots(trades: DataFrame, cell_units: int = CELL_UNITS) -> DataFrame:
    """One row for each matched part of a purchase and a sale: quantities, amounts, fees, profit rate, days held."""
    rows = walked(trades).filter("hi > lo").withColumn("fees", F.coalesce("fees", F.lit(0)).cast("decimal(14,2)"))
    cells = F.sequence(F.floor(F.col("lo") / cell_units), F.floor((F.col("hi") - 1) / cell_units))
    celled = rows.select("symbol", "side", "id", "traded_at", "price", "quantity", "fees", "lo", "hi", F.explode(cells).alias("cell"))
    buys = celled.filter("side = 'buy'").select("symbol", "cell", *[F.col(c).alias(f"buy_{c}") for c in ("id", "traded_at", "price", "quantity", "fees", "lo", "hi")])
    sells = celled.filter("side = 'sell'").select("symbol", "cell", *[F.col(c).alias(f"sell_{c}") for c in ("id", "traded_at", "price", "quantity", "fees", "lo", "hi")])
    met = buys.join(sells, ["symbol", "cell"]).filter((F.col("buy_lo") < F.col("sell_hi")) & (F.col("sell_lo") < F.col("buy_hi")))
    lo = F.greatest("buy_lo", "sell_lo")
    # an overlap is told in the cell that it begins in
    matched = met.filter(F.floor(lo / cell_units) == F.col("cell")).withColumn("matched_qty", F.least("buy_hi", "sell_hi") - lo)
    units = F.col("matched_qty").cast("decimal(18,0)")
    priced = (
        matched.withColumn("buy_amount", (F.col("buy_price").cast("decimal(12,2)") * units).cast("decimal(18,2)"))
        .withColumn("sell_amount", (F.col("sell_price").cast("decimal(12,2)") * units).cast("decimal(18,2)"))
        .withColumn("buy_fee", fee_share("buy_fees", "matched_qty", "buy_quantity"))
        .withColumn("sell_fee", fee_share("sell_fees", "matched_qty", "sell_quantity"))
    )
    net = (F.col("sell_amount") - F.col("buy_amount") - F.col("buy_fee") - F.col("sell_fee")).cast("decimal(18,2)")
    return priced.withColumn("net_profit", net).select(
        "symbol",
        F.col("buy_id").alias("buy_trade_id"),
        F.col("sell_id").alias("sell_trade_id"),
        "matched_qty",
        "buy_amount",
        "sell_amount",
        "buy_fee",
        "sell_fee",
        "net_profit",
        profit_rate("net_profit", "buy_amount").alias("profit_rate"),
        whole_days("buy_traded_at", "sell_traded_at").alias("holding_days"),
    )


def open_lots(trades: DataFrame) -> DataFrame:
    """(symbol, buy_trade_id, qty, price) of what is still held of each purchase."""
    rows = walked(trades)
    ends = rows.groupBy("symbol").agg(F.max_by(F.col("bought") - F.col("inventory"), F.struct("traded_at", "id")).alias("sold_to"))
    buys = rows.filter("side = 'buy'").join(ends, "symbol").withColumn("qty", F.col("hi") - F.greatest("lo", "sold_to"))
    return buys.filter("qty > 0").select("symbol", F.col("id").alias("buy_trade_id"), "qty", F.col("price").cast("decimal(12,2)").alias("price"))


def positions(trades: DataFrame) -> DataFrame:
    """(symbol, remaining_qty, avg_cost) of every symbol traded; a flat one has cost 0."""
    lots = open_lots(trades).groupBy("symbol").agg(F.sum("qty").alias("qty"), F.sum((F.col("price") * F.col("qty").cast("decimal(18,0)")).cast("decimal(20,2)")).alias("cost"))
    symbols = trades.filter(F.col("symbol").isNotNull()).select("symbol").distinct()
    cost = F.round(F.col("cost") / F.col("qty").cast("decimal(18,0)"), 2).cast("decimal(18,2)")
    return symbols.join(lots, "symbol", "left").select("symbol", F.coalesce("qty", F.lit(0)).cast("bigint").alias("remaining_qty"), F.coalesce(cost, F.lit(0)).cast("decimal(18,2)").alias("avg_cost"))


def realized_profit(pairs: DataFrame) -> DataFrame:
    """Pairs, units, amounts and profit by symbol."""
    return pairs.groupBy("symbol").agg(
        F.count("*").alias("n_pairs"),
        F.sum("matched_qty").alias("matched_qty"),
        F.sum("buy_amount").cast("decimal(20,2)").alias("buy_amount"),
        F.sum("sell_amount").cast("decimal(20,2)").alias("sell_amount"),
        F.sum("net_profit").cast("decimal(20,2)").alias("net_profit"),
    )


def rebuilt_pairs(stored: DataFrame, trades: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored pairs with those of the changed symbols deleted and matched anew."""
    symbols = changed.select("symbol").distinct()
    return stored.join(symbols, "symbol", "left_anti").unionByName(match_lots(trades.join(symbols, "symbol", "left_semi")).select(*stored.columns))


def matched_counts(trades: DataFrame) -> DataFrame:
    """(symbol, n_pairs) of every symbol, also of those without a pair; -1 where a trade has no price, time or quantity."""
    counts = match_lots(trades).groupBy("symbol").agg(F.count("*").alias("n"))
    broken = F.col("price").isNull() | F.col("traded_at").isNull() | F.col("quantity").isNull()
    symbols = trades.filter(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.max(broken).alias("broken"))
    return symbols.join(counts, "symbol", "left").select("symbol", F.when(F.col("broken"), -1).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_pairs"))
