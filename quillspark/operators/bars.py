"""Price bars and technical indicators as windows over (symbol, day).

Bars are rows (symbol, day, open, high, low, close, volume). Every indicator is computed for every bar at once, null
until enough bars stand before it; the snapshot of a trade is the row of its symbol's last bar up to its day.

Defined cases: rows with null symbol or day take no part; a zero price range gives null stochastics; buckets whose open
or close is null throughout are left out; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.dates import month_end, week_end

STOCHASTICS = ((5, 3, 3), (10, 6, 6), (20, 12, 12))
AVERAGES = (5, 20, 60, 120)
#: Bars that a timeframe needs before its stochastics are told, and days of history that a snapshot looks at.
LEAST_BARS = {"daily": 30, "weekly": 10, "monthly": 5}
LOOKBACK_DAYS = 600


def _days(keys: list[str]):
    return W.partitionBy(*keys).orderBy("day")


def _full(value: Column, size: int, keys: list[str], counted: str | None = None) -> Column:
    """``value`` over the last ``size`` rows, null while one is missing; a ``counted`` column must be told in all of them."""
    frame = _days(keys).rowsBetween(1 - size, 0)
    full = F.row_number().over(_days(keys)) >= size if counted is None else F.count(counted).over(frame) == size
    return F.when(full, value.over(frame))


def _sliding_averages(bars: DataFrame, value: str, sizes: tuple[int, ...], keys: list[str], width: int = 20) -> DataFrame:
    """Columns ma5, .. : averages of ``value`` over the last rows of each size, null while one is missing; null values count nowhere.

    Sizes are up to ``width`` or multiples of it. Rows are added up first row first, as plain sums over frames are, to the last
    digit: the last ``width`` rows are brought beside each row, and a longer sum goes on with them from where the row before
    them has come. No frame is walked for each row, and nothing is subtracted.
    """
    over = _days(keys)
    given = F.col(value).cast("double")
    told = F.count(given).over(over.rowsBetween(W.unboundedPreceding, 0))
    out = bars.withColumns({"ma_row": F.row_number().over(over), "ma_told": told, "ma_0": F.coalesce(given, F.lit(0.0))})
    out = out.withColumns({f"ma_{k}": F.lag("ma_0", k, 0).over(over) for k in range(1, width)} | {f"ma_told{size}": F.col("ma_told") - F.lag("ma_told", size, 0).over(over) for size in sizes})

    def added(size: int, *start: Column) -> Column:
        return reduce(lambda a, b: a + b, [*start, *[F.col(f"ma_{k}") for k in range(size - 1, -1, -1)]])

    out = out.withColumns({f"ma_sum{size}": added(size) for size in {*sizes, width} if size <= width})
    for size in range(2 * width, max(sizes) + 1, width):
        out = out.withColumn(f"ma_sum{size}", added(width, F.lag(f"ma_sum{size - width}", width, 0).over(over)))
    averages = [F.when((F.col("ma_row") >= size) & (F.col(f"ma_told{size}") > 0), F.col(f"ma_sum{size}") / F.col(f"ma_told{size}")).alias(f"ma{size}") for size in sizes]
    return out.select(*bars.columns, *averages)


def _told(rows: DataFrame, given: list[str], keys: list[str], values: list[Column], under: str | None, valid: Column | None = None) -> DataFrame:
    """(keys, day, values) of all valid rows; or, with a name to put them ``under``, all given columns and the values as one struct.

    Indicators that pass their bars on like this can follow each other in one pass over the same windows.
    """
    if under is None:
        return (rows if valid is None else rows.filter(valid)).select(*keys, "day", *values)
    told = F.struct(*values)
    return rows.select(*given, (told if valid is None else F.when(valid, told)).alias(under))


def rounded(value: Column, places: int) -> Column:
    """Half up, after noise of double sums in the tenth place has been taken off."""
    return F.round(F.round(value, 10), places)


def rounded_as_sql(value: Column, places: int) -> Column:
    """Half away from zero of the scaled double, as DuckDB rounds one: where the decimals end in a 5, Spark's round looks at the
    shortest decimal instead. What rounds to nothing keeps its sign (-0.0)."""
    scaled = value * float(10**places)
    return F.signum(scaled) * F.round(F.abs(scaled)) / float(10**places)


def resample(bars: DataFrame, bucket: Column, keys: list[str] | None = None) -> DataFrame:
    """One bar for each bucket: first open, highest high, lowest low, last close, summed volume."""
    keys = keys or ["symbol"]
    rows = bars.filter(F.col("symbol").isNotNull() & F.col("day").isNotNull()).withColumn("bucket", bucket)
    grouped = rows.groupBy(*keys, F.col("bucket").alias("day")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("day"))).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("day"))).alias("close"),
        F.sum("volume").alias("volume"),
    )
    return grouped.filter(F.col("open").isNotNull() & F.col("close").isNotNull())


def weekly(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Weeks end on Friday."""
    return resample(bars, week_end("day"), keys)


def monthly(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return resample(bars, month_end("day"), keys)


def zone(k: Column) -> Column:
    return F.when(k > 80, "overbought").when(k < 20, "oversold").otherwise("neutral")


def stochastic(bars: DataFrame, k: int, d: int, smooth: int, keys: list[str] | None = None, under: str | None = None) -> DataFrame:
    """Slow stochastic of every bar: k, d, cross, direction of the last three k, zone."""
    keys = keys or ["symbol"]
    before = f"IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{c}`' for c in keys)} ORDER BY day)"
    low, high = _full(F.min("low"), k, keys), _full(F.max("high"), k, keys)
    raw = bars.withColumn("raw_k", (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)) * 100)
    smoothed = raw.withColumn("full_k", _full(F.avg("raw_k"), smooth, keys, "raw_k"))
    both = smoothed.withColumn("full_d", _full(F.avg("full_k"), d, keys, "full_k"))
    # a row is told from the first full_d on, and looks at the told rows before it
    shown = both.withColumn("shown_k", F.when(F.col("full_d").isNotNull(), F.col("full_k")))
    led = shown.withColumns({"k1": F.expr(f"lag(shown_k, 1) {before}"), "k2": F.expr(f"lag(shown_k, 2) {before}"), "d1": F.expr(f"lag(full_d, 1) {before}")})
    k0, k1, k2, d0, d1 = (F.col(c) for c in ("full_k", "k1", "k2", "full_d", "d1"))
    values = [
        # a first valid row is told unrounded
        F.when(k1.isNull(), k0).otherwise(F.round(k0, 2)).alias("stoch_k"),
        F.when(k1.isNull(), d0).otherwise(F.round(d0, 2)).alias("stoch_d"),
        F.when((k1 < d1) & (k0 > d0), "golden").when((k1 > d1) & (k0 < d0), "dead").otherwise("none").alias("cross"),
        F.when((k0 - k1 > 0.5) & (k1 - k2 > 0.5), "rising").when((k0 - k1 < -0.5) & (k1 - k2 < -0.5), "falling").otherwise("sideways").alias("direction"),
        zone(k0).alias("zone"),
    ]
    return _told(led, bars.columns, keys, values, under, d0.isNotNull())


def moving_averages(bars: DataFrame, keys: list[str] | None = None, under: str | None = None) -> DataFrame:
    """Averages of 5, 20, 60 and 120 closes, deviations in per cent, and how the averages are ordered."""
    keys = keys or ["symbol"]
    out = _sliding_averages(bars, "close", AVERAGES, keys)
    a, b, c, e = (F.col(f"ma{p}") for p in AVERAGES)
    alignment = F.when(a.isNull(), "unknown").when(e.isNull(), "partial").when((a > b) & (b > c) & (c > e), "bullish").when((a < b) & (b < c) & (c < e), "bearish").otherwise("mixed")
    deviations = [rounded_as_sql((F.col("close") - F.col(f"ma{p}")) / F.col(f"ma{p}") * 100, 4).alias(f"deviation{p}") for p in AVERAGES]
    return _told(out, bars.columns, keys, [F.col("close"), *[F.col(f"ma{p}") for p in AVERAGES], *deviations, alignment.alias("alignment")], under)


def bollinger(bars: DataFrame, length: int = 20, width: float = 2.0, keys: list[str] | None = None, under: str | None = None) -> DataFrame:
    """Bands, position in them, band width in per cent, and whether it widens against its own average."""
    keys = keys or ["symbol"]
    over = _days(keys)
    mid, spread = _full(F.avg("close"), length, keys), _full(F.stddev_pop("close"), length, keys) * width
    banded = bars.withColumn("n_bars", F.count("*").over(over.rowsBetween(W.unboundedPreceding, 0))).withColumn("mid", mid).withColumn("spread", spread)
    banded = banded.withColumn("lower", F.col("mid") - F.col("spread")).withColumn("upper", F.col("mid") + F.col("spread"))
    breadth = F.col("upper") - F.col("lower")
    banded = banded.withColumn("share", breadth / F.col("mid") * 100)
    usual = _full(F.avg("share"), length, keys, "share")
    banded = banded.withColumn("usual", usual)
    bandwidth = F.when(F.col("mid") > 0, rounded_as_sql(F.col("share"), 4))
    phase = F.when(bandwidth.isNull() | (F.col("n_bars") < 2 * length), "unknown").when(bandwidth > F.col("usual") * 1.05, "expanding").when(bandwidth < F.col("usual") * 0.95, "squeeze").otherwise("neutral")
    values = [
        F.when(breadth > 0, rounded_as_sql((F.col("close") - F.col("lower")) / breadth, 4)).alias("position"),
        bandwidth.alias("bandwidth"),
        phase.alias("squeeze_expanding"),
        *[rounded_as_sql(F.col(c), 4).alias(c) for c in ("lower", "mid", "upper")],
    ]
    return _told(banded, bars.columns, keys, values, under)


def volume_ratio(bars: DataFrame, keys: list[str] | None = None, under: str | None = None) -> DataFrame:
    """Volume against the average of up to 20 bars before."""
    keys = keys or ["symbol"]
    before = F.avg("volume").over(_days(keys).rowsBetween(-20, -1))
    rows = bars.withColumn("usual_volume", before)
    return _told(rows, bars.columns, keys, [F.when(F.col("usual_volume") > 0, rounded(F.col("volume") / F.col("usual_volume"), 4)).alias("volume_ratio")], under)


def candles(bars: DataFrame, keys: list[str] | None = None, under: str | None = None) -> DataFrame:
    """Candle pattern against the average true range, shadows as parts of the range, and gaps."""
    keys = keys or ["symbol"]
    over = _days(keys)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    led = bars.withColumn("last_close", F.lag("close").over(over)).withColumn("last_high", F.lag("high").over(over)).withColumn("last_low", F.lag("low").over(over))
    true_range = F.when(F.col("last_close").isNotNull(), F.greatest(h - low, F.abs(h - F.col("last_close")), F.abs(low - F.col("last_close"))))
    ranged = led.withColumn("true_range", true_range).withColumn("atr", F.avg("true_range").over(over.rowsBetween(-13, 0)))
    body = F.abs(c - o)
    extent = F.when(h > low, h - low).otherwise(F.lit(1.0))
    first = F.col("last_close").isNull()

    def part(x: Column) -> Column:
        return F.when(~first, F.round(x / extent, 4))

    pattern = F.when(first, "unknown").when((body > F.col("atr") * 1.5) & (c > o), "large_bullish").when((body > F.col("atr") * 1.5) & (c < o), "large_bearish").when(body < F.col("atr") * 0.1, "doji").when(c > o, "bullish").otherwise("bearish")
    values = [
        pattern.alias("pattern"),
        part(body).alias("body_ratio"),
        part(h - F.greatest(o, c)).alias("upper_shadow"),
        part(F.least(o, c) - low).alias("lower_shadow"),
        F.when(low > F.col("last_high"), "up").when(h < F.col("last_low"), "down").otherwise("none").alias("gap"),
        rounded(F.col("atr"), 4).alias("atr"),
    ]
    return _told(ranged, bars.columns, keys, values, under)


def latest_row(bars: DataFrame, least: int, keys: list[str], name: str, kept: list[str] | None = None) -> DataFrame:
    """(keys, name, kept): the last told row of each stochastic set, null under ``least`` bars, and the kept columns of the last bar."""
    rows, sets = bars, []
    for k, d, smooth in STOCHASTICS:
        rows = stochastic(rows, k, d, smooth, keys, under=f"set{k}")
    none = F.struct(F.lit(None).cast("double").alias("stoch_k"), F.lit(None).cast("double").alias("stoch_d"), F.lit("none").alias("cross"), F.lit("sideways").alias("direction"), F.lit("neutral").alias("zone"))
    for k, _, _ in STOCHASTICS:
        last = F.max_by(f"set{k}", F.when(F.col(f"set{k}").isNotNull(), F.col("day")))
        sets.append(F.struct(F.lit(k).alias("k"), F.coalesce(last, none).alias("values")))
    return rows.groupBy(*keys).agg(F.when(F.count("*") >= least, F.array(*sets)).alias(name), *[F.max_by(c, "day").alias(c) for c in kept or []])


def trade_snapshots(trades: DataFrame, bars: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """All indicators of each trade (id, symbol, traded_at), as of its day, from bars of the days before it.

    The cut of history makes the first and last week or month of a trade partial, so bars are joined to trades by range
    and every window runs by trade. Trades of one symbol and day share the work.
    """
    wanted = trades.filter(F.col("symbol").isNotNull() & F.col("traded_at").isNotNull()).select("id", "symbol", F.to_date("traded_at").alias("as_of"))
    moments = wanted.select("symbol", "as_of").distinct()
    near = F.datediff("as_of", "day").between(0, lookback_days)
    # both sides meet in blocks of days: a moment looks at the blocks that its history touches
    block = 128
    spans = moments.withColumn("block", F.explode(F.sequence(F.floor((F.datediff("as_of", F.lit("1970-01-01").cast("date")) - lookback_days) / block), F.floor(F.datediff("as_of", F.lit("1970-01-01").cast("date")) / block))))
    dated = bars.filter(F.col("day").isNotNull()).withColumn("block", F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / block))
    history = spans.join(dated, ["symbol", "block"]).filter(near).drop("block")
    keys = ["symbol", "as_of"]

    # all daily indicators follow each other over one order of one shuffle
    daily = history
    for name, indicator in (("ma", moving_averages), ("bb", bollinger), ("ratio", volume_ratio), ("candle", candles)):
        daily = indicator(daily, keys=keys, under=name)
    parts = [latest_row(daily, LEAST_BARS["daily"], keys, "daily", ["ma", "bb", "ratio", "candle"]).withColumnRenamed("ratio", "volume")]
    for name, frame in {"weekly": weekly(history, keys), "monthly": monthly(history, keys)}.items():
        parts.append(latest_row(frame, LEAST_BARS[name], keys, name))
    snapshot = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    return wanted.join(snapshot, keys, "left").filter(F.col("ma").isNotNull())
