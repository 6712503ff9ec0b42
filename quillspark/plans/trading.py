"""Queries on trades and price bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import bars as b
from quillspark.operators import lots
from quillspark.operators import snapshot_text as wording
from quillspark.operators.dashboards import symbol_frequency, trade_page, trade_stats
from quillspark.sources import tables as t

QUERIES, ORACLE_SQL = {}, {}

LOTS_SQL = f"""WITH {t.TRADES_SQL},
sums AS (
  SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER w AS signed, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER w AS bought
  FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY traded_at, id ROWS UNBOUNDED PRECEDING)),
held AS (SELECT *, signed - least(0, min(signed) OVER (PARTITION BY symbol ORDER BY traded_at, id ROWS UNBOUNDED PRECEDING)) AS inventory FROM sums),
walked AS (
  SELECT *, CASE WHEN side = 'buy' THEN bought - quantity ELSE bought - coalesce(lag(inventory) OVER (PARTITION BY symbol ORDER BY traded_at, id), 0) END AS lo,
         CASE WHEN side = 'buy' THEN bought ELSE bought - inventory END AS hi
  FROM held),
matched AS (
  SELECT b.symbol, b.id AS buy_id, s.id AS sell_id, least(b.hi, s.hi) - greatest(b.lo, s.lo) AS q, b.c_price AS bp, s.c_price AS sp, b.c_fees AS bf, s.c_fees AS sf, b.quantity AS bq, s.quantity AS sq, b.traded_at AS bt, s.traded_at AS st
  FROM walked b JOIN walked s ON b.symbol = s.symbol AND b.side = 'buy' AND s.side = 'sell' AND b.lo < s.hi AND s.lo < b.hi),
priced AS (
  SELECT *, bp * q AS buy_c, sp * q AS sell_c, (2 * bf * q + bq) // (2 * bq) AS buy_fee_c, (2 * sf * q + sq) // (2 * sq) AS sell_fee_c FROM matched),
pairs AS (SELECT *, sell_c - buy_c - buy_fee_c - sell_fee_c AS net_c FROM priced)
"""


def _money(c: str, p: int = 18) -> str:
    return f"(({c})::DECIMAL(30,0) * 0.01::DECIMAL(3,2))::DECIMAL({p},2)"


def fifo_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lots.match_lots(t.trades(spark, d))


QUERIES["fifo_pairs"] = fifo_pairs
ORACLE_SQL["fifo_pairs"] = f"""{LOTS_SQL}
SELECT symbol, buy_id AS buy_trade_id, sell_id AS sell_trade_id, q::BIGINT AS matched_qty, {_money("buy_c")} AS buy_amount, {_money("sell_c")} AS sell_amount,
       {_money("buy_fee_c", 14)} AS buy_fee, {_money("sell_fee_c", 14)} AS sell_fee, {_money("net_c")} AS net_profit,
       CASE WHEN buy_c > 0 THEN ((sign(net_c) * ((2 * abs(net_c)::HUGEINT * 10000 + buy_c) // (2 * buy_c)))::DECIMAL(30,0) * 0.0001::DECIMAL(5,4))::DECIMAL(18,4) END AS profit_rate,
       floor(epoch(st - bt) / 86400)::BIGINT AS holding_days
FROM pairs"""


def realized_profit(spark: SparkSession, d: str) -> DataFrame:
    return lots.realized_profit(lots.match_lots(t.trades(spark, d)))


QUERIES["realized_profit"] = realized_profit
ORACLE_SQL["realized_profit"] = f"""{LOTS_SQL}
SELECT symbol, count(*) AS n_pairs, sum(q)::BIGINT AS matched_qty, {_money("sum(buy_c)", 20)} AS buy_amount, {_money("sum(sell_c)", 20)} AS sell_amount, {_money("sum(net_c)", 20)} AS net_profit
FROM pairs GROUP BY symbol"""


def open_positions(spark: SparkSession, d: str) -> DataFrame:
    return lots.positions(t.trades(spark, d))


QUERIES["open_positions"] = open_positions
OPEN_SQL = """, ends AS (SELECT symbol, arg_max(bought - inventory, (traded_at, id)) AS sold_to FROM walked GROUP BY symbol),
lots AS (SELECT w.symbol, id, hi - greatest(lo, sold_to) AS qty, c_price FROM walked w JOIN ends USING (symbol) WHERE side = 'buy' AND hi - greatest(lo, sold_to) > 0)
"""
ORACLE_SQL["open_positions"] = f"""{LOTS_SQL}{OPEN_SQL}
SELECT symbol, coalesce(sum(qty), 0)::BIGINT AS remaining_qty, {_money("coalesce((2 * sum(qty * c_price) + sum(qty)) // (2 * sum(qty)), 0)")} AS avg_cost
FROM (SELECT DISTINCT symbol FROM trades) LEFT JOIN lots USING (symbol) GROUP BY symbol"""


def open_lots(spark: SparkSession, d: str) -> DataFrame:
    return lots.open_lots(t.trades(spark, d))


QUERIES["open_lots"] = open_lots
ORACLE_SQL["open_lots"] = f"""{LOTS_SQL}{OPEN_SQL} SELECT symbol, id AS buy_trade_id, qty::BIGINT AS qty, {_money("c_price", 12)} AS price FROM lots"""


def matched_counts(spark: SparkSession, d: str) -> DataFrame:
    return lots.matched_counts(t.trades(spark, d))


QUERIES["match_all_counts"] = matched_counts
ORACLE_SQL["match_all_counts"] = f"""{LOTS_SQL} SELECT s.symbol, count(p.symbol) AS n_pairs FROM (SELECT DISTINCT symbol FROM trades) s LEFT JOIN pairs p USING (symbol) GROUP BY 1"""

# --- bars -----------------------------------------------------------------------------------------------------------

BUCKETS_SQL = {"weekly": "(day + (((5 - isodow(day)) % 7 + 7) % 7)::INT)::DATE", "monthly": "last_day(day)"}


def _frame_sql(name: str) -> str:
    return f"""{name} AS (
  SELECT symbol, {BUCKETS_SQL[name]} AS day, arg_min(open, day) AS open, max(high) AS high, min(low) AS low, arg_max(close, day) AS close, sum(volume) AS volume
  FROM bars GROUP BY 1, 2)"""


def weekly_bars(spark: SparkSession, d: str) -> DataFrame:
    return b.weekly(t.bars(spark, d))


def monthly_bars(spark: SparkSession, d: str) -> DataFrame:
    return b.monthly(t.bars(spark, d))


QUERIES |= {"weekly_bars": weekly_bars, "monthly_bars": monthly_bars}
for _name in ("weekly", "monthly"):
    ORACLE_SQL[f"{_name}_bars"] = f"WITH {t.BARS_SQL}, {_frame_sql(_name)} SELECT symbol, day, open, high, low, close, volume FROM {_name}"


def ma_alignment(spark: SparkSession, d: str) -> DataFrame:
    out = b.moving_averages(t.bars(spark, d))
    return out.select("symbol", "day", *[F.round(f"ma{p}", 6).alias(f"ma{p}") for p in b.AVERAGES], *[f"deviation{p}" for p in b.AVERAGES], "alignment")


QUERIES["ma_alignment"] = ma_alignment
_ma = ", ".join(f"CASE WHEN count(*) OVER w{p} = {p} THEN avg(close) OVER w{p} END AS ma{p}" for p in b.AVERAGES)
_frames = ", ".join(f"w{p} AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)" for p in b.AVERAGES)
ORACLE_SQL["ma_alignment"] = f"""WITH {t.BARS_SQL}, averaged AS (SELECT symbol, day, close, {_ma} FROM bars WINDOW {_frames})
SELECT symbol, day, {", ".join(f"round(ma{p}, 6) AS ma{p}" for p in b.AVERAGES)}, {", ".join(f"round((close - ma{p}) / ma{p} * 100, 4) AS deviation{p}" for p in b.AVERAGES)},
       CASE WHEN ma5 IS NULL THEN 'unknown' WHEN ma120 IS NULL THEN 'partial' WHEN ma5 > ma20 AND ma20 > ma60 AND ma60 > ma120 THEN 'bullish'
            WHEN ma5 < ma20 AND ma20 < ma60 AND ma60 < ma120 THEN 'bearish' ELSE 'mixed' END AS alignment
FROM averaged"""


def bollinger(spark: SparkSession, d: str) -> DataFrame:
    return b.bollinger(t.bars(spark, d))


QUERIES["bollinger"] = bollinger
ORACLE_SQL["bollinger"] = f"""WITH {t.BARS_SQL}, banded AS (
  SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n_bars, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END * 2 AS spread
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
shared AS (SELECT *, mid - spread AS lower, mid + spread AS upper, ((mid + spread) - (mid - spread)) / mid * 100 AS share FROM banded),
usual AS (SELECT *, CASE WHEN count(share) OVER w = 20 THEN avg(share) OVER w END AS usual FROM shared WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
told AS (SELECT *, CASE WHEN upper - lower > 0 THEN round((close - lower) / (upper - lower), 4) END AS position, CASE WHEN mid > 0 THEN round(share, 4) END AS bandwidth FROM usual)
SELECT symbol, day, position, bandwidth, round(lower, 4) AS lower, round(mid, 4) AS mid, round(upper, 4) AS upper,
       CASE WHEN bandwidth IS NULL OR n_bars < 40 THEN 'unknown' WHEN bandwidth > usual * 1.05 THEN 'expanding' WHEN bandwidth < usual * 0.95 THEN 'squeeze' ELSE 'neutral' END AS squeeze_expanding
FROM told"""


def volume_ratio(spark: SparkSession, d: str) -> DataFrame:
    return b.volume_ratio(t.bars(spark, d))


QUERIES["volume_ratio"] = volume_ratio
ORACLE_SQL["volume_ratio"] = f"""WITH {t.BARS_SQL}, averaged AS (SELECT symbol, day, volume, avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual FROM bars)
SELECT symbol, day, CASE WHEN usual > 0 THEN round((volume / usual)::DECIMAL(38,10), 4)::DOUBLE END AS volume_ratio FROM averaged"""


def candles(spark: SparkSession, d: str) -> DataFrame:
    return b.candles(t.bars(spark, d))


QUERIES["candles"] = candles
ORACLE_SQL["candles"] = f"""WITH {t.BARS_SQL}, led AS (
  SELECT *, lag(close) OVER w AS last_close, lag(high) OVER w AS last_high, lag(low) OVER w AS last_low FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
ranged AS (SELECT *, CASE WHEN last_close IS NOT NULL THEN greatest(high - low, abs(high - last_close), abs(low - last_close)) END AS true_range FROM led),
told AS (SELECT *, avg(true_range) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr_raw, abs(close - open) AS body, CASE WHEN high > low THEN high - low ELSE 1.0 END AS extent FROM ranged)
SELECT symbol, day, CASE WHEN last_close IS NULL THEN 'unknown' WHEN body > atr_raw * 1.5 AND close > open THEN 'large_bullish' WHEN body > atr_raw * 1.5 AND close < open THEN 'large_bearish'
            WHEN body < atr_raw * 0.1 THEN 'doji' WHEN close > open THEN 'bullish' ELSE 'bearish' END AS pattern,
       CASE WHEN last_close IS NOT NULL THEN round(body / extent, 4) END AS body_ratio, CASE WHEN last_close IS NOT NULL THEN round((high - greatest(open, close)) / extent, 4) END AS upper_shadow,
       CASE WHEN last_close IS NOT NULL THEN round((least(open, close) - low) / extent, 4) END AS lower_shadow,
       CASE WHEN low > last_high THEN 'up' WHEN high < last_low THEN 'down' ELSE 'none' END AS gap, round(atr_raw::DECIMAL(38,10), 4)::DOUBLE AS atr
FROM told"""


def _stochastic(frame: str, k: int, d: int, smooth: int):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        rows = t.bars(spark, directory)
        rows = {"daily": lambda x: x, "weekly": b.weekly, "monthly": b.monthly}[frame](rows)
        return b.stochastic(rows, k, d, smooth).select("symbol", "day", F.round("stoch_k", 1).alias("stoch_k"), F.round("stoch_d", 1).alias("stoch_d"), "cross", "direction", "zone")

    return query


for _frame in ("daily", "weekly", "monthly"):
    for _k, _d, _s in b.STOCHASTICS:
        _source = "bars" if _frame == "daily" else _frame
        QUERIES[f"stochastic_{_frame}_{_k}"] = _stochastic(_frame, _k, _d, _s)
        ORACLE_SQL[f"stochastic_{_frame}_{_k}"] = f"""WITH {t.BARS_SQL}{"" if _frame == "daily" else ", " + _frame_sql(_frame)}, raw AS (
  SELECT symbol, day, CASE WHEN count(*) OVER w = {_k} THEN (close - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0) * 100 END AS raw_k
  FROM {_source} WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {_k - 1} PRECEDING AND CURRENT ROW)),
smooth AS (SELECT *, CASE WHEN count(raw_k) OVER w = {_s} THEN avg(raw_k) OVER w END AS k0 FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {_s - 1} PRECEDING AND CURRENT ROW)),
both_lines AS (SELECT *, CASE WHEN count(k0) OVER w = {_d} THEN avg(k0) OVER w END AS d0 FROM smooth WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {_d - 1} PRECEDING AND CURRENT ROW)),
led AS (SELECT symbol, day, k0, d0, lag(k0) OVER w AS k1, lag(k0, 2) OVER w AS k2, lag(d0) OVER w AS d1 FROM both_lines WHERE d0 IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day, round(CASE WHEN k1 IS NULL THEN k0 ELSE round(k0, 2) END, 1) AS stoch_k, round(CASE WHEN k1 IS NULL THEN d0 ELSE round(d0, 2) END, 1) AS stoch_d,
       CASE WHEN k1 < d1 AND k0 > d0 THEN 'golden' WHEN k1 > d1 AND k0 < d0 THEN 'dead' ELSE 'none' END AS "cross",
       CASE WHEN k0 - k1 > 0.5 AND k1 - k2 > 0.5 THEN 'rising' WHEN k0 - k1 < -0.5 AND k1 - k2 < -0.5 THEN 'falling' ELSE 'sideways' END AS direction,
       CASE WHEN k0 > 80 THEN 'overbought' WHEN k0 < 20 THEN 'oversold' ELSE 'neutral' END AS zone
FROM led"""


def indicator_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of all purchases told as text, from the daily bars of the user."""
    bought = t.table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("symbol"), F.col("ts").alias("traded_at"))
    out = wording.snapshot_text(b.trade_snapshots(bought, t.event_bars(spark, d)))
    return out.select("id", "symbol", "as_of", F.col("ma.alignment").alias("alignment"), F.col("candle.pattern").alias("pattern"), "text")


QUERIES["indicator_snapshots"] = indicator_snapshots


def _worded_sql(c: str, words: dict[str, str]) -> str:
    return f"CASE {c} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())} END"


def _last_stochastics_sql(frame: str, k: int, d: int, smooth: int) -> str:
    """The last told row of one parameter set for each (symbol, as_of)."""
    over, name = "PARTITION BY symbol, as_of ORDER BY day", f"{frame}_{k}"
    return f"""
raw_{name} AS (
  SELECT symbol, as_of, day, CASE WHEN count(low) OVER w = {k} THEN (close - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0) * 100 END AS raw_k
  FROM {frame}_history WINDOW w AS ({over} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)),
smooth_{name} AS (SELECT *, CASE WHEN count(raw_k) OVER w = {smooth} THEN avg(raw_k) OVER w END AS k0 FROM raw_{name} WINDOW w AS ({over} ROWS BETWEEN {smooth - 1} PRECEDING AND CURRENT ROW)),
lines_{name} AS (SELECT *, CASE WHEN count(k0) OVER w = {d} THEN avg(k0) OVER w END AS d0 FROM smooth_{name} WINDOW w AS ({over} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)),
led_{name} AS (SELECT symbol, as_of, day, k0, d0, lag(k0) OVER w AS k1, lag(k0, 2) OVER w AS k2, lag(d0) OVER w AS d1 FROM lines_{name} WHERE d0 IS NOT NULL WINDOW w AS ({over})),
last_{name} AS (
  SELECT symbol, as_of, k0, CASE WHEN k1 < d1 AND k0 > d0 THEN 'golden' WHEN k1 > d1 AND k0 < d0 THEN 'dead' ELSE 'none' END AS crossing,
         CASE WHEN k0 - k1 > 0.5 AND k1 - k2 > 0.5 THEN 'rising' WHEN k0 - k1 < -0.5 AND k1 - k2 < -0.5 THEN 'falling' ELSE 'sideways' END AS direction,
         CASE WHEN k0 > 80 THEN 'overbought' WHEN k0 < 20 THEN 'oversold' ELSE 'neutral' END AS zone
  FROM led_{name} QUALIFY row_number() OVER (PARTITION BY symbol, as_of ORDER BY day DESC) = 1)"""


def _frame_text_sql(frame: str) -> str:
    label = wording.FRAMES[frame]
    return f"""CASE WHEN {frame}.symbol IS NULL THEN '{label} 데이터부족' ELSE '{label} ' || CASE {frame}.rising WHEN 3 THEN '상승' WHEN 0 THEN '하락' ELSE '혼조' END || ' ' || {frame}.rising || '/3'
         || CASE WHEN {frame}.golden THEN ' 골든크로스' WHEN {frame}.dead THEN ' 데드크로스' ELSE '' END || CASE WHEN {frame}.bought THEN ' (과매수)' WHEN {frame}.sold THEN ' (과매도)' ELSE '' END END"""


_sets = [(frame, *sizes) for frame in wording.FRAMES for sizes in b.STOCHASTICS]
_buckets = ",\n".join(
    f"""{name}_history AS (
  SELECT symbol, as_of, {BUCKETS_SQL[name]} AS day, max(high) AS high, min(low) AS low, arg_max(close, day) AS close FROM daily_history GROUP BY symbol, as_of, 3)"""
    for name in BUCKETS_SQL
)
_set_rows = "\n  UNION ALL ".join(
    f"""SELECT '{frame}' AS frame, symbol, as_of, k0, coalesce(crossing, 'none') AS crossing, coalesce(direction, 'sideways') AS direction, coalesce(zone, 'neutral') AS zone
  FROM (SELECT symbol, as_of FROM {frame}_history GROUP BY symbol, as_of HAVING count(*) >= {b.LEAST_BARS[frame]}) LEFT JOIN last_{frame}_{k} USING (symbol, as_of)"""
    for frame, k, _, _ in _sets
)
SNAPSHOTS_SQL = f"""daily_history AS (
  SELECT m.symbol, m.as_of, day, open, high, low, close, volume FROM (SELECT DISTINCT symbol, as_of FROM wanted) m JOIN bars e ON e.symbol = m.symbol AND e.day BETWEEN m.as_of - {b.LOOKBACK_DAYS} AND m.as_of),
{_buckets},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY day DESC) AS r, lag(close) OVER w AS last_close, lag(high) OVER w AS last_high, lag(low) OVER w AS last_low
  FROM daily_history WINDOW w AS (PARTITION BY symbol, as_of ORDER BY day)),
averaged AS (
  SELECT symbol, as_of, count(*) AS n_bars, arg_min(close, r) AS close, {", ".join(f"CASE WHEN count(*) >= {p} THEN avg(close) FILTER (r <= {p}) END AS ma{p}" for p in b.AVERAGES)},
         max(volume) FILTER (r = 1) AS volume, avg(volume) FILTER (r BETWEEN 2 AND 21) AS usual_volume,
         avg(CASE WHEN last_close IS NOT NULL THEN greatest(high - low, abs(high - last_close), abs(low - last_close)) END) FILTER (r <= 14) AS atr
  FROM ranked GROUP BY symbol, as_of),
banded AS (
  SELECT symbol, as_of, day, close, r, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END * 2 AS spread
  FROM ranked WHERE r <= 39 WINDOW w AS (PARTITION BY symbol, as_of ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
shares AS (SELECT *, mid - spread AS lower, mid + spread AS upper, ((mid + spread) - (mid - spread)) / mid * 100 AS share FROM banded),
bands AS (
  SELECT symbol, as_of, max(CASE WHEN upper - lower > 0 THEN round((close - lower) / (upper - lower), 4) END) FILTER (r = 1) AS position,
         max(CASE WHEN mid > 0 THEN round(share, 4) END) FILTER (r = 1) AS bandwidth, CASE WHEN count(share) FILTER (r <= 20) = 20 THEN avg(share) FILTER (r <= 20) END AS usual
  FROM shares GROUP BY symbol, as_of),
{",".join(_last_stochastics_sql(*s) for s in _sets)},
set_rows AS (
  {_set_rows}),
sets AS (
  SELECT frame, symbol, as_of, count(*) FILTER (direction = 'rising') AS rising, bool_or(crossing = 'golden') AS golden, bool_or(crossing = 'dead') AS dead, bool_and(zone = 'overbought') AS bought, bool_and(zone = 'oversold') AS sold,
         bool_and(k0 IS NULL OR direction = 'rising') AS up, bool_and(k0 IS NULL OR direction = 'falling') AS down
  FROM set_rows GROUP BY 1, 2, 3),
told AS (
  SELECT a.symbol, a.as_of, round((a.close - ma20) / ma20 * 100, 4) AS deviation, position,
         CASE WHEN ma5 IS NULL THEN 'unknown' WHEN ma120 IS NULL THEN 'partial' WHEN ma5 > ma20 AND ma20 > ma60 AND ma60 > ma120 THEN 'bullish' WHEN ma5 < ma20 AND ma20 < ma60 AND ma60 < ma120 THEN 'bearish' ELSE 'mixed' END AS alignment,
         CASE WHEN bandwidth IS NULL OR n_bars < 40 THEN 'unknown' WHEN bandwidth > usual * 1.05 THEN 'expanding' WHEN bandwidth < usual * 0.95 THEN 'squeeze' ELSE 'neutral' END AS phase,
         CASE WHEN usual_volume > 0 THEN round((a.volume / usual_volume)::DECIMAL(38,10), 4)::DOUBLE END AS ratio,
         CASE WHEN last_close IS NULL THEN 'unknown' WHEN abs(l.close - open) > atr * 1.5 AND l.close > open THEN 'large_bullish' WHEN abs(l.close - open) > atr * 1.5 AND l.close < open THEN 'large_bearish'
              WHEN abs(l.close - open) < atr * 0.1 THEN 'doji' WHEN l.close > open THEN 'bullish' ELSE 'bearish' END AS pattern,
         CASE WHEN last_close IS NOT NULL THEN round((high - greatest(open, l.close)) / CASE WHEN high > low THEN high - low ELSE 1.0 END, 4) END AS shadow,
         CASE WHEN low > last_high THEN '갭 상승 후 ' WHEN high < last_low THEN '갭 하락 후 ' ELSE '' END AS gap,
         {_frame_text_sql("daily")}
         || ' | ' || {_frame_text_sql("weekly")}
         || ' | ' || {_frame_text_sql("monthly")}
         || CASE WHEN coalesce(daily.up, true) AND coalesce(weekly.up, true) AND coalesce(monthly.up, true) THEN ' → 방향 일치도 높음'
                 WHEN coalesce(daily.down, true) AND coalesce(weekly.down, true) AND coalesce(monthly.down, true) THEN ' → 하락 일치도 높음' ELSE '' END AS frames
  FROM averaged a JOIN bands USING (symbol, as_of) JOIN ranked l ON l.symbol = a.symbol AND l.as_of = a.as_of AND l.r = 1
  {" ".join(f"LEFT JOIN sets {frame} ON {frame}.frame = '{frame}' AND {frame}.symbol = a.symbol AND {frame}.as_of = a.as_of" for frame in wording.FRAMES)})
SELECT id, symbol, as_of, alignment, pattern,
       '▸ 스토캐스틱 정렬: ' || frames || chr(10)
       || '▸ 이평선: ' || {_worded_sql("alignment", wording.ALIGNMENTS)} || CASE WHEN deviation IS NULL THEN '' ELSE ', 20일선 ' || CASE WHEN deviation >= 0 THEN '지지 (괴리율 +' ELSE '저항 (괴리율 -' END || round(abs(deviation)::DECIMAL(18,4), 1) || '%)' END || chr(10)
       || '▸ 볼린저: ' || concat_ws(', ', CASE WHEN position IS NULL THEN '알수없음' WHEN position > 1.0 THEN '상단 돌파' WHEN position > 0.8 THEN '상단 근접' WHEN position > 0.5 THEN '중심선 상향' WHEN position > 0.2 THEN '중심선 하향'
            WHEN position >= 0 THEN '하단 근접' ELSE '하단 돌파' END, {_worded_sql("phase", wording.PHASES)}) || chr(10)
       || CASE WHEN ratio IS NULL THEN '▸ 거래량: 데이터부족' ELSE '▸ 거래량: 20일 평균 대비 ' || round_even(ratio * 100, 0)::BIGINT || '%' END || chr(10)
       || '▸ 캔들: ' || gap || {_worded_sql("pattern", wording.PATTERNS)} || ' 마감' || CASE WHEN shadow < 0.1 THEN ', 윗꼬리 짧음' WHEN shadow > 0.3 THEN ', 윗꼬리 김' ELSE '' END AS text
FROM wanted JOIN told USING (symbol, as_of)"""
ORACLE_SQL["indicator_snapshots"] = f"""WITH bars AS (
  SELECT user_id AS symbol, ts::DATE AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2),
wanted AS (SELECT event_id AS id, user_id AS symbol, ts::DATE AS as_of FROM events WHERE event_type = 'purchase'),
{SNAPSHOTS_SQL}"""


def flag_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of all days on which items of a return flag were shipped: symbols with a bar on nearly every day, so that every timeframe is told."""
    daily = t.bars(spark, d, "l_returnflag")
    days = daily.select(F.concat_ws(" ", "symbol", "day").alias("id"), "symbol", F.col("day").cast("timestamp").alias("traded_at"))
    out = wording.snapshot_text(b.trade_snapshots(days, daily))
    return out.select("id", "symbol", "as_of", F.col("ma.alignment").alias("alignment"), F.col("candle.pattern").alias("pattern"), "text")


QUERIES["flag_snapshots"] = flag_snapshots
ORACLE_SQL["flag_snapshots"] = f"""WITH {t.BARS_SQL.replace("l_suppkey AS symbol", "l_returnflag AS symbol")},
wanted AS (SELECT symbol || ' ' || day AS id, symbol, day AS as_of FROM bars),
{SNAPSHOTS_SQL}"""

# --- trade lists ----------------------------------------------------------------------------------------------------


def list_trades(spark: SparkSession, d: str) -> DataFrame:
    return trade_page(t.trades(spark, d), side="buy", date_from="1996-01-01", date_to="1997-12-31", limit=50, offset=20).select("id", "symbol", "side", "quantity", "price")


QUERIES["list_trades_page"] = list_trades
ORACLE_SQL["list_trades_page"] = f"""WITH {t.TRADES_SQL} SELECT id, symbol, side, quantity, {_money("c_price", 12)} AS price FROM trades
WHERE side = 'buy' AND traded_at >= TIMESTAMP '1996-01-01' AND traded_at <= TIMESTAMP '1997-12-31' ORDER BY traded_at DESC, id DESC LIMIT 50 OFFSET 20"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    return trade_stats(t.trades(spark, d), date_from="1996-01-01")


QUERIES["trade_stats"] = stats
ORACLE_SQL["trade_stats"] = f"""WITH {t.TRADES_SQL} SELECT count(*) AS total_count, count(*) FILTER (side = 'buy') AS buy_count, count(*) FILTER (side = 'sell') AS sell_count,
       {_money("coalesce(sum(c_amount), 0)", 20)} AS total_amount, {_money("coalesce(sum(c_fees), 0)", 20)} AS total_fees
FROM trades WHERE traded_at >= TIMESTAMP '1996-01-01'"""


def frequent_symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbol_frequency(t.trades(spark, d), 10)


QUERIES["symbol_frequency"] = frequent_symbols
ORACLE_SQL["symbol_frequency"] = f"""WITH {t.TRADES_SQL} SELECT symbol, count(*) AS n_trades, {_money("sum(c_amount)", 20)} AS amount FROM trades GROUP BY symbol ORDER BY n_trades DESC, symbol LIMIT 10"""


def chart_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Bars with the trades of their day."""
    marks = t.trades(spark, d).groupBy(F.col("broker").alias("symbol"), F.to_date("traded_at").alias("day")).agg(F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"))
    return t.bars(spark, d).join(marks, ["symbol", "day"], "left").select("symbol", "day", "close", F.coalesce("buys", F.lit(0)).alias("buys"), F.coalesce("sells", F.lit(0)).alias("sells"))


QUERIES["chart_overlay"] = chart_overlay
ORACLE_SQL["chart_overlay"] = f"""WITH {t.TRADES_SQL}, {t.BARS_SQL}, marks AS (SELECT broker AS symbol, traded_at::DATE AS day, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells FROM trades GROUP BY 1, 2)
SELECT symbol, day, close, coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells FROM bars LEFT JOIN marks USING (symbol, day)"""
