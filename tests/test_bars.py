from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import duckdb
import pandas as pd
import pytest

from quillspark.operators import bars as b
from quillspark.operators.snapshot_text import snapshot_text

SCHEMA = "symbol string, day date, open double, high double, low double, close double, volume double"


def walk(n=160, seed=5):
    rng, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        o = price
        price = max(1.0, price + rng.uniform(-3, 3))
        out.append(("a", date(2023, 1, 2) + timedelta(days=k), o, max(o, price) + rng.random(), min(o, price) - rng.random(), price, float(rng.randrange(1, 99))))
    return out


def frame(rows):
    return pd.DataFrame([r[1:] for r in rows], columns=["day", "open", "high", "low", "close", "volume"]).set_index("day")


def test_averages_and_stochastic_against_pandas(spark):
    rows = walk()
    df, p = spark.createDataFrame(rows, SCHEMA), frame(rows)
    got = b.moving_averages(df).orderBy("day").toPandas()
    for n in b.AVERAGES:
        assert got[f"ma{n}"].tolist() == pytest.approx(p["close"].rolling(n).mean().tolist(), nan_ok=True)
    k, d, smooth = 10, 6, 6
    raw = (p["close"] - p["low"].rolling(k).min()) / (p["high"].rolling(k).max() - p["low"].rolling(k).min()) * 100
    full = raw.rolling(smooth).mean()
    slow = full.rolling(d).mean().dropna()
    told = b.stochastic(df, k, d, smooth).orderBy("day").toPandas()
    assert told["day"].tolist() == slow.index.tolist()
    assert told["stoch_d"].tolist() == pytest.approx(slow.tolist(), abs=0.006)


def test_weekly_and_monthly_buckets(spark):
    rows = walk(40)
    p = frame(rows)
    p.index = pd.to_datetime(p.index)
    weekly = p.resample("W-FRI").agg({"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"})
    got = b.weekly(spark.createDataFrame(rows, SCHEMA)).orderBy("day").toPandas()
    assert got["day"].tolist() == [x.date() for x in weekly.index]
    assert got["close"].tolist() == weekly["close"].tolist()
    assert got["volume"].tolist() == weekly["volume"].tolist()


def test_snapshot_looks_back_only(spark):
    rows = walk(160)
    trades = spark.createDataFrame([(1, "a", datetime(2023, 5, 1, 10)), (2, "a", datetime(2022, 1, 1)), (3, None, datetime(2023, 5, 1))], "id long, symbol string, traded_at timestamp")
    df = spark.createDataFrame(rows, SCHEMA)
    got = snapshot_text(b.trade_snapshots(trades, df)).collect()
    assert [r["id"] for r in got] == [1]
    p = frame([r for r in rows if r[1] <= date(2023, 5, 1)])
    assert got[0]["ma"]["ma20"] == pytest.approx(p["close"].tail(20).mean())
    assert len(got[0]["daily"]) == 3 and len(got[0]["weekly"]) == 3 and got[0]["monthly"][2]["values"]["stoch_k"] is None
    assert got[0]["text"].count("\n") == 4


def test_empty_and_null_bars(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (b.weekly, b.moving_averages, b.bollinger, b.volume_ratio, b.candles):
        assert f(empty).collect() == []
    holes = spark.createDataFrame([("a", date(2024, 1, 1), None, 1.0, 1.0, None, 1.0), (None, date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), ("a", date(2024, 1, 8), 2.0, 3.0, 1.0, 2.5, 1.0)], SCHEMA)
    assert [r["day"] for r in b.weekly(holes).collect()] == [date(2024, 1, 12)]


def test_averages_walk_no_long_frame(spark):
    """Longer averages are added up from shorter ones, with nulls left out and values of any size beside each other."""
    rng = random.Random(11)
    closes = {"a": [rng.choice([None, rng.uniform(1, 9), 1e12, 0.01]) for _ in range(400)], "b": [None] * 130 + [3.0], "c": [float("nan")] + [2.0] * 125, "d": [1.0] * 4}
    rows = [(s, date(2020, 1, 1) + timedelta(days=k), 1.0, 1.0, 1.0, c, 1.0) for s, several in closes.items() for k, c in enumerate(several)]
    averages = b.moving_averages(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert "RowFrame, -119" not in averages._jdf.queryExecution().executedPlan().toString()
    got = {(r["symbol"], r["day"]): r for r in averages.collect()}
    assert len(got) == len(rows)
    for symbol, several in closes.items():
        for k in range(len(several)):
            r = got[symbol, date(2020, 1, 1) + timedelta(days=k)]
            for p in b.AVERAGES:
                told = [c for c in several[k + 1 - p : k + 1] if c is not None] if k + 1 >= p else []
                assert r[f"ma{p}"] == (pytest.approx(sum(told) / len(told), rel=1e-12, nan_ok=True) if told else None)


def closes_at_a_tie(rng, size):
    """Closes in whole cents whose last one deviates from their average by a multiple of 100/128 per cent: five decimals, the last a 5."""
    while True:
        k, part = rng.randrange(65, 256, 2), rng.randrange(1_000, 40_000)
        cents = [rng.randrange(90_000, 10_500_000) for _ in range(size - 1)]
        missing = 128 * part * size - k * part - sum(cents)
        for i in range(size - 1):
            step = max(90_000 - cents[i], min(10_499_999 - cents[i], missing))
            cents[i], missing = cents[i] + step, missing - step
        if not missing:
            rng.shuffle(cents)
            return [c / 100 for c in (*cents, k * part)]


def test_deviations_at_ties_are_those_of_sql(spark):
    """Where the exact deviation ends in a 5, the order of sums and the rule of rounding decide; so does SQL for each symbol."""
    rng = random.Random(2)
    closes = {k: closes_at_a_tie(rng, rng.choice([5, 20])) for k in range(120)} | {120: [8.0] * 4 + [7.9999999], 121: [2.0] * 4 + [2.0000001]}
    rows = [(str(s), date(2020, 1, 1) + timedelta(days=k), 1.0, 1.0, 1.0, c, 1.0) for s, several in closes.items() for k, c in enumerate(several)]
    told = {(r["symbol"], r["day"]): (str(r["deviation5"]), str(r["deviation20"])) for r in b.moving_averages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE bars (symbol VARCHAR, day DATE, close DOUBLE)")
    con.executemany("INSERT INTO bars VALUES (?, ?, ?)", [(s, day, c) for s, day, _, _, _, c, _ in rows])
    wanted = {}
    for s in closes:  # each alone: among other symbols SQL's own sums of 16 rows and more depend on where its rows lie
        averages = ", ".join(f"CASE WHEN count(*) OVER w{p} = {p} THEN avg(close) OVER w{p} END AS ma{p}" for p in (5, 20))
        frames = ", ".join(f"w{p} AS (ORDER BY day ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)" for p in (5, 20))
        sql = f"SELECT day, round((close - ma5) / ma5 * 100, 4), round((close - ma20) / ma20 * 100, 4) FROM (SELECT day, close, {averages} FROM bars WHERE symbol = '{s}' WINDOW {frames})"
        wanted |= {(str(s), day): (str(a), str(z)) for day, a, z in con.execute(sql).fetchall()}
    assert told == wanted
    assert told["120", date(2020, 1, 5)][0] == "-0.0"


def test_averages_have_the_digits_of_plain_sums(spark):
    rng = random.Random(4)
    closes = {s: [rng.choice([None, rng.uniform(900, 105_000), rng.uniform(1e-3, 1)]) for _ in range(300)] for s in "ab"}
    rows = [(s, date(2020, 1, 1) + timedelta(days=k), 1.0, 1.0, 1.0, c, 1.0) for s, several in closes.items() for k, c in enumerate(several)]
    got = {(r["symbol"], r["day"]): r for r in b.moving_averages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for s, several in closes.items():
        for k in range(len(several)):
            for p in b.AVERAGES:
                given, total = [c for c in several[max(0, k - p + 1) : k + 1] if c is not None], 0.0
                for c in given:
                    total += c
                assert got[s, date(2020, 1, 1) + timedelta(days=k)][f"ma{p}"] == (total / len(given) if k + 1 >= p and given else None)


def test_a_deviation_of_nothing_has_one_sign_in_words(spark):
    rows = [("a", date(2023, 1, 2) + timedelta(days=k), 2.0, 2.0, 2.0, c, 1.0) for k, c in enumerate([2.0] * 39 + [1.9999999])]
    trades = spark.createDataFrame([(1, "a", datetime(2023, 2, 10, 10))], "id long, symbol string, traded_at timestamp")
    got = snapshot_text(b.trade_snapshots(trades, spark.createDataFrame(rows, SCHEMA))).collect()[0]
    assert str(got["ma"]["deviation20"]) == "-0.0" and "20일선 지지 (괴리율 +0.0%)" in got["text"]


def test_positions_in_bands_have_the_signs_of_sql(spark):
    """A close just under the lower band has the position -0.0, as SQL rounds it."""
    closes = [90.0, 110.0] * 9 + [110.0]
    # the last close lies a little under the lower band of its 20 bars: mean less two deviations
    low, high = 0.0, 90.0
    for _ in range(60):
        mid = (low + high) / 2
        p = pd.Series([*closes, mid])
        low, high = (mid, high) if mid < p.mean() - 2 * p.std(ddof=0) else (low, mid)
    rows = [("a", date(2020, 1, 1) + timedelta(days=k), 1.0, 1.0, 1.0, c, 1.0) for k, c in enumerate([*closes, low - 1e-4])]
    got = b.bollinger(spark.createDataFrame(rows, SCHEMA)).orderBy("day").collect()[-1]
    con = duckdb.connect()
    mid, spread = con.execute(f"SELECT avg(x), 2 * stddev_pop(x) FROM (SELECT unnest({[r[5] for r in rows]}::DOUBLE[]) AS x)").fetchone()
    sql = "SELECT round((? - (? - ?)) / ((? + ?) - (? - ?)), 4)"
    assert str(got["position"]) == str(con.execute(sql, [rows[-1][5], mid, spread, mid, spread, mid, spread]).fetchone()[0]) == "-0.0"
