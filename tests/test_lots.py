from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from quillspark.operators import lots

SCHEMA = "id long, symbol string, side string, traded_at timestamp, price decimal(12,2), quantity int, fees decimal(14,2)"


def simulated(trades):
    """Walk each symbol with a queue; sales without open lots are dropped."""
    pairs, held = {}, {}
    for symbol in {t[1] for t in trades}:
        queue = deque()
        for id_, _, side, _, price, quantity, _ in sorted((t for t in trades if t[1] == symbol), key=lambda t: (t[3], t[0])):
            if side == "buy":
                queue.append([id_, quantity, price])
                continue
            while quantity and queue:
                n = min(quantity, queue[0][1])
                pairs[queue[0][0], id_] = n
                quantity -= n
                queue[0][1] -= n
                if not queue[0][1]:
                    queue.popleft()
        held[symbol] = [(b, q) for b, q, _ in queue]
    return pairs, held


def random_trades(seed, n=600):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [
        (k, f"s{rng.randrange(9)}", rng.choice(["buy", "sell"]), start + timedelta(hours=rng.randrange(400)), Decimal(rng.randrange(100, 9999)) / 100, rng.randrange(1, 60), Decimal(rng.randrange(300)) / 100)
        for k in range(n)
    ]


def test_pairs_equal_a_queue(spark):
    trades = random_trades(3)
    pairs, held = simulated(trades)
    df = spark.createDataFrame(trades, SCHEMA)
    for cell in (7, 4096):
        got = {(r["buy_trade_id"], r["sell_trade_id"]): r["matched_qty"] for r in lots.match_lots(df, cell).collect()}
        assert got == pairs
    open_now = {}
    for r in lots.open_lots(df).collect():
        open_now.setdefault(r["symbol"], []).append((r["buy_trade_id"], r["qty"]))
    assert {s: sorted(v) for s, v in open_now.items()} == {s: sorted(v) for s, v in held.items() if v}


def test_spans_of_any_length_walk_alike(spark):
    df = spark.createDataFrame(random_trades(11), SCHEMA)
    stretches = [sorted((r["symbol"], r["id"], r["bought"], r["inventory"], r["lo"], r["hi"]) for r in lots.walked(df, span).collect()) for span in ("year", "month", "day", "minute")]
    assert stretches[0] and all(s == stretches[0] for s in stretches)
    with pytest.raises(ValueError):
        lots.walked(df, "aeon")


def test_a_symbol_is_walked_by_many_tasks(spark):
    """One symbol: no window holds all its trades, only its spans."""
    df = spark.range(40_000).selectExpr("id", "if(id >= 0, 'a', 'b') AS symbol", "if(id % 3 = 0, 'sell', 'buy') AS side", "timestamp '2000-01-01' + make_interval(0, 0, 0, cast(id % 3000 AS int)) AS traded_at", "10.0BD AS price", "id % 7 + 1 AS quantity", "cast(0 AS decimal(14,2)) AS fees")
    plan = lots.walked(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol, span" in plan or "hashpartitioning(symbol#" in plan and "span#" in plan
    sizes = df.selectExpr("date_trunc('quarter', traded_at) AS span").groupBy("span").count()
    assert sizes.agg({"count": "max"}).first()[0] < 2_000


def test_changed_symbols_are_matched_anew(spark):
    trades = random_trades(5)
    df = spark.createDataFrame(trades, SCHEMA)
    stored = lots.match_lots(df)
    symbols = sorted({t[1] for t in trades if t[1]})
    changed = spark.createDataFrame([(symbols[0],), ("none",)], "symbol string")
    more = df.unionByName(spark.createDataFrame([(10**6, symbols[0], "buy", datetime(1990, 1, 1), Decimal(1), 5, None), (10**6 + 1, symbols[1], "buy", datetime(1990, 1, 1), Decimal(1), 5, None)], SCHEMA))
    key = lambda rows: sorted((r["symbol"], r["buy_trade_id"], r["sell_trade_id"], r["matched_qty"]) for r in rows)
    got = key(lots.rebuilt_pairs(stored, more, changed).collect())
    fresh, old = key(lots.match_lots(more).collect()), key(stored.collect())
    assert got == sorted([r for r in fresh if r[0] == symbols[0]] + [r for r in old if r[0] != symbols[0]]) and got != old


def test_a_broken_trade_counts_as_failure(spark):
    day = datetime(2024, 1, 1)
    rows = [(1, "a", "buy", day, Decimal(1), 2, None), (2, "a", "sell", day, Decimal(2), 1, None), (3, "b", "buy", day, None, 1, None), (4, "c", "buy", day, Decimal(1), 1, None)]
    assert sorted(map(tuple, lots.matched_counts(spark.createDataFrame(rows, SCHEMA)).collect())) == [("a", 1), ("b", -1), ("c", 0)]


def test_fees_and_rates_round_half_up(spark):
    day = datetime(2024, 1, 1, 10)
    rows = [(1, "a", "buy", day, Decimal("10.00"), 3, Decimal("1.00")), (2, "a", "sell", day + timedelta(hours=30), Decimal("11.00"), 2, Decimal("0.05")), (3, "a", "sell", day + timedelta(hours=31), Decimal("9.00"), 5, None)]
    got = {r["sell_trade_id"]: r for r in lots.match_lots(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2]["matched_qty"], got[2]["buy_fee"], got[2]["sell_fee"], got[2]["holding_days"]) == (2, Decimal("0.67"), Decimal("0.05"), 1)
    assert got[2]["profit_rate"] == Decimal("0.0640")
    assert (got[3]["matched_qty"], got[3]["net_profit"]) == (1, Decimal("-1.33"))


def test_empty_null_and_short_sales(spark):
    assert lots.match_lots(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, "buy", datetime(2024, 1, 1), Decimal(1), 1, None), (2, "a", "sell", datetime(2024, 1, 1), Decimal(1), 1, None), (3, "a", "buy", None, Decimal(1), 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert lots.match_lots(df).collect() == []
    assert [tuple(r) for r in lots.positions(df).collect()] == [("a", 0, Decimal("0.00"))]
