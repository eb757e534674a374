"""Kernels against hand-worked cases and naive loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import recurrences as R
from quernstone.operators import engines as G
from quernstone.operators import simulators as S
from quernstone.operators.indicator_scan import with_indicators
from quernstone.operators.sequential import ordered_scan
from quernstone.plans import spec as P
from quernstone.queries.simulators import GOLDEN, SHADOWED, STOPPED
from quernstone.queries.simulators import REGIME

SF = "/root/testdata/sf0.001"


def day(i):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=i)


def drive(kernel, rows):
    out = []
    for r in rows:
        out += kernel.push(r)
    return out + kernel.close()


def test_next_open_fill_and_costs():
    c = S.TraderConfig(cash=1000.0, fee=0.01, slip=0.0)
    rows = [(day(0), 10, 10, 10, 10, True, False, None), (day(1), 20, 20, 20, 20, False, True, None), (day(2), 30, 30, 30, 30, False, False, None)]
    (trade,) = drive(S.BarTrader(c), rows)
    assert trade[:5] == (day(0), day(1), day(2), 20, 30) and trade[8] == "signal"
    assert trade[7] == pytest.approx(30 * 0.99 / (20 * 1.01) - 1)
    assert trade[5] == pytest.approx(1000 / (20 * 1.01))


def test_stop_before_target_and_gaps():
    c = S.TraderConfig(fee=0, slip=0, stop=("percent", 0.1), target=("percent", 0.1))
    enter = (day(0), 100, 100, 100, 100, True, False, None)
    both = drive(S.BarTrader(c), [enter, (day(1), 100, 120, 80, 100, False, False, None)])
    assert both[0][8] == "stop_loss" and both[0][4] == 90
    gap = drive(S.BarTrader(c), [enter, (day(1), 100, 101, 99, 100, False, False, None), (day(2), 70, 75, 60, 70, False, False, None)])
    assert gap[0][4] == 70
    up = drive(S.BarTrader(c), [enter, (day(1), 100, 101, 99, 100, False, False, None), (day(2), 130, 131, 129, 130, False, False, None)])
    assert up[0][8] == "take_profit" and up[0][4] == 130


def test_trailing_stop_never_loosens_and_acts_next_bar():
    c = S.TraderConfig(fee=0, slip=0, stop=("trailing_percent", 0.1))
    rows = [(day(0), 100, 100, 100, 100, True, False, None), (day(1), 100, 200, 95, 150, False, False, None), (day(2), 190, 190, 185, 186, False, False, None), (day(3), 185, 186, 170, 175, False, False, None)]
    (t,) = drive(S.BarTrader(c), rows)
    assert t[2] == day(3) and t[4] == pytest.approx(180)


def test_last_bar_cannot_fill_and_end_of_data():
    c = S.TraderConfig(fee=0, slip=0)
    assert drive(S.BarTrader(c), [(day(0), 1, 1, 1, 1, False, False, None), (day(1), 1, 1, 1, 1, True, False, None)]) == []
    (t,) = drive(S.BarTrader(c), [(day(0), 1, 1, 1, 1, True, False, None), (day(1), 2, 2, 2, 4, False, True, None)])
    assert t[8] == "end_of_data" and t[4] == 4


def test_gate_on_trades_and_shadow_signals():
    c = S.TraderConfig(fee=0, slip=0, max_bars=1, gate=("signal", "last_would_have_lost", 1, False))
    px = [10, 10, 8, 8, 8, 12, 12, 12, 12]
    rows = [(day(i), p, p, p, p, i in (0, 4), False, None) for i, p in enumerate(px)]
    trades = drive(S.BarTrader(c), rows)  # the first signal is turned down, its shadow loses, so the second fires
    assert [t[0] for t in trades] == [day(4)]
    past = S.Past(returns=[0.1, -0.1, -0.2], exits=[1, 5, 9])
    assert past.trade_gate("consecutive_losses_at_least", 2, 10) and not past.trade_gate("consecutive_losses_at_least", 3, 10)
    assert past.trade_gate("last_lost", 1, 10) and not past.trade_gate("last_won", 1, 10)
    assert past.trade_gate("bars_since_last_at_least", 3, 12) and not past.trade_gate("bars_since_last_at_least", 4, 12)
    assert not S.Past().trade_gate("last_lost", 1, 10)


def test_funding_and_perp_stop():
    assert S.funding_cashflow(2.0, 100.0, 0.001) == pytest.approx(-0.2)
    k = S.TrendTrader(atr_multiple=1.0, warm=0, cash=1000.0, cost=0.0)
    rows = [(day(0), 100, 101, 99, 100, 100, None, 0, 5.0), (day(1), 100, 101, 99, 100, 100, None, 1, 5.0), (day(2), 100, 102, 99, 101, 101, 0.01, 1, 5.0), (day(3), 90, 91, 89, 90, 90, None, 1, 5.0)]
    (t,) = drive(k, rows)
    assert t[2] == 1 and t[8] == "stop" and t[4] == pytest.approx(-10 * 101 * 0.01) and t[3] == pytest.approx(10 * (90 - 100))


def test_vector_engine_agrees_with_decimal_ledger(spark):
    rnd = random.Random(5)
    px, rows = 100.0, []
    for i in range(200):
        px *= math.exp(rnd.gauss(0, 0.02))
        rows.append(("a", day(i), px, (i // 7) % 2))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, pos int")
    run = {r["ts"]: r["equity"] for r in G.vector_backtest(bars, 10.0).collect()}
    broker = S.DecimalBroker("1000000000", 10.0)
    flat = [(r[1], [x for x in broker.push((r[1], r[2], r[3]))][0][1] / 1e9, broker.units) for r in rows]
    for before, (ts, equity, units) in zip([None, *flat], flat):
        if not units:  # flat in both books
            assert run[ts] == pytest.approx(equity, rel=1e-6)


def test_portfolio_caps(spark):
    rows = [(s, day(0), 1, v) for s, v in (("a", 0.1), ("b", 0.1), ("c", None))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, pos int, vol double")
    got = {r["symbol"]: r["w"] for r in G.target_weights(df, "vol", 0.2, 0.8, 1.0).collect()}
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(0.5), "c": 0.0}


def test_recurrences_against_naive():
    rnd = random.Random(1)
    bars = [(c + rnd.random(), c - rnd.random(), c) for c in (100 + rnd.gauss(0, 3) for _ in range(120))]
    atr, tr, n = R.Atr(5), [], 5
    got = [atr.push(*b) for b in bars]
    for i, (h, low, c) in enumerate(bars):
        p = bars[i - 1][2] if i else None
        tr.append(h - low if p is None else max(h - low, abs(h - p), abs(low - p)))
    want = sum(tr[:n]) / n
    assert got[: n - 1] == [None] * (n - 1) and got[n - 1] == pytest.approx(want)
    for x, g in zip(tr[n:], got[n:]):
        want = (want * (n - 1) + x) / n
        assert g == pytest.approx(want)
    assert R.Rsi(3).push(1.0) is None
    rsi = R.Rsi(3)
    assert [rsi.push(float(x)) for x in (1, 2, 3, 4)][-1] == 100.0
    assert R.Rsi(3, research=True).push(1.0) is None


def test_adx_and_psar_follow_a_trend():
    adx, psar, st = R.Adx(5), R.Psar(), R.Supertrend(5)
    for i in range(60):
        a, p, m = adx.push(i + 1.0, i - 1.0, float(i))
        sar, d = psar.push(i + 1.0, i - 1.0, float(i))
        value, up = st.push(i + 1.0, i - 1.0, float(i))
    assert a > 90 and p > m and d == 1 and sar < 59 and up == 1 and value < 59
    for i in range(59, -1, -1):
        sar, d = psar.push(i + 1.0, i - 1.0, float(i))
        value, up = st.push(i + 1.0, i - 1.0, float(i))
    assert d == -1 and up == -1


def test_scan_is_the_same_in_any_layout(spark):
    rows = [(s, day(i), float(i), float(i % 7), float(i % 5)) for s in "abc" for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, high double, low double, close double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        small = with_indicators(df.repartition(7), {"e": ("ema", {"n": 5})}).orderBy("symbol", "ts").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == with_indicators(df.coalesce(1), {"e": ("ema", {"n": 5})}).orderBy("symbol", "ts").collect()


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "symbol string, ts timestamp_ntz, high double, low double, close double")
    assert with_indicators(df, {"e": ("ema", {"n": 5})}).collect() == []


def test_no_feature_looks_ahead(spark):
    from quernstone.queries.simulators import x10
    from quernstone.sources.bars import event_bars
    from unittest import mock

    whole = {(r["symbol"], r["ts"]): r for r in x10(spark, SF).collect()}
    bars = event_bars(spark, SF)
    cut = sorted({ts for _, ts in whole})[len({ts for _, ts in whole}) // 2]
    with mock.patch("quernstone.queries.simulators.event_bars", lambda *a: bars.where(F.col("ts") <= F.lit(cut))):
        part = x10(spark, SF).collect()
    assert part and all(whole[r["symbol"], r["ts"]] == r for r in part)


def test_stepper_agrees_with_batch(spark):
    from quernstone.queries.simulators import b1
    from quernstone.queries.streams import b3

    live = {(r["symbol"], r["entry_ts"]): round(r["ret"], 5) for r in b3(spark, SF).collect()}
    batch = {(r["symbol"], r["entry_ts"]): r["ret"] for r in b1(spark, SF).collect() if r["reason"] != "end_of_data"}
    assert live.keys() == batch.keys() and all(abs(live[k] - v) < 2e-5 for k, v in batch.items())


@pytest.mark.parametrize("spec, code", [
    (GOLDEN | {"position_sizing": {"mode": "risk_based", "risk_percent": 0.01}}, "risk_based_requires_stop_loss"),
    (GOLDEN | {"exit": {"exits": [{"type": "take_profit", "method": {"kind": "r_multiple", "r": 2}}]}}, "r_multiple_requires_stop_loss"),
    (GOLDEN | {"filter_timeframe": "1h"}, "filter_tf_must_be_higher"),
    (REGIME | {"schema_version": "1.0"}, "stateful_requires_schema_v2"),
    (GOLDEN | {"entry": {"condition": {"type": "rising", "series": {"kind": "price", "field": "close"}, "lookback": 5000}}}, "out_of_bounds:lookback"),
    (GOLDEN | {"entry": {"condition": {"type": "compare", "op": ">", "left": {"kind": "price", "field": "close"}, "right": {"kind": "ratchet", "source": {"kind": "ratchet", "source": {"kind": "price", "field": "high"}}}}}}, "ratchet_nested_unsupported"),
])
def test_documents_that_are_wrong(spark, spec, code):
    assert code in P.errors(spec)
    with pytest.raises(ValueError):
        P.signals(spec, None)


def test_documents_that_are_right():
    assert not P.errors(GOLDEN) and not P.errors(STOPPED) and not P.errors(SHADOWED)
    assert (P.tier(GOLDEN), P.tier(REGIME), P.tier(SHADOWED)) == (1, 2, 3)


def test_risk_ladder_order():
    k = S.RiskLadder(100.0)
    judge = lambda *r: k.push(r)[0][1:]
    assert judge(1, "EXIT", "a", False, 999, 0, 1, 1) == (True, "exit")
    assert judge(2, "SELL", "a", True, 0, 1, 1, 1) == (False, "sell_blocked")
    assert judge(3, "BUY", "a", False, 999, 1, 1, 1) == (False, "disabled")
    assert judge(4, "BUY", "a", True, 999, 1, 1, 1) == (False, "stale_data")
    assert judge(5, "BUY", "a", True, 0, 1, 40, 37) == (True, "approved")
    assert judge(6, "BUY", "b", True, 0, 1, 40, 37) == (False, "total_risk")
    assert judge(7, "BUY", "a", True, 0, 1, 20, 19) == (False, "symbol_exposure")
    assert S.RiskLadder(1.0, kill=True).push((1, "BUY", "a", True, 0, 1, 1, 1))[0][2] == "kill_switch"


def test_guards_kill_for_good_and_halt_for_a_day():
    d = 86_400_000_000
    g = S.Guards(drawdown=0.5, daily=0.1, trades=9, cooldown_h=0)
    say = lambda t, e: g.push((t, "a", e))[0][3]
    assert say(0, 100.0) == "allowed" and say(1, 85.0) == "daily_halt" and say(2, 100.0) == "daily_halt"
    assert say(d, 90.0) == "allowed" and say(d + 1, 40.0) == "drawdown_kill" and say(2 * d, 100.0) == "drawdown_kill"


def test_overlay_defers_then_skips():
    rows = [(0, 0, False), (1, 1, False), (2, 1, False), (3, 1, True), (4, 1, False), (5, 0, True), (6, 1, False), (7, 1, False), (8, 1, False), (9, 1, True), (10, 0, True)]
    got = drive(S.Overlay(defers=2), rows)
    assert [x[1] for x in got] == [0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0]
    assert [x[2] for x in got if x[2]] == ["DEFER", "DEFER", "ALLOW", "DEFER", "DEFER", "SKIP"]


def test_continuity():
    got = drive(S.Continuity(), [(1, 5), (6, 9), (3, 8), (20, 25), (26, 30)])
    assert [x[2] for x in got] == ["apply", "apply", "skip", "resync", "apply"]


def test_scan_keys_start_anew(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, t int, x int")

    class Count:
        def __init__(self, key):
            self.n = 0

        def push(self, row):
            self.n += 1
            return [(self.n, row[0])]

        def close(self):
            return [(-self.n, 0)]

    got = sorted(tuple(r) for r in ordered_scan(df, ["k"], ["t"], ["x"], Count, "n int, x int").collect())
    assert got == [("a", -2, 0), ("a", 1, 5), ("a", 2, 6), ("b", -1, 0), ("b", 1, 7)]


CLOSE, LONG = {"kind": "price", "field": "close"}, {"schema_version": "1.0", "primary_timeframe": "1d", "direction": "long"}


def indicator(name, component=None, **params):
    return {"kind": "indicator", "name": name, "params": params} | ({"component": component} if component else {})


def above(left, right, kind="compare", **more):
    return {"type": kind, **({"left": left, "op": ">", "right": right} if kind == "compare" else {"series": left, "threshold": right, "direction": "above"}), **more}


def document(condition, exits, **more):
    return LONG | {"entry": {"condition": condition, "order_type": "market"}, "exit": {"exits": exits}} | more


STOP = {"type": "stop_loss", "method": {"kind": "percent", "value": 0.05}}
ATR_STOP = {"type": "stop_loss", "method": {"kind": "atr_multiple", "atr_period": 14, "mult": 1.5}}
TOP = {"kind": "lagged", "expression": indicator("highest", period=20, source="high"), "bars_ago": 1}
LATCH = {"type": "regime_state", "enter_when": above(CLOSE, indicator("ema", period=50), "crossover"), "exit_when": above(CLOSE, indicator("ema", period=50), "crossover", direction="below"), "initial": False}
GOOD = {
    "cross": document(above(indicator("sma", period=5), indicator("sma", period=20), "crossover"), [{"type": "condition", "condition": above(indicator("sma", period=5), indicator("sma", period=20), "crossover", direction="below")}], position_sizing={"mode": "fixed_percent_equity", "percent": 1.0}),
    "rsi": document(above(indicator("rsi", period=14), {"kind": "constant", "value": 30}, "crossover", direction="below"), [{"type": "condition", "condition": above(indicator("rsi", period=14), {"kind": "constant", "value": 70}, "crossover")}, STOP]),
    "breakout": document({"type": "and", "conditions": [above(CLOSE, TOP), above({"kind": "price", "field": "volume"}, indicator("volume_sma", period=20))]}, [ATR_STOP, {"type": "take_profit", "method": {"kind": "r_multiple", "r": 2}}], position_sizing={"mode": "risk_based", "risk_percent": 0.01}),
    "slower": document({"type": "and", "conditions": [{"type": "rising", "series": indicator("ema", period=50), "lookback": 5, "strict": False, "timeframe": "4h"}, {"type": "within_last_n_bars", "n": 3, "condition": above(indicator("ema", period=20), {"kind": "price", "field": "low"})}, {"type": "candle_pattern", "pattern": "bullish_engulfing"}]}, [ATR_STOP], primary_timeframe="1h", filter_timeframe="4h"),
    "bands": document(above(CLOSE, indicator("bollinger", "upper", period=20, std_dev=2.0)), [{"type": "stop_loss", "method": {"kind": "trailing_percent", "value": 0.02}}, {"type": "time", "max_bars_held": 48}], position_sizing={"mode": "fixed_quantity", "quantity": 0.5}),
    "short": document(above(indicator("ema", period=50), indicator("ema", period=20)), [{"type": "condition", "condition": above(indicator("ema", period=20), indicator("ema", period=50), "crossover")}, ATR_STOP], direction="short", position_sizing={"mode": "risk_based", "risk_percent": 0.015}),
    "limit": document(above(indicator("macd", "hist", fast=12, slow=26, signal=9), {"kind": "constant", "value": 0}, "crossover"), [STOP, {"type": "take_profit", "method": {"kind": "percent", "value": 0.06}}], filters=[{"type": "session", "hours_utc": [0, 21]}, {"type": "weekday", "days": [1, 2, 3, 4, 5]}]) ,
    "vwap": document({"type": "and", "conditions": [above(indicator("vwap", session_anchored=True), CLOSE), {"type": "not", "condition": above({"kind": "scaled", "expression": indicator("volume_sma", period=20), "factor": 0.5}, {"kind": "price", "field": "volume"})}]}, [STOP, {"type": "condition", "condition": above(CLOSE, indicator("vwap", session_anchored=True), op=">=")}]),
    "latch": document({"type": "and", "conditions": [LATCH, above(indicator("ema", period=20), indicator("ema", period=50), "crossover")]}, [ATR_STOP], schema_version="2.0"),
    "turtle": document({"type": "and", "conditions": [above(CLOSE, TOP), {"type": "not", "condition": {"type": "prior_signal", "predicate": "last_would_have_won"}}]}, [{"type": "stop_loss", "method": {"kind": "atr_multiple", "atr_period": 14, "mult": 2}}, {"type": "condition", "condition": above({"kind": "lagged", "expression": indicator("lowest", period=10, source="low"), "bars_ago": 1}, CLOSE)}], schema_version="2.0", position_sizing={"mode": "fixed_percent_equity", "percent": 0.5}),
    "nulls": document(above(indicator("sma", period=5, source=None, fast=None), indicator("sma", period=20), "crossover", timeframe=None), [STOP], costs={"slippage_pct": 0.0005, "commission_pct": 0.001}, filters=[], name=None),
}
GOOD["limit"]["entry"] |= {"order_type": "limit", "limit_offset_pct": -0.001}
RATCHET = {"kind": "ratchet", "source": CLOSE, "extremum": "max", "reset": "never"}
BAD = {
    "r_multiple_requires_stop_loss": document(above(CLOSE, indicator("sma", period=20)), [{"type": "take_profit", "method": {"kind": "r_multiple", "r": 2}}]),
    "risk_based_requires_stop_loss": document(above(CLOSE, indicator("sma", period=20)), [{"type": "take_profit", "method": {"kind": "percent", "value": 0.05}}], position_sizing={"mode": "risk_based", "risk_percent": 0.01}),
    "filter_tf_must_be_higher": document(above(CLOSE, indicator("sma", period=20)), [STOP], primary_timeframe="4h", filter_timeframe="15m"),
    "indicator_param_out_of_bounds": document(above(indicator("rsi", period=1), {"kind": "constant", "value": 30}, "crossover"), [STOP]),
    "stateful_requires_schema_v2": document(LATCH, [STOP]),
    "ratchet_nested_unsupported": document(above(CLOSE, RATCHET | {"source": RATCHET}), [STOP], schema_version="2.0"),
    "per_trade_ratchet_not_supported": document(above(CLOSE, TOP), [{"type": "condition", "condition": above({"kind": "scaled", "expression": RATCHET | {"reset": "per_trade"}, "factor": 0.9}, CLOSE)}], schema_version="2.0"),
    "direction_unknown": GOOD["cross"] | {"direction": "both"},
    "costs_out_of_bounds": GOOD["cross"] | {"costs": {"commission_pct": 0.2}},
    "legs_not_supported": GOOD["cross"] | {"legs": [{"symbol": "A"}]},
    "limit_offset_required": GOOD["cross"] | {"entry": GOOD["cross"]["entry"] | {"order_type": "limit"}},
    "limit_offset_forbidden": GOOD["cross"] | {"entry": GOOD["cross"]["entry"] | {"limit_offset_pct": 0.001}},
    "indicator_component_required": document(above(indicator("macd", fast=12, slow=26, signal=9), CLOSE), [STOP]),
    "indicator_param_missing": document(above(indicator("supertrend", "value", atr_period=10), CLOSE), [STOP]),
    "indicator_param_unknown": document(above(indicator("keltner", "upper", period=20, atr_period=10, multiplier=2.0, mult=2.0), CLOSE), [STOP]),
    "macd_slow_must_exceed_fast": document(above(indicator("macd", "line", fast=26, slow=12, signal=9), CLOSE), [STOP]),
    "indicator_unknown": document(above(indicator("ichimoku", period=9), CLOSE), [STOP]),
}


@pytest.mark.parametrize("name", GOOD)
def test_documents_of_every_shape_run(spark, name):
    from quernstone.sources.bars import daily_bars, event_bars

    assert P.errors(GOOD[name]) == []
    bars = (event_bars if GOOD[name]["primary_timeframe"] == "1h" else daily_bars)(spark, SF)
    rows = P.backtest(GOOD[name], bars).collect()
    assert all(math.isfinite(r["ret"]) for r in rows)


@pytest.mark.parametrize("code", BAD)
def test_unsupported_documents_are_rejected(code):
    assert code in P.errors(BAD[code])
    with pytest.raises(ValueError, match=code):
        P.signals(BAD[code], None)


def test_a_short_position_mirrors_a_long_one():
    """Stops lie above, targets below; it gains where prices fall."""
    enter = (day(0), 100, 100, 100, 100, True, False, None)
    c = S.TraderConfig(fee=0, slip=0, side=-1, stop=("percent", 0.1), target=("percent", 0.2))
    (hit,) = drive(S.BarTrader(c), [enter, (day(1), 100, 105, 95, 100, False, False, None), (day(2), 100, 112, 79, 100, False, False, None)])
    assert hit[8] == "stop_loss" and hit[4] == pytest.approx(110) and hit[7] == pytest.approx(-0.1)
    (won,) = drive(S.BarTrader(c), [enter, (day(1), 100, 105, 95, 100, False, False, None), (day(2), 90, 91, 75, 80, False, False, None)])
    assert won[8] == "take_profit" and won[4] == pytest.approx(80) and won[7] == pytest.approx(0.2)
    trail = S.TraderConfig(fee=0, slip=0, side=-1, stop=("trailing_percent", 0.1))
    (t,) = drive(S.BarTrader(trail), [enter, (day(1), 100, 101, 50, 60, False, False, None), (day(2), 54, 56, 52, 53, False, False, None)])
    assert t[8] == "stop_loss" and t[4] == pytest.approx(55)
    costs = S.TraderConfig(cash=1000.0, fee=0.01, slip=0.0, side=-1)
    (paid,) = drive(S.BarTrader(costs), [enter, (day(1), 100, 100, 100, 100, False, True, None), (day(2), 50, 50, 50, 50, False, False, None)])
    assert paid[6] == pytest.approx(paid[5] * (100 * 0.99 - 50 * 1.01))
    equity = drive(S.BarTrader(costs, equity=True), [enter, (day(1), 100, 100, 100, 100, False, True, None), (day(2), 50, 50, 50, 50, False, False, None)])
    assert equity[-1][1] == pytest.approx(1000 + paid[6])


def test_scans_keep_values_as_they_are(spark):
    """Large numbers beside a null, and a null key, which is one series."""
    big = 2**53 + 1

    class Count:
        def __init__(self, key):
            self.n = 0

        def push(self, row):
            self.n += 1
            return [(self.n, row[0])]

        def close(self):
            return []

    df = spark.createDataFrame([(None, i, big + i if i % 2 else None) for i in range(5)] + [(big, i, big) for i in range(4)], "k long, at long, v long").coalesce(1)
    rows = ordered_scan(df, ["k"], ["at"], ["v"], Count, "n int, v long").collect()
    assert sorted((str(r["k"]), r["n"], str(r["v"])) for r in rows) == sorted([("None", i + 1, str(big + i if i % 2 else None)) for i in range(5)] + [(str(big), i + 1, str(big)) for i in range(4)])
