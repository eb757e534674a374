"""Averages and latches over chunks of a series, against one walk along it."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import recurrences as R
from quernstone.operators import affine
from quernstone.operators.affine import cut, with_smoothed
from quernstone.operators.speculative import speculative_scan
from quernstone.operators.indicator_scan import Stamped

BARS = "symbol string, ts timestamp_ntz, high double, low double, close double"


def bars_of(n, seed, gap=1):
    """One symbol of n daily bars, and a short one, with stretches that don't move at all."""
    draw = np.random.default_rng(seed)
    moves = draw.normal(0, 1, n) * (draw.random(n) < 0.8)
    close = 100 + np.cumsum(moves)
    rows = []
    for symbol, some in (("long", n), ("short", 9)):
        for i in range(some):
            c = float(close[i])
            rows.append((symbol, dt.datetime(2000, 1, 1) + dt.timedelta(days=gap * i), c + float(i % 3) / 2, c - float(i % 5) / 3, c))
    return rows


@pytest.fixture(scope="module")
def rows():
    return bars_of(900, 1)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(affine, "CHUNK", 37)
    monkeypatch.setattr(affine, "BUCKET_DAYS", 100)


def walked(rows, make):
    out, states = {}, {}
    for symbol, ts, high, low, close in sorted(rows):
        state = states.setdefault(symbol, make())
        got = state.push(close) if isinstance(state, R.Ema | R.Rsi | R.Macd) else state.push(high, low, close)
        out[symbol, ts] = got if isinstance(got, tuple) else (got,)
    return out


CASES = {
    "ema": (("ema", {"n": 20}), lambda: R.Ema(20), ["x"]),
    "fast": (("ema", {"n": 2, "warm": False}), lambda: R.Ema(2, False), ["x"]),
    "plain": (("ema", {"n": 1}), lambda: R.Ema(1), ["x"]),
    "slow": (("ema", {"n": 400}), lambda: R.Ema(400), ["x"]),
    "atr": (("atr", {"n": 14}), lambda: R.Atr(14), ["x"]),
    "atr_wide": (("atr", {"n": 120}), lambda: R.Atr(120), ["x"]),
    "research": (("research_atr", {"n": 14}), lambda: R.ResearchAtr(14), ["x"]),
    "rsi": (("rsi", {"n": 14}), lambda: R.Rsi(14), ["x"]),
    "rsi_research": (("rsi", {"n": 3, "research": True}), lambda: R.Rsi(3, True), ["x"]),
    "macd": (("macd", {}), lambda: R.Macd(), ["x_line", "x_signal", "x_histogram"]),
    "keltner": (("keltner", {"n": 20, "atr": 14, "multiple": 2.0}), lambda: R.Keltner(20, 14, 2.0), ["x_upper", "x_middle", "x_lower"]),
    "adx": (("adx", {"n": 14}), lambda: R.Adx(14), ["x_value", "x_plus", "x_minus"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_averages(spark, rows, small, name):
    """Series of many chunks and of less than one, to nine digits."""
    wanted, make, columns = CASES[name]
    df = spark.createDataFrame(rows, BARS).repartition(3)
    want = walked(rows, make)
    got = {(r["symbol"], r["ts"]): tuple(r[c] for c in columns) for r in with_smoothed(df, {"x": wanted}).collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert (a is None) == (b is None), (key, got[key], values)
            assert a is None or abs(a - b) <= 1e-9 * (1 + abs(b)), (key, got[key], values)


def test_several_at_once_keep_other_columns(spark, rows, small):
    df = spark.createDataFrame(rows, BARS).withColumn("kept", F.col("close") * 2)
    got = with_smoothed(df, {"a": ("ema", {"n": 5}), "m": ("macd", {}), "r": ("rsi", {"n": 14}), "d": ("adx", {"n": 7})})
    assert got.columns == [*df.columns, "a", "m_line", "m_signal", "m_histogram", "r", "d_value", "d_plus", "d_minus"]
    assert got.count() == len(rows) and got.where("kept = close * 2").count() == len(rows)
    want = walked(rows, lambda: R.Ema(5))
    assert all(abs(r["a"] - want[r["symbol"], r["ts"]][0]) < 1e-9 for r in got.collect() if r["a"] is not None)


def test_gaps_and_empty_tables(spark, small):
    """Bars a month apart leave most buckets empty; a table without bars gives none."""
    rows = bars_of(200, 3, gap=31)
    want = walked(rows, lambda: R.Atr(14))
    got = with_smoothed(spark.createDataFrame(rows, BARS), {"x": ("atr", {"n": 14})}).collect()
    assert all((r["x"] is None) == (want[r["symbol"], r["ts"]][0] is None) and (r["x"] is None or abs(r["x"] - want[r["symbol"], r["ts"]][0]) < 1e-9) for r in got)
    assert with_smoothed(spark.createDataFrame([], BARS), {"x": ("macd", {}), "y": ("adx", {})}).collect() == []


TURN = "ts timestamp_ntz, value double, direction double"


@pytest.mark.parametrize("kind", ["psar", "bands"])
def test_latches(spark, rows, small, kind):
    """Stop and reverse rules: the same as one walk, to the last digit."""
    make = R.Psar if kind == "psar" else lambda: R.Supertrend(14, 3.0)
    want = walked(rows, make)
    df = spark.createDataFrame(rows, BARS)
    if kind == "psar":
        out = speculative_scan(cut(df, ("symbol",)), ["symbol"], "ts", ["ts", "high", "low", "close"], lambda key: Stamped(R.Psar()), TURN)
    else:
        ranged = with_smoothed(df, {"atr": ("atr", {"n": 14})})
        out = speculative_scan(cut(ranged, ("symbol",)), ["symbol"], "ts", ["ts", "high", "low", "close", "atr"], lambda key: Stamped(R.Bands(3.0)), TURN)
    got = {(r["symbol"], r["ts"]): (r["value"], r["direction"]) for r in out.collect()}
    assert set(got) == set(want)
    for key, (value, direction) in want.items():
        assert (got[key][0] is None) == (value is None) and (value is None or abs(got[key][0] - value) < 1e-9) and got[key][1] == direction, key


def test_long_chunks(spark, rows, small, monkeypatch):
    """Numbers run on across buckets, so chunks are full whatever the gaps; a rule over them is the same as one walk."""
    from quernstone.operators import speculative
    from quernstone.operators.indicator_scan import turning

    monkeypatch.setattr(speculative, "LONG", 50)
    df = spark.createDataFrame(rows, BARS)
    sizes = {(r["symbol"], r["_chunk"]): r["count"] for r in speculative.long_chunks(df, ("symbol",)).groupBy("symbol", "_chunk").count().collect()}
    assert sizes == {("short", 0): 9} | {("long", i): 50 for i in range(18)}
    want = walked(rows, R.Psar)
    got = {(r["symbol"], r["ts"]): (r["p_value"], r["p_direction"]) for r in turning(df, "p", "psar", {}).collect()}
    assert got == want


class Sum:
    """A state that never meets: every chunk's end depends on all before it."""

    def __init__(self):
        self.total = 0.0

    def push(self, row):
        self.total += row[1]
        return [(row[0], self.total)]


def test_walks_that_never_meet(spark, small):
    """Each round is right for one more chunk, so even a running sum comes out; too few rounds are an error."""
    rows = bars_of(120, 5)
    df = cut(spark.createDataFrame(rows, BARS), ("symbol",))
    got = {(r["symbol"], r["ts"]): r["total"] for r in speculative_scan(df, ["symbol"], "ts", ["ts", "close"], lambda key: Sum(), "ts timestamp_ntz, total double").collect()}
    for symbol in ("long", "short"):
        total = 0.0
        for r in sorted(r for r in rows if r[0] == symbol):
            total += r[4]
            assert abs(got[symbol, r[1]] - total) < 1e-9
    with pytest.raises(RuntimeError, match="not met"):
        speculative_scan(df, ["symbol"], "ts", ["ts", "close"], lambda key: Sum(), "ts timestamp_ntz, total double", most_rounds=1)
