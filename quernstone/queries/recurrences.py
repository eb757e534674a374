"""Recurrent indicators. Their SQL walks the series with recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import conditions as C
from quernstone.operators.affine import with_smoothed
from quernstone.operators.indicator_scan import turning
from quernstone.queries.registry import add, rounded, sql_rounded
from quernstone.queries.windows import W
from quernstone.sources.bars import DAILY, daily_bars

B = f"""{DAILY}, b AS MATERIALIZED (SELECT *, row_number() {W} AS k, close - lag(close) {W} AS ch,
  coalesce(greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})), high - low) AS tr FROM bars)"""


def ema_sql(name: str, x: str, a: float, src: str = "b") -> str:
    return f"{name} AS (SELECT symbol, k, ts, {x} AS e FROM {src} WHERE k = 1 UNION ALL SELECT s.symbol, s.k, s.ts, {a!r}::DOUBLE * ({x.replace('b.', 's.')}) + {1 - a!r}::DOUBLE * p.e FROM {name} p JOIN {src} s ON s.symbol = p.symbol AND s.k = p.k + 1)"


def affine_query(name: str, wanted: dict, sql: str | None, shown: list[str]) -> None:
    """Averages: affine maps composed over chunks of a series."""

    @add(name, sql)
    def query(spark, sf_dir):
        return with_smoothed(daily_bars(spark, sf_dir), wanted).select("symbol", "ts", *rounded({s: F.col(s) for s in shown}, 5))


A20 = 2 / 21
affine_query("X0_ema", {"ema": ("ema", {"n": 20}), "plain": ("ema", {"n": 20, "warm": False})}, f"WITH RECURSIVE {B}, {ema_sql('e', 'close', A20)} SELECT symbol, ts, {sql_rounded({'ema': 'CASE WHEN k >= 20 THEN e END', 'plain': 'e'}, 5)} FROM e", ["ema", "plain"])
ATR = """a AS (SELECT symbol, k, ts, tr AS s, CASE WHEN k >= 14 THEN tr END AS v FROM b WHERE k = 1
 UNION ALL SELECT b.symbol, b.k, b.ts, CASE WHEN b.k <= 14 THEN a.s + b.tr END, CASE WHEN b.k = 14 THEN (a.s + b.tr) / 14 WHEN b.k > 14 THEN (a.v * 13 + b.tr) / 14 END FROM a JOIN b ON b.symbol = a.symbol AND b.k = a.k + 1)"""
affine_query("X1_atr", {"atr": ("atr", {"n": 14}), "research": ("research_atr", {"n": 14})}, f"WITH RECURSIVE {B}, {ATR}, {ema_sql('e', 'tr', 1 / 14)} SELECT symbol, ts, {sql_rounded({'atr': 'a.v', 'research': 'e.e'}, 5)} FROM a JOIN e USING (symbol, ts)", ["atr", "research"])
RSI = f"{ema_sql('u', 'greatest(coalesce(ch, 0), 0)', 1 / 14)}, {ema_sql('d', 'greatest(-coalesce(ch, 0), 0)', 1 / 14)}, rsi AS (SELECT u.symbol, u.ts, u.k, CASE WHEN u.k >= 14 THEN CASE WHEN d.e = 0 THEN 100 ELSE 100 - 100 / (1 + u.e / d.e) END END AS v FROM u JOIN d USING (symbol, ts))"
affine_query("X2_rsi", {"rsi": ("rsi", {"n": 14})}, f"WITH RECURSIVE {B}, {RSI} SELECT symbol, ts, {sql_rounded({'rsi': 'v'}, 5)} FROM rsi", ["rsi"])
MACD = f"{ema_sql('f', 'close', 2 / 13)}, {ema_sql('s', 'close', 2 / 27)}, l AS MATERIALIZED (SELECT f.symbol, f.ts, f.k - 25 AS k, f.e - s.e AS line FROM f JOIN s USING (symbol, ts) WHERE f.k >= 26), {ema_sql('g', 'line', 0.2, 'l')}"
affine_query("X3_macd", {"macd": ("macd", {})}, f"WITH RECURSIVE {B}, {MACD} SELECT b.symbol, b.ts, {sql_rounded({'macd_line': 'l.line', 'macd_signal': 'CASE WHEN g.k >= 9 THEN g.e END', 'macd_histogram': 'CASE WHEN g.k >= 9 THEN l.line - g.e END'}, 5)} FROM b LEFT JOIN l USING (symbol, ts) LEFT JOIN g USING (symbol, ts)", ["macd_line", "macd_signal", "macd_histogram"])
affine_query("X5_adx", {"adx": ("adx", {"n": 14})}, None, ["adx_value", "adx_plus", "adx_minus"])
affine_query("X6_keltner", {"keltner": ("keltner", {"n": 20, "atr": 14, "multiple": 2.0})}, f"WITH RECURSIVE {B}, {ATR}, {ema_sql('e', 'close', A20)} SELECT symbol, ts, {sql_rounded({'keltner_upper': 'CASE WHEN e.k >= 20 THEN e.e + 2 * a.v END', 'keltner_middle': 'CASE WHEN e.k >= 20 THEN e.e END', 'keltner_lower': 'CASE WHEN e.k >= 20 THEN e.e - 2 * a.v END'}, 5)} FROM a JOIN e USING (symbol, ts)", ["keltner_upper", "keltner_middle", "keltner_lower"])


@add("X7_psar")
def x7(spark, sf_dir):
    return turning(daily_bars(spark, sf_dir), "psar", "psar", {}).select("symbol", "ts", *rounded({c: F.col(c) for c in ("psar_value", "psar_direction")}, 5))


ST = """st0 AS MATERIALIZED (SELECT b.*, a.v AS atr, (high + low) / 2 + 3 * a.v AS bu, (high + low) / 2 - 3 * a.v AS bl FROM b JOIN a USING (symbol, ts)),
st AS (SELECT symbol, k, ts, close, bu AS fu, bl AS fl, close > (high + low) / 2 AS up FROM st0 WHERE k = 14
 UNION ALL SELECT n.symbol, n.k, n.ts, n.close, CASE WHEN n.bu < p.fu OR p.close > p.fu THEN n.bu ELSE p.fu END, CASE WHEN n.bl > p.fl OR p.close < p.fl THEN n.bl ELSE p.fl END,
  CASE WHEN p.up THEN n.close >= CASE WHEN n.bl > p.fl OR p.close < p.fl THEN n.bl ELSE p.fl END ELSE n.close > CASE WHEN n.bu < p.fu OR p.close > p.fu THEN n.bu ELSE p.fu END END
  FROM st p JOIN st0 n ON n.symbol = p.symbol AND n.k = p.k + 1)"""


@add("X8_supertrend", f"WITH RECURSIVE {B}, {ATR}, {ST} SELECT b.symbol, b.ts, {sql_rounded({'st_value': 'CASE WHEN up THEN fl ELSE fu END', 'st_direction': 'CASE WHEN up THEN 1 WHEN NOT up THEN -1 END'}, 5)} FROM b LEFT JOIN st USING (symbol, ts)")
def x8(spark, sf_dir):
    out = turning(daily_bars(spark, sf_dir), "st", "supertrend", {"n": 14, "multiple": 3.0})
    return out.select("symbol", "ts", *rounded({c: F.col(c) for c in ("st_value", "st_direction")}, 5))


@add("P15_rsi_condition", f"WITH RECURSIVE {B}, {RSI} SELECT symbol, ts, coalesce(v < 30, false) AS below, coalesce(lag(v) {W} <= 50 AND v > 50, false) AS crosses FROM rsi")
def p15(spark, sf_dir):
    r = with_smoothed(daily_bars(spark, sf_dir), {"rsi": ("rsi", {"n": 14})})
    x = F.col("rsi")
    return r.select("symbol", "ts", C.level_state(x, "below", 30).alias("below"), C.level_state(x, "crosses_above", 50).alias("crosses"))


@add("W28_expected_move", f"WITH RECURSIVE {B}, {ema_sql('e', 'tr', 1 / 14)} SELECT b.symbol, b.ts, {sql_rounded({'bps': 'e.e / b.close * 1e4 * sqrt(5)'}, 4)} FROM b JOIN e USING (symbol, ts)")
def w28(spark, sf_dir):
    """True range over price in basis points, scaled by the root of the horizon."""
    bars = with_smoothed(daily_bars(spark, sf_dir), {"atr": ("research_atr", {"n": 14})})
    return bars.select("symbol", "ts", *rounded({"bps": F.col("atr") / F.col("close") * 1e4 * 5**0.5}, 4))


@add("X9_seeded_ratchet", f"WITH {DAILY} SELECT symbol, ts, greatest(max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 900.0) AS value FROM bars")
def x9(spark, sf_dir):
    return daily_bars(spark, sf_dir).select("symbol", "ts", C.ratchet(F.col("close"), "max", seed=900.0).alias("value"))
