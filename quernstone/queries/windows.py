"""Expressions, conditions, filters, indicators and candle patterns, bar by bar."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import conditions as C
from quernstone.functions import indicators as I
from quernstone.operators.rangerank import with_percentile_rank
from quernstone.queries.registry import add, col, rounded, sql_rounded
from quernstone.sources.bars import DAILY, HOURLY, daily_bars, event_bars

W = "OVER (PARTITION BY symbol ORDER BY ts)"
RUN = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def wn(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, agg: str) -> str:
    return f"CASE WHEN count({x}) {wn(n)} = {n} THEN {agg} {wn(n)} END"


def sma(x: str, n: int) -> str:
    return full(x, n, f"avg({x})")


def sd(x: str, n: int, f: str = "stddev_samp") -> str:
    return full(x, n, f"{f}({x})")


def values(name: str, columns, sql: dict[str, str], bars=daily_bars, ctes: str = DAILY, source: str = "bars") -> None:
    """A query of rounded values for each bar."""

    @add(name, f"WITH {ctes} SELECT symbol, ts, {sql_rounded(sql)} FROM {source}")
    def query(spark, sf_dir):
        return bars(spark, sf_dir).select("symbol", "ts", *rounded(columns() if callable(columns) else columns))


def flags(name: str, columns, sql: dict[str, str], bars=daily_bars, ctes: str = DAILY, source: str = "bars") -> None:
    """A query of booleans for each bar."""

    @add(name, f"WITH {ctes} SELECT symbol, ts, {', '.join(f'({x}) AS {n}' for n, x in sql.items())} FROM {source}")
    def query(spark, sf_dir):
        return bars(spark, sf_dir).select("symbol", "ts", *[x.alias(n) for n, x in (columns() if callable(columns) else columns).items()])


def sure(x: str) -> str:
    return f"coalesce({x}, false)"


# E: expressions
values("E1_price", lambda: {"price": col.close}, {"price": "close"})
values("E2_constant", lambda: {"value": F.lit(2.5)}, {"value": "2.5"})
values("E3_indicator", lambda: {"upper": I.bollinger(col.close, 20, 2.0)[0], "fast": I.sma(col.close, 10)}, {"upper": f"{sma('close', 20)} + 2 * {sd('close', 20, 'stddev_pop')}", "fast": sma("close", 10)})
values("E4_lagged", lambda: {"value": I.lag(col.close, 3, I.series())}, {"value": f"lag(close, 3) {W}"})


@add("E5_scaled", f"WITH {DAILY} SELECT symbol, ts, close * 1.0137::DOUBLE AS value FROM bars")
def scaled(spark, sf_dir):
    return daily_bars(spark, sf_dir).select("symbol", "ts", (col.close * 1.0137).alias("value"))


PCT = f"CASE WHEN count(close) {wn(50)} = 50 THEN (len(list_filter(s, lambda x: x < close)) + (len(list_filter(s, lambda x: x = close)) + 1) / 2) / 50 END"
PCT_SRC = f"(SELECT *, list(close) {wn(50)} AS s FROM bars)"
values("E6_percentile", lambda: {"value": F.col("rank")}, {"value": PCT}, bars=lambda s, d: with_percentile_rank(daily_bars(s, d), "close", 50, "rank"), source=PCT_SRC)
values(
    "E7_ratchet",
    lambda: {"top": C.ratchet(I.sma(col.close, 5)), "floor": C.ratchet(col.close, "min", seed=1200.0)},
    {"top": "CASE WHEN m IS NOT NULL THEN max(m) " + RUN + " END", "floor": f"least(min(close) {RUN}, 1200.0)"},
    source=f"(SELECT *, {sma('close', 5)} AS m FROM bars)",
)

# P: conditions
flags("P1_compare", lambda: {"gt": C.compare(col.close, ">", I.sma(col.close, 20)), "le": C.compare(col.close, "<=", I.sma(col.close, 20))}, {"gt": sure(f"close > ({sma('close', 20)})"), "le": sure(f"close <= ({sma('close', 20)})")})
MA = f"(SELECT *, {sma('close', 10)} AS f, {sma('close', 30)} AS s FROM bars)"
flags(
    "P2_crossover",
    lambda: {"above": C.crossover(F.col("f"), F.col("s")), "below": C.crossover(F.col("f"), F.col("s"), above=False)},
    {"above": sure(f"lag(f) {W} <= lag(s) {W} AND f > s"), "below": sure(f"lag(f) {W} >= lag(s) {W} AND f < s")},
    bars=lambda s, d: daily_bars(s, d).withColumn("f", I.sma(col.close, 10)).withColumn("s", I.sma(col.close, 30)),
    source=MA,
)
flags("P3_within_last", lambda: {"value": C.within_last(F.col("up"), 5)}, {"value": f"bool_or(coalesce(up, false)) {wn(5)}"}, bars=lambda s, d: daily_bars(s, d).withColumn("up", col.close > I.lag(col.close, 1, I.series()) * 1.5), source=f"(SELECT *, close > lag(close) {W} * 1.5 AS up FROM bars)")
flags("P4_rising", lambda: {"rising": C.trending(col.close, 3), "strict": C.trending(col.close, 3, strict=True)}, {"rising": sure(f"close >= lag(close, 3) {W}"), "strict": sure(f"close > lag(close, 3) {W}")})
flags("P5_falling", lambda: {"falling": C.trending(col.close, 3, rising=False), "strict": C.trending(col.close, 3, False, True)}, {"falling": sure(f"close <= lag(close, 3) {W}"), "strict": sure(f"close < lag(close, 3) {W}")})
BODY, UP, DOWN = "abs(close - open)", "(high - greatest(open, close))", "(least(open, close) - low)"
PATTERNS = {
    "doji": f"coalesce({BODY} / nullif(high - low, 0), 1) <= 0.05",
    "hammer": f"{DOWN} >= 2 * {BODY} AND {UP} <= {BODY}",
    "star": f"{UP} >= 2 * {BODY} AND {DOWN} <= {BODY}",
    "bull": sure(f"lag(close) {W} < lag(open) {W} AND close > open AND close >= lag(open) {W} AND open <= lag(close) {W}"),
    "bear": sure(f"lag(close) {W} > lag(open) {W} AND close < open AND close <= lag(open) {W} AND open >= lag(close) {W}"),
}
flags(
    "P6_candle_pattern",
    lambda: {"doji": I.doji(col.open, col.high, col.low, col.close), "hammer": I.hammer(col.open, col.high, col.low, col.close), "star": I.shooting_star(col.open, col.high, col.low, col.close), "bull": I.bullish_engulfing(col.open, col.close), "bear": I.bearish_engulfing(col.open, col.close)},
    PATTERNS,
)
flags("C1_doji", lambda: {"value": I.doji(col.open, col.high, col.low, col.close)}, {"value": PATTERNS["doji"]})
flags("C2_hammer", lambda: {"value": I.hammer(col.open, col.high, col.low, col.close)}, {"value": PATTERNS["hammer"]})
flags("C3_shooting_star", lambda: {"value": I.shooting_star(col.open, col.high, col.low, col.close)}, {"value": PATTERNS["star"]})
flags("C4_bullish_engulfing", lambda: {"value": I.bullish_engulfing(col.open, col.close)}, {"value": PATTERNS["bull"]})
flags("C5_bearish_engulfing", lambda: {"value": I.bearish_engulfing(col.open, col.close)}, {"value": PATTERNS["bear"]})
flags("C6_bullish_pinbar", lambda: {"value": I.bullish_pinbar(col.open, col.high, col.low, col.close)}, {"value": PATTERNS["hammer"]})
flags("C7_bearish_pinbar", lambda: {"value": I.bearish_pinbar(col.open, col.high, col.low, col.close)}, {"value": PATTERNS["star"]})
flags("P7_and", lambda: {"value": C.all_of(C.compare(col.close, ">", col.open), C.compare(col.volume, ">", F.lit(50.0)))}, {"value": "close > open AND volume > 50"})
flags("P8_or", lambda: {"value": C.any_of(C.compare(col.close, ">", col.open), C.compare(col.volume, ">", F.lit(150.0)))}, {"value": "close > open OR volume > 150"})
flags("P9_not", lambda: {"warm": C.negate(C.compare(col.close, ">", I.sma(col.close, 20))), "aligned": C.negate(I.lag(col.close, 5, I.series()) > col.close)}, {"warm": f"NOT {sure('close > (' + sma('close', 20) + ')')}", "aligned": sure(f"NOT (lag(close, 5) {W} > close)")})
flags(
    "P10_regime_state",
    lambda: {"value": C.regime(F.col("on_"), F.col("off_"))},
    {"value": f"coalesce(last_value(CASE WHEN off_ THEN -1 WHEN on_ THEN 1 END IGNORE NULLS) {RUN}, -1) > 0"},
    bars=lambda s, d: daily_bars(s, d).withColumn("on_", C.compare(col.close, ">", I.highest(I.lag(col.high, 1, I.series()), 1))).withColumn("off_", C.compare(col.close, "<", I.lag(col.low, 1, I.series()))),
    source=f"(SELECT *, {sure(f'close > lag(high) {W}')} AS on_, {sure(f'close < lag(low) {W}')} AS off_ FROM bars)",
)
flags("P13_time_of_day", lambda: {"day": C.time_of_day(col.ts, 9, 17), "night": C.time_of_day(col.ts, 22, 4, inclusive_end=True)}, {"day": "hour(ts) >= 9 AND hour(ts) < 17", "night": "hour(ts) >= 22 OR hour(ts) <= 4"}, bars=event_bars, ctes=HOURLY)
flags("P14_day_of_week", lambda: {"value": C.day_of_week(col.ts, [0, 4])}, {"value": "isodow(ts) - 1 IN (0, 4)"})
BANDS = f"(SELECT *, {sma('close', 20)} AS m, {sd('close', 20, 'stddev_pop')} AS d FROM bars)"
flags(
    "P16_bollinger",
    lambda: {"below": C.bollinger_state(col.close, col.close, "below_lower", 20, 2.0), "above": C.bollinger_state(col.close, col.close, "above_upper", 20, 2.0)},
    {"below": sure("close < m - 2 * d"), "above": sure("close > m + 2 * d")},
    source=BANDS,
)
flags(
    "P16_squeeze",
    lambda: {"value": C.squeeze(F.col("rank"), 0.2)},
    {"value": sure("CASE WHEN n = 50 THEN (len(list_filter(s, lambda x: x < width)) + (len(list_filter(s, lambda x: x = width)) + 1) / 2) / 50 END <= 0.2")},
    bars=lambda s, d: with_percentile_rank(daily_bars(s, d).withColumn("width", F.round(4 * I.stddev(col.close, 20, ddof=0), 6)), "width", 50, "rank"),
    source=f"(SELECT *, list(width) FILTER (width IS NOT NULL) {wn(50)} AS s, count(width) {wn(50)} AS n FROM (SELECT *, round(4 * d, 6) AS width FROM {BANDS}))",
)
Z = f"(SELECT *, (close - ({sma('close', 20)})) / nullif({sd('close', 20)}, 0) AS z FROM bars)"
flags(
    "P17_zscore",
    lambda: {"below": C.zscore_state(F.col("z"), "below_neg", 1.5), "above": C.zscore_state(F.col("z"), "above_pos", 1.5), "cross": C.zscore_state(F.col("z"), "cross_toward_zero", 1.5)},
    {"below": sure("z < -1.5"), "above": sure("z > 1.5"), "cross": sure(f"(lag(z) {W} <= -1.5 AND z > lag(z) {W}) OR (lag(z) {W} >= 1.5 AND z < lag(z) {W})")},
    bars=lambda s, d: daily_bars(s, d).withColumn("z", I.zscore(col.close, 20)),
    source=Z,
)

# F: filters
flags("F1_session_filter", lambda: {"value": C.session_hours(col.ts, 9, 17)}, {"value": "hour(ts) BETWEEN 9 AND 17"}, bars=event_bars, ctes=HOURLY)
flags("F2_weekday_filter", lambda: {"value": C.iso_weekdays(col.ts, [1, 2, 3])}, {"value": "isodow(ts) IN (1, 2, 3)"})
flags("F3_condition_filter", lambda: {"value": C.all_of(C.crossover(col.close, col.open), C.iso_weekdays(col.ts, [1, 2, 3, 4, 5]), C.compare(col.volume, ">", F.lit(20.0)))}, {"value": sure(f"lag(close) {W} <= lag(open) {W} AND close > open") + " AND isodow(ts) <= 5 AND volume > 20"})
values("F4_weekend_drop", lambda: {"mean": I.sma(col.close, 5)}, {"mean": sma("close", 5)}, bars=lambda s, d: daily_bars(s, d).where(F.weekday("ts") < 5), source="(SELECT * FROM bars WHERE isodow(ts) <= 5)")

# W: windows
values("W1_sma", lambda: {"sma": I.sma(col.close, 20), "volume_sma": I.sma(col.volume, 20)}, {"sma": sma("close", 20), "volume_sma": sma("volume", 20)})
values("W2_wma", lambda: {"value": I.wma(col.close, 5)}, {"value": "(" + " + ".join(f"{5 - k} * " + (f"lag(close, {k}) {W}" if k else "close") for k in range(5)) + ") / 15"})
values("W3_stddev", lambda: {"value": I.stddev(col.close, 20)}, {"value": sd("close", 20)})
values("W4_zscore", lambda: {"value": I.zscore(col.close, 20)}, {"value": "z"}, source=Z)
values("W5_bollinger", lambda: dict(zip(("upper", "middle", "lower"), I.bollinger(col.close, 20, 2.0))), {"upper": "m + 2 * d", "middle": "m", "lower": "m - 2 * d"}, source=BANDS)
values("W6_percentile_rank", lambda: {"value": F.col("rank")}, {"value": PCT}, bars=lambda s, d: with_percentile_rank(daily_bars(s, d), "close", 50, "rank"), source=PCT_SRC)
values("W7_highest_lowest", lambda: {"highest": I.highest(col.high, 20), "lowest": I.lowest(col.low, 20)}, {"highest": full("high", 20, "max(high)"), "lowest": full("low", 20, "min(low)")})
values("W8_returns", lambda: {"value": I.n_return(col.close, 5)}, {"value": f"close / nullif(lag(close, 5) {W}, 0) - 1"})
values("W9_lag_label", lambda: {"lagged": I.lag(col.close, 2, I.series()), "ret": I.log_return(col.close), "label": I.forward_label(col.close, 3)}, {"lagged": f"lag(close, 2) {W}", "ret": f"ln(close) - ln(lag(close) {W})", "label": f"ln(lead(close, 3) {W}) - ln(close)"})
RET = f"(SELECT *, ln(close) - ln(lag(close) {W}) AS r FROM bars)"
values("W10_realised_vol", lambda: {f"vol_{n}": I.realised_vol(F.col("r"), n) for n in (24, 72)}, {f"vol_{n}": sd("r", n) for n in (24, 72)}, bars=lambda s, d: daily_bars(s, d).withColumn("r", I.log_return(col.close)), source=RET)
values(
    "W11_band_positions",
    lambda: {"percent_b": I.percent_b(col.close, 20, 2.0), "donchian": I.donchian_position(col.close, col.high, col.low, 20), "range_z": I.zscore(col.high - col.low, 20), "volume_z": I.zscore(col.volume, 20)},
    {
        "percent_b": f"(close - (m - 2 * d)) / nullif(4 * d, 0)",
        "donchian": f"(close - ({full('low', 20, 'min(low)')})) / nullif(({full('high', 20, 'max(high)')}) - ({full('low', 20, 'min(low)')}), 0)",
        "range_z": f"(high - low - ({sma('(high - low)', 20)})) / nullif({sd('(high - low)', 20)}, 0)",
        "volume_z": f"(volume - ({sma('volume', 20)})) / nullif({sd('volume', 20)}, 0)",
    },
    source=f"(SELECT *, {sma('close', 20)} AS m, {sd('close', 20)} AS d FROM bars)",
)
values(
    "W12_cyclic",
    lambda: dict(zip(("hour_sin", "hour_cos", "day_sin", "day_cos"), (*I.cyclic(F.hour("ts"), 24), *I.cyclic(F.weekday("ts"), 7)))),
    {"hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)", "day_sin": "sin(2 * pi() * (isodow(ts) - 1) / 7)", "day_cos": "cos(2 * pi() * (isodow(ts) - 1) / 7)"},
    bars=event_bars,
    ctes=HOURLY,
)
values("W13_obv", lambda: {"value": I.obv(col.close, col.volume)}, {"value": f"sum(CASE WHEN close < p THEN -volume ELSE volume END) {RUN}"}, source=f"(SELECT *, lag(close) {W} AS p FROM bars)")
PAIRS = """pr AS (SELECT symbol AS a, lead(symbol) OVER (ORDER BY symbol) AS b FROM (SELECT DISTINCT symbol FROM bars)),
legs AS (SELECT pr.a || '/' || pr.b AS pair, x.ts, x.close AS a, y.close AS b FROM pr JOIN bars x ON x.symbol = pr.a JOIN bars y ON y.symbol = pr.b AND y.ts = x.ts)"""


def pairs(bars):
    """A table of pairs: each symbol and the next by name."""
    symbols = bars.select(F.col("symbol").alias("a")).distinct()
    return symbols.withColumn("b", F.lead("a").over(Window.orderBy("a"))).where("b IS NOT NULL")  # a row for each symbol


def legs(bars, pairs):
    """(pair, ts, a, b): the closes of both symbols of each pair where both have a bar."""
    one, other = bars.select(F.col("symbol").alias("a"), "ts", F.col("close").alias("x")), bars.select(F.col("symbol").alias("b"), "ts", F.col("close").alias("y"))
    return pairs.join(one, "a").join(other, ["b", "ts"]).select(F.concat("a", F.lit("/"), "b").alias("pair"), "ts", F.col("x").alias("a"), F.col("y").alias("b"))


@add("W15_spread", f"WITH {DAILY}, {PAIRS} SELECT pair, ts, {sql_rounded({'log_spread': 'ln(a) - ln(b)', 'ratio': 'a / nullif(b, 0)'})} FROM legs")
def spread(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return legs(bars, pairs(bars)).select("pair", "ts", *rounded({"log_spread": F.ln("a") - F.ln("b"), "ratio": F.col("a") / F.nullif(F.col("b"), F.lit(0.0))}))


@add(
    "W14_rolling_correlation",
    f"""WITH {DAILY}, {PAIRS}, r AS (SELECT pair, ts, ln(a) - ln(lag(a) OVER q) AS ra, ln(b) - ln(lag(b) OVER q) AS rb FROM legs WINDOW q AS (PARTITION BY pair ORDER BY ts))
SELECT pair, ts, CASE WHEN count(ra) OVER w = 20 THEN round(corr(ra, rb) OVER w, 6) END AS corr FROM r WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 19 PRECEDING)""",
)
def rolling_correlation(spark, sf_dir):
    """Of the returns of both legs of each pair."""
    bars = daily_bars(spark, sf_dir)
    w = Window.partitionBy("pair").orderBy("ts")
    both = legs(bars, pairs(bars)).withColumn("ra", I.log_return(F.col("a"), 1, w)).withColumn("rb", I.log_return(F.col("b"), 1, w))
    corr = I.full(F.col("ra"), 20, F.corr("ra", "rb").over(I.rolling(w, 20)), w)
    return both.select("pair", "ts", F.round(corr, 6).alias("corr"))


MED = f"(SELECT *, CASE WHEN count(close) {wn(50)} = 50 THEN quantile_cont(close, 0.5) {wn(50)} END AS med FROM bars)"
values(
    "W16_mad_outlier",
    lambda: {"z": F.abs(col.close - F.col("med")) / F.nullif(1.4826 * I.full(F.col("dev"), 50, F.percentile("dev", F.lit(0.5)).over(I.rolling(I.series(), 50)), I.series()), F.lit(0.0))},
    {"z": f"abs(close - med) / nullif(1.4826 * (CASE WHEN count(dev) {wn(50)} = 50 THEN quantile_cont(dev, 0.5) {wn(50)} END), 0)"},
    bars=lambda s, d: daily_bars(s, d).withColumn("med", I.full(col.close, 50, F.percentile("close", F.lit(0.5)).over(I.rolling(I.series(), 50)), I.series())).withColumn("dev", F.abs(col.close - F.col("med"))),
    source=f"(SELECT *, abs(close - med) AS dev FROM {MED})",
)
flags(
    "W17_divergence",
    lambda: {"value": C.sure(F.sum(C.sure(F.col("bps") > 50).cast("int")).over(I.rolling(I.series(), 6)) == 6)},
    {"value": f"sum(coalesce(bps > 50, false)::INT) {wn(6)} = 6"},
    bars=lambda s, d: daily_bars(s, d).withColumn("bps", F.abs(col.close / col.open - 1) * 10_000),
    source="(SELECT *, abs(close / open - 1) * 10000 AS bps FROM bars)",
)
values(
    "W18_gaps",
    lambda: {"gap_s": F.col("gap"), "missing": F.when(F.col("gap") > 1.5 * 86400, F.floor(F.col("gap") / 86400) - 1).otherwise(0)},
    {"gap_s": "gap", "missing": "CASE WHEN gap > 1.5 * 86400 THEN floor(gap / 86400) - 1 ELSE 0 END"},
    bars=lambda s, d: daily_bars(s, d).withColumn("gap", (F.unix_micros(col.ts.cast("timestamp")) - F.unix_micros(I.lag(col.ts, 1, I.series()).cast("timestamp"))) / 1e6),
    source=f"(SELECT *, epoch(ts) - epoch(lag(ts) {W}) AS gap FROM bars)",
)


@add("W19_alignment", "SELECT event_id, (epoch_us(ts) // 1000000 % 3600)::BIGINT AS off_s FROM events")
def alignment(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) % 3600).cast("long").alias("off_s"))


BOOK = """book AS (SELECT event_id, event_type AS symbol, ts, value AS bid, user_id::DOUBLE AS bq, value + 0.01 * (user_id % 7) AS ask, (event_id % 11)::DOUBLE AS aq FROM events)"""


def book(spark, sf_dir):
    """Events as book updates: bid and ask from the value, sizes from the ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("bid"), F.col("user_id").cast("double").alias("bq"), (F.col("value") + 0.01 * (F.col("user_id") % 7)).alias("ask"), (F.col("event_id") % 11).cast("double").alias("aq"))


BW = "OVER (PARTITION BY symbol ORDER BY ts, event_id)"
OFI_SQL = f"(CASE WHEN bid >= lag(bid) {BW} THEN bq ELSE 0 END) - coalesce(CASE WHEN bid <= lag(bid) {BW} THEN lag(bq) {BW} ELSE 0 END, 0) - (CASE WHEN ask <= lag(ask) {BW} THEN aq ELSE 0 END) + coalesce(CASE WHEN ask >= lag(ask) {BW} THEN lag(aq) {BW} ELSE 0 END, 0)"


@add("W20_ofi", f"WITH {BOOK} SELECT event_id, {sql_rounded({'ofi': OFI_SQL})} FROM book")
def ofi(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    return book(spark, sf_dir).select("event_id", *rounded({"ofi": I.ofi(F.col("bid"), F.col("bq"), F.col("ask"), F.col("aq"), w)}))


values("W24_drawdown", lambda: {"peak": F.max(col.close).over(I.running(I.series())), "drawdown": col.close / F.max(col.close).over(I.running(I.series())) - 1}, {"peak": f"max(close) {RUN}", "drawdown": f"close / max(close) {RUN} - 1"})
flags("W25_regime_ma", lambda: {"value": C.sure(I.lag(col.close > I.sma(col.close, 200), 1, I.series()))}, {"value": sure(f"lag(up) {W}")}, bars=lambda s, d: daily_bars(s, d), source=f"(SELECT *, close > ({sma('close', 200)}) AS up FROM bars)")
values("X4_stochastic", lambda: {"k": F.col("k"), "d": I.sma(F.col("k"), 3)}, {"k": "k", "d": sma("k", 3)}, bars=lambda s, d: daily_bars(s, d).withColumn("k", I.stochastic(col.high, col.low, col.close, 14)), source=f"(SELECT *, 100 * (close - ({full('low', 14, 'min(low)')})) / nullif(({full('high', 14, 'max(high)')}) - ({full('low', 14, 'min(low)')}), 0) AS k FROM bars)")
values("A5_session_vwap", lambda: {"vwap": I.session_vwap(col.high, col.low, col.close, col.volume, Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts"))}, {"vwap": "sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0)"}, bars=event_bars, ctes=HOURLY, source="bars WINDOW d AS (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING)")
