"""Indicators that a window frame can express, as columns over bars.

Every function takes columns and the window ``w`` (partitioned by series, ordered by time)
and gives a column. Warm-up is strict: a rolling value is null until its window is full.
Missing is null, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(w: WindowSpec | None = None) -> WindowSpec:
    """The window given, or that of a series: by symbol, in time."""
    return w if w is not None else Window.partitionBy("symbol").orderBy("ts")


def rolling(w: WindowSpec | None, n: int) -> WindowSpec:
    return series(w).rowsBetween(-(n - 1), 0)


def running(w: WindowSpec | None) -> WindowSpec:
    return series(w).rowsBetween(Window.unboundedPreceding, 0)


def full(c: Column, n: int, value: Column, w: WindowSpec | None = None) -> Column:
    """``value`` where the last n rows all have ``c``."""
    return F.when(F.count(c).over(rolling(w, n)) == n, value)


def lag(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.lag(c, n).over(series(w)) if n else c


def sma(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(c, n, F.avg(c).over(rolling(w, n)), w)


def wma(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Weights 1..n, the newest heaviest; null while any of the n is missing."""
    total = sum(((n - k) * lag(c, k, w) for k in range(n)), F.lit(0.0))
    return total / (n * (n + 1) / 2)


def stddev(c: Column, n: int, w: WindowSpec | None = None, ddof: int = 1) -> Column:
    return full(c, n, (F.stddev_samp(c) if ddof else F.stddev_pop(c)).over(rolling(w, n)), w)


def zscore(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    return (c - sma(c, n, w)) / F.nullif(stddev(c, n, w), F.lit(0.0))


def bollinger(c: Column, n: int, k: float, w: WindowSpec | None = None, ddof: int = 0) -> tuple[Column, Column, Column]:
    """Upper, middle and lower band."""
    mid, sd = sma(c, n, w), stddev(c, n, w, ddof)
    return mid + k * sd, mid, mid - k * sd


def highest(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(c, n, F.max(c).over(rolling(w, n)), w)


def lowest(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(c, n, F.min(c).over(rolling(w, n)), w)


def n_return(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    return c / F.nullif(lag(c, n, w), F.lit(0.0)) - 1


def log_return(c: Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.ln(c) - F.ln(lag(c, n, w))


def forward_label(c: Column, horizon: int, w: WindowSpec | None = None) -> Column:
    """Log return over the next ``horizon`` bars: the one function that looks ahead."""
    return F.ln(F.lead(c, horizon).over(series(w))) - F.ln(c)


def realised_vol(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Of a column of returns."""
    return stddev(c, n, w)


def percent_b(c: Column, n: int, k: float, w: WindowSpec | None = None) -> Column:
    up, _, low = bollinger(c, n, k, w, ddof=1)
    return (c - low) / F.nullif(up - low, F.lit(0.0))


def donchian_position(c: Column, high: Column, low: Column, n: int, w: WindowSpec | None = None) -> Column:
    top, bottom = highest(high, n, w), lowest(low, n, w)
    return (c - bottom) / F.nullif(top - bottom, F.lit(0.0))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    return F.sin(2 * math.pi * value / period), F.cos(2 * math.pi * value / period)


def obv(c: Column, volume: Column, w: WindowSpec | None = None) -> Column:
    """Running volume, negative where the close fell; a tie counts as a rise."""
    return F.sum(F.when(c < lag(c, 1, w), -volume).otherwise(volume)).over(running(w))


def true_range(high: Column, low: Column, c: Column, w: WindowSpec | None = None) -> Column:
    before = lag(c, 1, w)
    return F.coalesce(F.greatest(high - low, F.abs(high - before), F.abs(low - before)), high - low)


def stochastic(high: Column, low: Column, c: Column, k: int, w: WindowSpec | None = None) -> Column:
    """Raw %K; %D is its moving average. No smoothing of %K."""
    top, bottom = highest(high, k, w), lowest(low, k, w)
    return 100 * (c - bottom) / F.nullif(top - bottom, F.lit(0.0))


def ofi(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column, w: WindowSpec) -> Column:
    """Order flow imbalance of each book update; what can't be compared counts as unequal."""
    pb, pbq, pa, paq = (lag(x, 1, w) for x in (bid, bid_qty, ask, ask_qty))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    part = lambda flag, q: F.when(yes(flag) > 0, q).otherwise(0.0)
    return part(bid >= pb, bid_qty) - part(bid <= pb, pbq) - part(ask <= pa, ask_qty) + part(ask >= pa, paq)


def session_vwap(high: Column, low: Column, c: Column, volume: Column, day: WindowSpec) -> Column:
    """Running volume-weighted typical price; ``day`` is partitioned by series and date."""
    typical = (high + low + c) / 3
    return F.sum(typical * volume).over(running(day)) / F.nullif(F.sum(volume).over(running(day)), F.lit(0.0))


# candle patterns


def _body(o: Column, c: Column) -> Column:
    return F.abs(c - o)


def _wicks(o: Column, h: Column, low: Column, c: Column) -> tuple[Column, Column]:
    return h - F.greatest(o, c), F.least(o, c) - low


def doji(o: Column, h: Column, low: Column, c: Column) -> Column:
    return F.coalesce(_body(o, c) / F.nullif(h - low, F.lit(0.0)), F.lit(1.0)) <= 0.05


def hammer(o: Column, h: Column, low: Column, c: Column) -> Column:
    upper, lower = _wicks(o, h, low, c)
    return (lower >= 2 * _body(o, c)) & (upper <= _body(o, c))


def shooting_star(o: Column, h: Column, low: Column, c: Column) -> Column:
    upper, lower = _wicks(o, h, low, c)
    return (upper >= 2 * _body(o, c)) & (lower <= _body(o, c))


bullish_pinbar, bearish_pinbar = hammer, shooting_star


def bullish_engulfing(o: Column, c: Column, w: WindowSpec | None = None) -> Column:
    po, pc = lag(o, 1, w), lag(c, 1, w)
    return F.coalesce((pc < po) & (c > o) & (c >= po) & (o <= pc), F.lit(False))


def bearish_engulfing(o: Column, c: Column, w: WindowSpec | None = None) -> Column:
    po, pc = lag(o, 1, w), lag(c, 1, w)
    return F.coalesce((pc > po) & (c < o) & (c <= po) & (o >= pc), F.lit(False))
