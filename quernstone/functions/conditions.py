"""Conditions of the strategy language as boolean columns. Null operands give false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from quernstone.functions.indicators import bollinger, lag, rolling, running

OPS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compare(a: Column, op: str, b: Column) -> Column:
    return sure(OPS[op](a, b))


def crossover(a: Column, b: Column, above: bool = True, w: WindowSpec | None = None) -> Column:
    pa, pb = lag(a, 1, w), lag(b, 1, w)
    return sure((pa <= pb) & (a > b) if above else (pa >= pb) & (a < b))


def within_last(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.max(sure(c).cast("int")).over(rolling(w, n)) > 0


def trending(c: Column, n: int, rising: bool = True, strict: bool = False, w: WindowSpec | None = None) -> Column:
    """The newest against the one n bars ago; what lies between does not matter."""
    before = lag(c, n, w)
    op = (">" if strict else ">=") if rising else ("<" if strict else "<=")
    return compare(c, op, before)


def all_of(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, cs)


def any_of(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, cs)


def negate(c: Column) -> Column:
    """Null, as before a higher timeframe's first bar, negates to false; a false of warm-up negates to true."""
    return F.when(c.isNull(), F.lit(False)).otherwise(~c)


def regime(enter: Column, leave: Column, initial: bool = False, w: WindowSpec | None = None) -> Column:
    """A latch: set by ``enter``, cleared by ``leave``, which wins a tie."""
    mark = F.when(leave, F.lit(-1)).when(enter, F.lit(1))
    return F.coalesce(F.last(mark, ignorenulls=True).over(running(w)), F.lit(1 if initial else -1)) > 0


def ratchet(c: Column, kind: str = "max", seed: float | None = None, w: WindowSpec | None = None) -> Column:
    """Running extremum; rows without a value have none, and a seed bounds it from the start."""
    best = (F.max if kind == "max" else F.min)(c).over(running(w))
    if seed is not None:
        best = (F.greatest if kind == "max" else F.least)(best, F.lit(seed))
    return F.when(c.isNotNull(), best)


def time_of_day(ts: Column, start: int, end: int, inclusive_end: bool = False) -> Column:
    """UTC hours from start to end; past midnight if end is before start."""
    h = F.hour(ts)
    before = h <= end if inclusive_end else h < end
    return (h >= start) & before if start <= end else (h >= start) | before


def day_of_week(ts: Column, days: list[int]) -> Column:
    """Monday is 0."""
    return F.weekday(ts).isin(days)


def session_hours(ts: Column, start: int, end: int) -> Column:
    """Both ends inclusive, no wrap."""
    return F.hour(ts).between(start, end)


def iso_weekdays(ts: Column, days: list[int]) -> Column:
    """Monday is 1."""
    return (F.weekday(ts) + 1).isin(days)


def bollinger_state(close: Column, source: Column, state: str, n: int, k: float, squeeze_window: int = 100, quantile: float = 0.2, w: WindowSpec | None = None) -> Column:
    up, _, low = bollinger(source, n, k, w)
    if state == "below_lower":
        return sure(close < low)
    if state == "above_upper":
        return sure(close > up)
    raise ValueError("a squeeze ranks the band width, which must be a column of its own: see squeeze()")


def squeeze(rank: Column, quantile: float) -> Column:
    """Band width among the lowest share ``quantile`` of its last ones; ``rank`` is its rank among them (``rangerank.with_percentile_rank``)."""
    return sure(rank <= quantile)


def zscore_state(z: Column, state: str, threshold: float, w: WindowSpec | None = None) -> Column:
    before = lag(z, 1, w)
    if state == "below_neg":
        return sure(z < -threshold)
    if state == "above_pos":
        return sure(z > threshold)
    return sure(((before <= -threshold) & (z > before)) | ((before >= threshold) & (z < before)))


def level_state(x: Column, state: str, level: float, w: WindowSpec | None = None) -> Column:
    """below, above, crosses_above or crosses_below a fixed level (as for RSI)."""
    if state in ("below", "above"):
        return sure(x < level if state == "below" else x > level)
    return crossover(x, F.lit(float(level)), state == "crosses_above", w)

