"""Scalar functions of the ledger, the calendar and the reports."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.sources.bars import TIMEFRAMES, bin_start


# money
def price(x: Column) -> Column:
    """Eight places, half to even."""
    return F.bround(x.cast("decimal(38,18)"), 8)


def size_down(x: Column) -> Column:
    """Eight places, toward zero."""
    d = x.cast("decimal(28,18)")
    return F.when(d >= 0, F.floor(d, F.lit(8))).otherwise(-F.floor(-d, F.lit(8)))


def floor_step(q: Column, step: float) -> Column:
    return F.floor(q / step) * step


def slipped(px: Column, bps: Column, buy: Column) -> Column:
    return px * (1 + F.when(buy, bps).otherwise(-bps) / 10_000)


def side_cost_bps(fee: Column, half_spread: Column, slip: Column, multiple: float = 1.0) -> Column:
    return (fee + half_spread + slip) * multiple


# calendar
def floor_to(ts: Column, timeframe: str) -> Column:
    return bin_start(ts, TIMEFRAMES[timeframe])


def candle_close(open_ts: Column, timeframe: str) -> Column:
    return open_ts + F.expr(f"INTERVAL {TIMEFRAMES[timeframe]} SECONDS")


def next_close(ts: Column, timeframe: str) -> Column:
    """The first close after ``ts``."""
    return candle_close(floor_to(ts, timeframe), timeframe)


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("timestamp_ntz")


# text
def claimed_number(text: Column) -> Column:
    """The first number of a claim; per cent counts as a share, a following x as a factor."""
    number = F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)\s*(%|x\b)?", 1)
    suffix = F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)\s*(%|x\b)?", 2)
    x = F.try_cast(number, "double") if hasattr(F, "try_cast") else number.try_cast("double")
    return F.when(number == "", F.lit(None)).when(suffix == "%", x / 100).otherwise(x)


# normal distribution: Spark has neither of these; rational functions of published coefficients, as columns
# Numerator and denominator of the lower tail divided by exp(-x*x/2), highest power first.
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Numerator and denominator of the inverse in the middle and in the tails, highest power first.
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
END_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
END_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
END = 0.02425


def polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * x + c
    return out


def let(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of(x)`` with x computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def norm_cdf(x: Column) -> Column:
    def tail(a: Column) -> Column:
        near = polynomial(a, TAIL_TOP) / polynomial(a, TAIL_BOTTOM)
        far = 1 / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / (2 * math.pi) ** 0.5
        return F.when(a > 37, 0.0).otherwise(F.exp(-a * a / 2) * F.when(a < 7.07106781186547, near).otherwise(far))

    return let(x, lambda v: let(tail(F.abs(v)), lambda t: F.when(v > 0, 1 - t).otherwise(t)))


def norm_ppf(p: Column) -> Column:
    """Null outside of (0, 1). One step of Halley's method after the rational guess."""
    end = lambda t: polynomial(t, END_TOP) / polynomial(t, END_BOTTOM)
    middle = lambda q: q * let(q * q, lambda r: polynomial(r, MIDDLE_TOP) / polynomial(r, MIDDLE_BOTTOM))

    def guess(p: Column) -> Column:
        least = F.least(p, 1 - p)
        tail = let(F.sqrt(-2 * F.ln(least)), end)
        return F.when(p < END, tail).when(p > 1 - END, -tail).otherwise(let(p - 0.5, middle))

    def better(p: Column, x: Column) -> Column:
        return let((norm_cdf(x) - p) * (2 * math.pi) ** 0.5 * F.exp(x * x / 2), lambda off: x - off / (1 + x * off / 2))

    return let(p, lambda v: F.when((v > 0) & (v < 1), let(guess(v), lambda x: better(v, x))))


def polynomial_sql(x: str, powers: tuple[float, ...]) -> str:
    out = f"{powers[0]!r}::DOUBLE"
    for c in powers[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def norm_cdf_sql(x: str) -> str:
    """The same as DuckDB SQL, for arguments within seven deviations."""
    tail = f"exp(-({x}) * ({x}) / 2) * {polynomial_sql(f'abs({x})', TAIL_TOP)} / {polynomial_sql(f'abs({x})', TAIL_BOTTOM)}"
    return f"CASE WHEN ({x}) > 0 THEN 1 - {tail} ELSE {tail} END"


def norm_ppf_sql(p: str) -> str:
    """The guess of the inverse as DuckDB SQL; it is right to nine digits."""
    q, t = f"(({p}) - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    middle = f"{q} * {polynomial_sql(f'({q} * {q})', MIDDLE_TOP)} / {polynomial_sql(f'({q} * {q})', MIDDLE_BOTTOM)}"
    end = f"{polynomial_sql(t, END_TOP)} / {polynomial_sql(t, END_BOTTOM)}"
    return f"CASE WHEN ({p}) < {END} THEN {end} WHEN ({p}) > {1 - END} THEN -({end}) ELSE {middle} END"


# ladders
def ladder(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step whose bound x is below."""
    out = F
    for bound, name in steps:
        out = out.when(x < bound, F.lit(name))
    return out.otherwise(F.lit(rest))


def change(now: Column, before: Column) -> tuple[Column, Column, Column]:
    """Difference, share, and tone."""
    d = now - before
    return d, d / F.nullif(before, F.lit(0.0)), F.when(d > 0, "up").when(d < 0, "down").otherwise("flat")
