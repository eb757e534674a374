"""Recurrent indicators: over chunks of a series side by side, or in one ordered scan where the series is walked anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quernstone.functions import recurrences as R
from quernstone.operators.affine import with_smoothed
from quernstone.operators.sequential import ordered_scan
from quernstone.operators.speculative import long_chunks, speculative_scan

#: name -> (state, columns it reads, names it gives)
INDICATORS = {
    "ema": (R.Ema, ("close",), ("",)),
    "rsi": (R.Rsi, ("close",), ("",)),
    "atr": (R.Atr, ("high", "low", "close"), ("",)),
    "research_atr": (R.ResearchAtr, ("high", "low", "close"), ("",)),
    "macd": (R.Macd, ("close",), ("line", "signal", "histogram")),
    "keltner": (R.Keltner, ("high", "low", "close"), ("upper", "middle", "lower")),
    "adx": (R.Adx, ("high", "low", "close"), ("value", "plus", "minus")),
    "psar": (R.Psar, ("high", "low", "close"), ("value", "direction")),
    "supertrend": (R.Supertrend, ("high", "low", "close"), ("value", "direction")),
}
COLUMNS = ("high", "low", "close")


class Stamped:
    """A state whose rows carry the time that is pushed before its values."""

    def __init__(self, state):
        self.state = state

    def push(self, row: tuple) -> list[tuple]:
        return [(row[0], *self.state.push(*row[1:]))]


def turning(bars: DataFrame, name: str, kind: str, args: dict, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, ts, name_value, name_direction): a stop-and-reverse rule, chunks walked side by side until their walks have met."""
    columns = ["high", "low", "close"]
    if kind == "psar":
        make = lambda key: Stamped(R.Psar(**args))
    else:  # the bands need a true range first, which is an average; which band counts is a latch
        bars = with_smoothed(bars.select(*keys, "ts", *columns), {"_atr": ("atr", {"n": args.get("n", 10)})}, keys)
        columns = [*columns, "_atr"]
        make = lambda key: Stamped(R.Bands(args.get("multiple", 3.0)))
    schema = f"ts {bars.schema['ts'].dataType.simpleString()}, `{name}_value` double, `{name}_direction` double"
    return speculative_scan(long_chunks(bars, keys), list(keys), "ts", ["ts", *columns], make, schema)


def with_indicators(bars: DataFrame, wanted: dict[str, tuple[str, dict]], keys: tuple[str, ...] = ("symbol",), carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ts), the columns ``carry`` and the indicators ``wanted``: output name -> (indicator, its parameters).

    An indicator of several values gives columns name_value. No task holds a series.
    """
    turns = {name: x for name, x in wanted.items() if x[0] in ("psar", "supertrend")}
    averages = {name: x for name, x in wanted.items() if name not in turns}
    names = [f"{name}_{part}" if part else name for name, (kind, _) in wanted.items() for part in INDICATORS[kind][2]]
    out = bars.select(*dict.fromkeys([*keys, "ts", *COLUMNS, *carry]))
    out = with_smoothed(out, averages, keys) if averages else out
    for name, (kind, args) in turns.items():
        out = out.join(turning(bars, name, kind, args, keys), [*keys, "ts"])
    return out.select(*keys, "ts", *carry, *names)


def walked_indicators(bars: DataFrame, wanted: dict[str, tuple[str, dict]], keys: tuple[str, ...] = ("symbol",), carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ts), the columns ``carry`` and the indicators ``wanted``: output name -> (indicator, its parameters).

    The same in one scan, a task a series: for what is walked by a simulator afterwards in any case.
    """
    n = len(COLUMNS) + 1
    names = [f"{name}_{part}" if part else name for name, (kind, _) in wanted.items() for part in INDICATORS[kind][2]]
    reads = [[COLUMNS.index(c) for c in INDICATORS[kind][1]] for kind, _ in wanted.values()]
    several = [len(INDICATORS[kind][2]) > 1 for kind, _ in wanted.values()]

    class Scan:
        def __init__(self, key: tuple):
            self.states = [INDICATORS[kind][0](**args) for kind, args in wanted.values()]

        def push(self, row: tuple) -> list[tuple]:
            out = [row[0], *row[n:]]
            for state, read, many in zip(self.states, reads, several):
                got = state.push(*[row[1 + i] for i in read])
                out += got if many else [got]
            return [tuple(out)]

        def close(self) -> list[tuple]:
            return []

    ts_type = bars.schema["ts"].dataType.simpleString()
    kept = [f"`{c}` {bars.schema[c].dataType.simpleString()}" for c in carry]
    schema = ", ".join([f"ts {ts_type}", *kept, *[f"`{name}` double" for name in names]])
    return ordered_scan(bars, list(keys), ["ts"], ["ts", *COLUMNS, *carry], Scan, schema)
