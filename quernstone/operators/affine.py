"""Recursive smoothing without walking a series: affine maps composed over chunks.

An exponential or Wilder average is y = a * y' + b from row to row, so what a stretch of rows
does to the value before it is an affine map again: y = A * y' + B. A series is cut into
chunks of at most ``CHUNK`` rows; A and B up to each row are windows inside its chunk, the
maps of whole chunks (one row a chunk) are composed in order, and each row's map is applied
to the value that its chunk begins with. All chunks of all series are computed side by side,
so the size of a task is that of a bucket of chunks, however long a series is.

Within a chunk b is divided by powers of a and multiplied back; chunks are short enough for
these powers to stay within the range of doubles for every a of ``SMALLEST`` or more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.sequential import ordered_scan
from quernstone.sources.store import written

CHUNK = 512
#: SMALLEST ** -CHUNK is below 1e245.
SMALLEST = 1 / 3
#: Rows of a series are first dealt out by so many days: a task sorts such a stretch of a series.
BUCKET_DAYS = 512


@dataclass(frozen=True)
class Smooth:
    """y = decay * y' + gain * x over the values of a column that are there; null where x is, and before ``warm`` values.

    ``start``: "first" begins with the first value itself; "sum" adds up the first ``count``
    values, each times ``gain``, before anything decays (Wilder's mean is a sum with gain 1/n).
    """

    column: str
    decay: float
    gain: float
    warm: int = 1
    start: str = "first"
    count: int = 0
    #: values that are missing at the start of a series, if none is after that; what has gaps is counted
    missing: int | None = None

    def __post_init__(self):
        if not (self.decay == 0 or SMALLEST <= self.decay < 1):
            raise ValueError(f"a decay of {self.decay} is not between {SMALLEST} and 1")


def ema(column: str, n: int = 0, warm: bool = True, alpha: float | None = None) -> Smooth:
    a = alpha if alpha is not None else 2 / (n + 1)
    # from two values on the decay is a third at least; of one value nothing is carried on
    return Smooth(column, 1 - a, a, n if warm else 1)


def wilder(column: str, n: int, missing: int | None = None) -> Smooth:
    """The mean of the first n values, then y = (y' * (n - 1) + x) / n."""
    return Smooth(column, (n - 1) / n, 1 / n, n, "sum", n, missing)


def wilder_sum(column: str, n: int, missing: int | None = None) -> Smooth:
    """The sum of the first n values, then y = y' - y' / n + x."""
    return Smooth(column, (n - 1) / n, 1.0, n, "sum", n, missing)


def cut(df: DataFrame, keys: tuple[str, ...], ts: str = "ts", before: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its chunk (``_bucket``, ``_chunk``) and, as ``_before_x``, the value of each column of ``before`` in the row before; with any, also ``_number``, a row's number from 1.

    Times are distinct in a series. The first row of a bucket reads its predecessor's values from
    the bucket's own row in a table of buckets.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_bucket", F.floor(micros / (BUCKET_DAYS * 86_400_000_000)).cast("long"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    number = F.row_number().over(inside) - 1
    rows = rows.withColumn("_row", number)
    rows = rows.withColumn("_chunk", F.floor(F.col("_row") / CHUNK).cast("int"))
    if not before:
        return rows.drop("_row")
    values = lambda: F.struct(*[F.col(c).alias(c) for c in before])
    in_order = Window.partitionBy(*keys).orderBy("_bucket")
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by(values(), ts).alias("_end"), F.count("*").alias("_n"))
    upto = F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(*keys, "_bucket", F.lag("_end").over(in_order).alias("_end"), upto.alias("_upto"))
    rows = rows.withColumn("_own", F.lag(values()).over(inside)).join(ends, [*keys, "_bucket"])
    prior = F.when(F.col("_row") == 0, F.col("_end")).otherwise(F.col("_own"))
    rows = rows.withColumn("_prior", prior).withColumn("_number", F.col("_upto") + F.col("_row") + 1)
    return rows.withColumns({f"_before_{c}": F.col("_prior")[c] for c in before}).drop("_own", "_end", "_prior", "_row", "_upto")


class Composed:
    """The chunks of a series in order: what each of several averages begins a chunk with, and how many values it has had."""

    def __init__(self, n: int):
        self.values, self.seen = [None] * n, [0] * n
        self.n = n

    def push(self, row: tuple) -> list[tuple]:
        out = list(row[:2])
        for i in range(self.n):
            a, b, first, count = row[2 + 4 * i : 6 + 4 * i]
            begin = self.values[i] if self.values[i] is not None else first if first == first else None
            out += [begin, self.seen[i]]
            if begin is not None:
                self.values[i] = a * begin + b
            self.seen[i] += count
        return [tuple(out)]

    def close(self) -> list[tuple]:
        return []


def counted(rows: DataFrame, keys: tuple[str, ...], ts: str, columns: list[str]) -> DataFrame:
    """``cut`` rows with ``_seen_x``: how many values of each column its series has had, this row's included."""
    inside = Window.partitionBy(*keys, "_bucket", "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_bucket", "_chunk").agg(*[F.count(c).alias(f"_n_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_bucket", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_bucket", "_chunk", *[F.coalesce(F.sum(f"_n_{c}").over(earlier), F.lit(0)).alias(f"_n_{c}") for c in columns])
    both = rows.withColumns({f"_seen_{c}": F.count(c).over(inside) for c in columns}).join(carried, [*keys, "_bucket", "_chunk"])
    return both.withColumns({f"_seen_{c}": F.col(f"_seen_{c}") + F.col(f"_n_{c}") for c in columns}).drop(*[f"_n_{c}" for c in columns])


def smoothed(rows: DataFrame, keys: tuple[str, ...], ts: str, wanted: dict[str, Smooth]) -> DataFrame:
    """``cut`` rows with the averages ``wanted`` by name."""
    flat = {name: s for name, s in wanted.items() if s.decay == 0}
    deep = {name: s for name, s in wanted.items() if s.decay > 0}
    columns = list(dict.fromkeys(s.column for s in wanted.values()))
    # rows are read for the counts, for the chunks' maps and for the result: once from their source, then from the table
    rows = written(rows, "chunks")
    # where a first value starts a series, how many there were comes with the maps; a sum of the first n must know before
    known = {s.column: s.missing for s in wanted.values() if s.missing is not None and "_number" in rows.columns}
    early = list(dict.fromkeys(s.column for s in wanted.values() if (s.start == "sum" or s.decay == 0) and s.column not in known))
    rows = counted(rows, keys, ts, early) if early else rows
    inside = Window.partitionBy(*keys, "_bucket", "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_here_{c}": F.count(c).over(inside) for c in columns})
    here = lambda s: F.col(f"_here_{s.column}")
    index = {name: i for i, name in enumerate(deep)}

    def seen(name: str, s: Smooth) -> Column:
        if s.column in known:
            return F.greatest(F.col("_number") - known[s.column], F.lit(0))
        return F.col(f"_seen_{s.column}") if s.column in early else F.col(f"_s{index[name]}") + here(s)

    steps = {}
    for name, s in deep.items():
        decays = here(s)
        if s.start == "sum":
            decays = F.greatest(seen(name, s) - s.count, F.lit(0)) - F.greatest(seen(name, s) - here(s) - s.count, F.lit(0))
        steps[f"_steps_{name}"] = decays.cast("int")
    rows = rows.withColumns(steps)
    power = lambda name, s, sign=1: F.pow(F.lit(s.decay), sign * F.col(f"_steps_{name}"))
    rows = rows.withColumns({f"_b_{name}": power(name, s) * F.coalesce(F.sum(s.gain * F.col(s.column) * power(name, s, -1)).over(inside), F.lit(0.0)) for name, s in deep.items()})
    last = lambda c: F.max_by(c, ts)
    maps = []
    for i, (name, s) in enumerate(deep.items()):
        first = F.min_by(s.column, F.when(F.col(s.column).isNotNull(), F.col(ts))) if s.start == "first" else F.lit(0.0)
        maps += [last(power(name, s)).alias(f"_a{i}"), last(F.col(f"_b_{name}")).alias(f"_c{i}"), F.max(first).alias(f"_f{i}") if s.start != "first" else first.alias(f"_f{i}"), F.max(here(s)).alias(f"_n{i}")]
    if deep:
        n = len(deep)
        chunks = rows.groupBy(*keys, "_bucket", "_chunk").agg(*maps)
        schema = ", ".join(["_bucket long", "_chunk int", *[f"_y{i} double, _s{i} long" for i in range(n)]])
        reads = ["_bucket", "_chunk", *[f"_{x}{i}" for i in range(n) for x in "acfn"]]
        begins = ordered_scan(chunks, list(keys), ["_bucket", "_chunk"], reads, lambda key: Composed(n), schema)
        rows = rows.join(begins, [*keys, "_bucket", "_chunk"])
    shown = lambda name, s, value: F.when(F.col(s.column).isNotNull() & (seen(name, s) >= s.warm), value)
    out = {name: shown(name, s, F.col(f"_b_{name}") + power(name, s) * F.col(f"_y{i}")) for i, (name, s) in enumerate(deep.items())}
    out |= {name: shown(name, s, s.gain * F.col(s.column)) for name, s in flat.items()}
    rows = rows.withColumns(out)
    helpers = [*steps, *[f"_b_{name}" for name in deep], *[f"_{x}{i}" for i in range(len(deep)) for x in "ys"], *[f"_seen_{c}" for c in columns], *[f"_here_{c}" for c in columns]]
    return rows.drop(*helpers)


def true_range() -> Column:
    """Of ``cut`` rows with the close before."""
    high, low, before = F.col("high"), F.col("low"), F.col("_before_close")
    return F.coalesce(F.greatest(high - low, F.abs(high - before), F.abs(low - before)), high - low)


def with_smoothed(bars: DataFrame, wanted: dict[str, tuple[str, dict]], keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """``bars`` with the indicators ``wanted``: output name -> (indicator, its parameters), in as many stages as they build on each other.

    ``ema``, ``rsi``, ``atr``, ``research_atr``, ``macd`` (line, signal, histogram), ``keltner``
    (upper, middle, lower) and ``adx`` (value, plus, minus), with the same warm-ups and values
    as the states of ``functions.recurrences``, but for the last digits. Bars have no null
    prices, and their times are distinct in a series.
    """
    kept = bars.columns
    kinds = {kind for kind, _ in wanted.values()}
    before = tuple(c for c, users in (("close", {"rsi", "atr", "research_atr", "keltner", "adx"}), ("high", {"adx"}), ("low", {"adx"})) if kinds & users)
    rows = cut(bars, keys, ts, before)
    close, first, second, results, helpers = F.col("close"), {}, {}, {}, {}
    if "close" in before:
        rows = rows.withColumn("_tr", true_range())
    middle: dict[str, Column] = {}
    for name, (kind, p) in wanted.items():
        if kind == "ema":
            first[name] = ema("close", p.get("n", 0), p.get("warm", True), p.get("alpha"))
        elif kind == "atr":
            first[name] = wilder("_tr", p["n"], 0)
        elif kind == "research_atr":
            first[name] = ema("_tr", alpha=1 / p["n"], warm=False)
        elif kind == "rsi":
            change = F.coalesce(close - F.col("_before_close"), F.lit(0.0))
            helpers |= {"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))}
            least = 1 if p.get("research") else p["n"]
            a = 1 / p["n"]
            first |= {f"_{name}_up": Smooth("_up", 1 - a, a, least), f"_{name}_down": Smooth("_down", 1 - a, a, least)}
            up, down = F.col(f"_{name}_up"), F.col(f"_{name}_down")
            results[name] = F.when(down == 0, None if p.get("research") else 100.0).when(down > 0, 100 - 100 / (1 + up / down))
        elif kind == "macd":
            fast, slow, signal = p.get("fast", 12), p.get("slow", 26), p.get("signal", 9)
            first |= {f"_{name}_fast": ema("close", fast), f"_{name}_slow": ema("close", slow)}
            middle[f"{name}_line"] = F.col(f"_{name}_fast") - F.col(f"_{name}_slow")
            second[f"{name}_signal"] = ema(f"{name}_line", signal)
            results[f"{name}_histogram"] = F.col(f"{name}_line") - F.col(f"{name}_signal")
        elif kind == "keltner":
            first |= {f"{name}_middle": ema("close", p.get("n", 20)), f"_{name}_atr": wilder("_tr", p.get("atr", 10), 0)}
            width = p.get("multiple", 2.0) * F.col(f"_{name}_atr")
            results |= {f"{name}_upper": F.col(f"{name}_middle") + width, f"{name}_lower": F.col(f"{name}_middle") - width}
        elif kind == "adx":
            n = p.get("n", 14)
            rise, fall = F.col("high") - F.col("_before_high"), F.col("_before_low") - F.col("low")
            moved = F.col("_before_high").isNotNull()
            helpers |= {
                "_move": F.when(moved, F.col("_tr")),
                "_rise": F.when(moved, F.when((rise > fall) & (rise > 0), rise).otherwise(0.0)),
                "_fall": F.when(moved, F.when((fall > rise) & (fall > 0), fall).otherwise(0.0)),
            }
            first |= {f"_{name}_{c}": wilder_sum(f"_{c}", n, 1) for c in ("move", "rise", "fall")}
            total = F.nullif(F.col(f"_{name}_move"), F.lit(0.0))
            middle |= {f"{name}_plus": 100 * F.col(f"_{name}_rise") / total, f"{name}_minus": 100 * F.col(f"_{name}_fall") / total}
            plus, minus = F.col(f"{name}_plus"), F.col(f"{name}_minus")
            middle[f"_{name}_dx"] = F.when(plus + minus == 0, 0.0).otherwise(100 * F.abs(plus - minus) / F.nullif(plus + minus, F.lit(0.0)))
            second[f"{name}_value"] = wilder(f"_{name}_dx", n)
        else:
            raise ValueError(f"no affine form of {kind!r}")
    rows = smoothed(rows.withColumns(helpers), keys, ts, first)
    for name, column in middle.items():  # in order: some read the ones before
        rows = rows.withColumn(name, column)
    if second:
        rows = smoothed(rows, keys, ts, second)
    rows = rows.withColumns(results)
    parts = {"macd": ("line", "signal", "histogram"), "keltner": ("upper", "middle", "lower"), "adx": ("value", "plus", "minus")}
    names = [n for name, (kind, _) in wanted.items() for n in ([f"{name}_{x}" for x in parts[kind]] if kind in parts else [name])]
    return rows.select(*kept, *names)
