"""Strategy documents: JSON in, columns over bars out.

A document holds an entry condition, exits, filters and sizing. It is checked, then every
condition becomes a boolean column by the functions of ``quernstone.functions``; what only
a walk can compute (exponential averages and their kin) is gathered in one scan before.
Catalyst plans the rest. No code is accepted in a document.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import conditions as C
from quernstone.functions import indicators as I
from quernstone.operators.indicator_scan import with_indicators
from quernstone.operators.rangerank import with_percentile_rank
from quernstone.operators.joins import asof
from quernstone.operators.simulators import TraderConfig, simulate
from quernstone.sources.bars import TIMEFRAMES, resample

PRICES = ("open", "high", "low", "close", "volume")
STATEFUL, GATES = ("regime_state",), ("prior_trade", "prior_signal")
#: indicator -> parameter names of its scan, and the component meant when none is named
SCANNED = {
    "ema": (lambda p: ("ema", {"n": p["period"]}), ""),
    "rsi": (lambda p: ("rsi", {"n": p.get("period", 14)}), ""),
    "atr": (lambda p: ("atr", {"n": p.get("period", 14)}), ""),
    "macd": (lambda p: ("macd", {"fast": p.get("fast", 12), "slow": p.get("slow", 26), "signal": p.get("signal", 9)}), "line"),
    "keltner": (lambda p: ("keltner", {"n": p.get("period", 20), "atr": p.get("atr_period", 10), "multiple": p.get("multiplier", 2.0)}), "middle"),
    "adx": (lambda p: ("adx", {"n": p.get("period", 14)}), "value"),
    "psar": (lambda p: ("psar", {"step": p.get("step", 0.02), "most": p.get("max_step", 0.2)}), "value"),
    "supertrend": (lambda p: ("supertrend", {"n": p.get("atr_period", 10), "multiple": p.get("multiplier", 3.0)}), "value"),
}
#: Different documents whose answers a worker keeps: rows often share theirs. The rest are read anew.
REMEMBERED = 65_536
#: Components as documents name them, where the scan names them otherwise.
COMPONENTS = {"hist": "histogram"}

# Bounds of each indicator's parameters, all of which a document must give.
RULES = {
    "sma": {"period": (2, 500)}, "ema": {"period": (2, 500)}, "wma": {"period": (2, 500)}, "rsi": {"period": (2, 100)},
    "macd": {"fast": (2, 100), "slow": (3, 200), "signal": (2, 50)}, "stochastic": {"k": (2, 100), "d": (1, 20), "smooth": (1, 10)},
    "atr": {"period": (2, 100)}, "bollinger": {"period": (5, 200), "std_dev": (0.5, 5.0)}, "stddev": {"period": (2, 200)},
    "volume_sma": {"period": (2, 200)}, "obv": {}, "vwap": {}, "highest": {"period": (2, 500)}, "lowest": {"period": (2, 500)},
    "returns": {"period": (1, 100)}, "supertrend": {"atr_period": (2, 100), "multiplier": (1.0, 10.0)}, "adx": {"period": (2, 100)},
    "keltner": {"period": (5, 200), "atr_period": (2, 100), "multiplier": (1.0, 10.0)}, "psar": {"step": (0.01, 0.1), "max_step": (0.1, 1.0)},
}
# Components of indicators that have several, one of which a document must name.
PARTS = {
    "macd": ("line", "signal", "hist"), "stochastic": ("k", "d"), "bollinger": ("upper", "middle", "lower"), "supertrend": ("value", "direction"),
    "keltner": ("upper", "middle", "lower"), "psar": ("value", "direction"),
}
# Bounds of other numbers of a document.
BOUNDS = {"lookback": (1, 1000), "n": (1, 100_000), "bars_ago": (0, 10_000), "window": (10, 10_000), "mult": (0, 20), "max_bars_held": (1, 100_000)}
SIZING = {"percent": (0.0, 1.0), "risk_percent": (0.0, 0.1), "quantity": (0.0, float("inf"))}
COSTS = {"commission_pct": (0.0, 0.1), "slippage_pct": (0.0, 0.1)}
LIMIT_OFFSET = (-0.05, 0.05)
# What a fill costs where no tier of the venue is listed; a document that states just this has stated nothing.
DEFAULT_COSTS = {"commission_pct": 0.001, "slippage_pct": 0.0005}


def stripped(x):
    """A document without the fields that are null."""
    if isinstance(x, dict):
        return {k: stripped(v) for k, v in x.items() if v is not None}
    return [stripped(v) for v in x] if isinstance(x, list) else x


def nodes(x):
    """Every object of the document, outermost first."""
    if isinstance(x, dict):
        yield x
        for v in x.values():
            yield from nodes(v)
    elif isinstance(x, list):
        for v in x:
            yield from nodes(v)


def kind_of(x: dict) -> str | None:
    return x.get("type") or x.get("kind")


def _outside(x: dict, bounds: dict) -> list[str]:
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    return [k for k, (low, high) in bounds.items() if number(x.get(k)) and not low <= x[k] <= high]


def indicator_errors(x: dict) -> list[str]:
    """What is wrong with one indicator expression."""
    name, p = x.get("name"), x.get("params", {})
    if name not in RULES:
        return ["indicator_unknown"]
    out = ["indicator_param_out_of_bounds" for _ in _outside(p, RULES[name])]
    needs = {*RULES[name], *(["session_anchored"] if name == "vwap" else []), *(["source"] if name in ("highest", "lowest") else [])}
    out += ["indicator_param_missing" for k in needs if k not in p] + ["indicator_param_unknown" for k in p if k not in needs]
    part = x.get("component")
    if name not in PARTS:
        out += ["indicator_component_not_supported"] if part is not None and name != "adx" else []
    elif part is None:
        out.append("indicator_component_required")
    elif part not in PARTS[name]:
        out.append("indicator_component_unknown")
    if name == "macd" and p.get("slow", 1) <= p.get("fast", 0):
        out.append("macd_slow_must_exceed_fast")
    if name in SCANNED and x.get("source", "close") != "close":
        out.append("indicator_source_not_supported")
    return out


def errors(spec: dict) -> list[str]:
    """Codes of what is wrong with a document, or not supported by it; an empty list if nothing is."""
    spec, out = stripped(spec), []
    exits = spec.get("exit", {}).get("exits", [])
    stops = [e for e in exits if e.get("type") == "stop_loss"]
    targets = [e for e in exits if e.get("type") == "take_profit"]
    if not spec.get("entry", {}).get("condition") or not exits:
        out.append("missing_entry_or_exit")
    if any(e.get("method", {}).get("kind") == "r_multiple" for e in targets) and not stops:
        out.append("r_multiple_requires_stop_loss")
    sizing = spec.get("position_sizing", {})
    if sizing.get("mode") == "risk_based" and not any(e.get("type") in ("stop_loss", "r_multiple") for e in exits):
        out.append("risk_based_requires_stop_loss")
    if _outside(sizing, SIZING) or any(sizing.get(k) == 0 for k in SIZING):
        out.append("sizing_out_of_bounds")
    if _outside(spec.get("costs", {}), COSTS):
        out.append("costs_out_of_bounds")
    if spec.get("direction", "long") not in ("long", "short"):
        out.append("direction_unknown")
    order, offset = spec.get("entry", {}).get("order_type", "market"), spec.get("entry", {}).get("limit_offset_pct")
    if order not in ("market", "limit"):
        out.append("order_type_unknown")
    elif (order == "limit") != (offset is not None):
        out.append("limit_offset_required" if offset is None else "limit_offset_forbidden")
    elif offset is not None and not LIMIT_OFFSET[0] <= offset <= LIMIT_OFFSET[1]:
        out.append("limit_offset_out_of_bounds")
    primary, slow = spec.get("primary_timeframe"), spec.get("filter_timeframe")
    if primary not in TIMEFRAMES:
        out.append("unknown_timeframe")
    elif slow and TIMEFRAMES.get(slow, 0) <= TIMEFRAMES[primary]:
        out.append("filter_tf_must_be_higher")
    every = [(kind_of(x), x) for x in nodes(spec)]
    if spec.get("schema_version", "1.0") == "1.0" and any(kind in (*STATEFUL, *GATES, "ratchet") for kind, _ in every):
        out.append("stateful_requires_schema_v2")
    if any(kind == "ratchet" and any(kind_of(y) == "ratchet" for y in nodes(x.get("source", {}))) for kind, x in every):
        out.append("ratchet_nested_unsupported")
    if spec.get("legs") or spec.get("spread"):
        out.append("legs_not_supported")
    if any(kind == "ratchet" and x.get("reset") == "per_trade" for kind, x in every):
        out.append("per_trade_ratchet_not_supported")
    for kind, x in every:
        if kind == "indicator":
            out += indicator_errors(x)
        elif kind in ("rsi", "bollinger_bands", "zscore") and not 2 <= x.get("period", 14) <= 500:
            out.append("out_of_bounds:period")
        out += [f"out_of_bounds:{k}" for k in _outside(x, BOUNDS)]
    return out


@lru_cache(maxsize=REMEMBERED)
def _told(text: str | None) -> tuple[int | None, int | None, str]:
    """Tier, warm-up and errors of a text."""
    try:
        spec = stripped(json.loads(text))
        return tier(spec), warm_up(spec), ",".join(errors(spec))
    except (TypeError, ValueError):
        return None, None, "not_json"


def checked(documents: DataFrame, json_col: str) -> DataFrame:
    """``documents`` with ``tier``, ``warm_up`` and ``errors`` (comma-joined) of the JSON in a column; text that is no JSON has the error ``not_json``."""

    @F.pandas_udf("tier int, warm_up int, errors string")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_told(t) for t in texts], columns=["tier", "warm_up", "errors"]).astype({"tier": "Int32", "warm_up": "Int32"})

    return documents.withColumn("_told", told(F.col(json_col))).select("*", "_told.*").drop("_told")


def warm_up(spec: dict) -> int:
    """Bars before the slowest indicator speaks."""
    names = ("period", "slow", "fast", "signal", "smooth", "window", "atr_period")
    return 1 + max((int(v) for x in nodes(spec) for k, v in x.items() if k in names and isinstance(v, int | float)), default=0)


def tier(spec: dict) -> int:
    """1: stateless; 2: latches and ratchets; 3: needs the simulator's own past."""
    every = list(nodes(spec))
    if any(kind_of(x) in GATES or (kind_of(x) == "ratchet" and x.get("reset") == "per_trade") for x in every):
        return 3
    return 2 if any(kind_of(x) in (*STATEFUL, "ratchet") for x in every) else 1


#: What a sweep varies, by what holds it: (kind of axis, value) of each such place of a document.
PERIODIC = ("sma", "ema", "rsi", "wma", "adx", "keltner")


def swept(spec: dict) -> list[tuple[str, float]]:
    """(kind, value) of every number of a document that a sweep varies, once for each place where it stands."""
    out = []
    for x in nodes(stripped(spec)):
        method = x.get("method", {})
        if x.get("type") in ("stop_loss", "take_profit") and method.get("kind") == "percent":
            out.append((x["type"] + "_pct", float(method["value"])))
        if x.get("kind") == "indicator" and x.get("name") in PERIODIC and "period" in x.get("params", {}):
            out.append(("indicator_period", float(x["params"]["period"])))
        if x.get("kind") == "percentile" and "window" in x:
            out.append(("percentile_window", float(x["window"])))
        left, right = x.get("left", {}), x.get("right", {})
        if x.get("type") == "compare" and left.get("name") == "rsi" and right.get("kind") in ("scalar", "constant"):
            out.append(("rsi_lower" if x.get("op") in ("<", "<=", "below") else "rsi_upper", float(right["value"])))
    return out


@lru_cache(maxsize=REMEMBERED)
def _swept(text: str | None) -> str:
    """What ``swept`` finds in a text, as JSON: Spark reads that faster than lists of dictionaries come over."""
    return json.dumps([{"axis": k, "base": v} for k, v in swept(json.loads(text))] if text else [])


def neighbourhood(kind: Column, c: Column) -> Column:
    """The values that an axis tries around its own, in order. Factors, steps and bounds of each kind."""
    floor, roof = (lambda x, b: F.greatest(F.lit(b), x)), (lambda x, b: F.least(F.lit(b), x))
    near = lambda low, high, last: [floor(c * 0.5, low), floor(c * 0.75, low), c, roof(c * 1.25, high), roof(c * last, high)]
    spread = lambda low: [floor(F.bround(c * 0.5), low), floor(F.bround(c * 0.75), low), c, F.bround(c * 1.25), F.bround(c * 1.75)]
    steps = lambda low, high: [floor(c - 10, low), floor(c - 5, low), c, roof(c + 5, high), roof(c + 10, high)]
    tried = {
        "stop_loss_pct": near(0.02, 0.20, 1.75), "take_profit_pct": near(0.02, 0.50, 2.0), "indicator_period": spread(5.0),
        "percentile_window": spread(10.0), "rsi_lower": steps(10.0, 45.0), "rsi_upper": steps(55.0, 90.0),
    }
    out = F
    for name, points in tried.items():
        out = out.when(kind == name, F.array_sort(F.array_distinct(F.transform(F.array(*points), lambda v: F.round(v, 6)))))
    return out


def sweep_axes(documents: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, axis, base, places, points): each axis of each document, equal numbers of a kind being one, and what it tries."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([_swept(t) for t in texts], dtype=object)

    axes = F.explode(F.from_json(found(F.col(json_col)), "array<struct<axis:string,base:double>>")).alias("x")
    each = documents.select(id_col, axes).select(id_col, "x.axis", F.round("x.base", 6).alias("base"))
    axes = each.groupBy(id_col, "axis", "base").agg(F.count("*").alias("places"))
    return axes.withColumn("points", neighbourhood(F.col("axis"), F.col("base")))


class Compiler:
    """Columns of one document over one series of bars; equal subtrees become one column."""

    def __init__(self, bars: DataFrame, document: dict, timeframe: str):
        self.bars, self.timeframe, self.seen = bars, timeframe, {}
        self.scanned: dict[str, str] = {}
        wanted = {}
        for x in nodes(document):
            if x.get("kind") == "indicator" and x.get("name") in SCANNED:
                wanted[self._scan_name(x["name"], x.get("params", {}))] = SCANNED[x["name"]][0](x.get("params", {}))
            elif x.get("type") == "rsi":
                wanted[self._scan_name("rsi", {"period": x.get("period", 14)})] = ("rsi", {"n": x.get("period", 14)})
            elif x.get("kind") in ("atr_multiple", "trailing_atr") or x.get("type") == "r_multiple":
                wanted[self._scan_name("atr", {"period": x.get("atr_period", 14)})] = ("atr", {"n": x.get("atr_period", 14)})
        self.df = with_indicators(bars, wanted, carry=("open", "high", "low", "close", "volume")) if wanted else bars
        # high, low and close come back once only
        self.source = bars

    def _scan_name(self, name: str, params: dict) -> str:
        return "x_" + name + "".join(f"_{k}_{v}".replace(".", "p") for k, v in sorted(params.items()))

    def keep(self, node: dict, column: Column) -> Column:
        """The node's column, materialised: windows over it stay flat."""
        key = json.dumps(node, sort_keys=True)
        if key not in self.seen:
            self.seen[key] = f"n{len(self.seen)}"
            self.df = self.df.withColumn(self.seen[key], column)
        return F.col(self.seen[key])

    def expr(self, x: dict) -> Column:
        key = json.dumps(x, sort_keys=True)
        if key in self.seen:
            return F.col(self.seen[key])
        return self.keep(x, getattr(self, "expr_" + x["kind"])(x))

    def expr_price(self, x):
        return F.col(x["field"])

    def expr_constant(self, x):
        return F.lit(float(x["value"]))

    def expr_lagged(self, x):
        return I.lag(self.expr(x["expression"]), x["bars_ago"])

    def expr_scaled(self, x):
        return self.expr(x["expression"]) * x["factor"]

    def expr_percentile(self, x):
        return self.ranked(self.expr(x["expression"]), x["window"])

    def ranked(self, value: Column, window: int) -> Column:
        """The column of a value's rank among its last ``window``."""
        self.seen[f"rank {len(self.seen)}"] = name = f"n{len(self.seen)}"
        self.df = with_percentile_rank(self.df.withColumn(f"{name}_of", value), f"{name}_of", window, name).drop(f"{name}_of")
        return F.col(name)

    def expr_ratchet(self, x):
        return C.ratchet(self.expr(x["source"]), x.get("extremum", "max"))

    def expr_indicator(self, x):
        name, p = x["name"], x.get("params", {})
        if name in SCANNED:
            part = COMPONENTS.get(x.get("component"), x.get("component")) or SCANNED[name][1]
            return F.col(self._scan_name(name, p) + (f"_{part}" if part else ""))
        c, n = F.col(x.get("source", "close")), p.get("period", 20)
        high, low, close, volume = (F.col(k) for k in ("high", "low", "close", "volume"))
        if name == "bollinger":
            return dict(zip(("upper", "middle", "lower"), I.bollinger(c, n, p.get("std_dev", 2.0))))[x.get("component") or "middle"]
        if name == "stochastic":
            k = self.keep({"k": x}, I.stochastic(high, low, close, p.get("k", 14)))
            return I.sma(k, p.get("d", 3)) if x.get("component") == "d" else k
        plain = {
            "sma": lambda: I.sma(c, n),
            "wma": lambda: I.wma(c, n),
            "stddev": lambda: I.stddev(c, n),
            "volume_sma": lambda: I.sma(volume, n),
            "highest": lambda: I.highest(F.col(p.get("source", "high")), n),
            "lowest": lambda: I.lowest(F.col(p.get("source", "low")), n),
            "returns": lambda: I.n_return(c, n),
            "obv": lambda: I.obv(close, volume),
            "vwap": lambda: I.session_vwap(high, low, close, volume, Window.partitionBy("symbol", *([F.to_date("ts")] if p.get("session_anchored", True) else [])).orderBy("ts")),
        }
        return plain[name]()

    def cond(self, x: dict) -> Column:
        frame = x.get("timeframe")
        if frame and TIMEFRAMES[frame] > TIMEFRAMES[self.timeframe]:
            return self.slower({**x, "timeframe": None}, frame)
        key = json.dumps(x, sort_keys=True)
        if key in self.seen:
            return F.col(self.seen[key])
        return self.keep(x, getattr(self, "cond_" + x["type"])(x))

    def slower(self, x: dict, frame: str) -> Column:
        """A condition on a longer timeframe, seen from the close of its bar on; null before the first."""
        seconds = TIMEFRAMES[frame]
        inner = Compiler(resample(self.source, seconds), x, frame)
        value = inner.cond(x)
        name = f"s{len(self.seen)}"
        done = inner.df.select("symbol", (F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("done"), value.alias(name))
        self.seen[json.dumps([x, frame], sort_keys=True)] = name
        self.df = asof(self.df, done, ["symbol"], "ts", "done", [name])
        return F.col(name)

    def cond_compare(self, x):
        return C.compare(self.expr(x["left"]), x["op"], self.expr(x["right"]))

    def cond_crossover(self, x):
        return C.crossover(self.expr(x["series"]), self.expr(x["threshold"]), x["direction"] == "above")

    def cond_within_last_n_bars(self, x):
        return C.within_last(self.cond(x["condition"]), x["n"])

    def cond_rising(self, x):
        return C.trending(self.expr(x["series"]), x["lookback"], True, x.get("strict", False))

    def cond_falling(self, x):
        return C.trending(self.expr(x["series"]), x["lookback"], False, x.get("strict", False))

    def cond_candle_pattern(self, x):
        o, h, low, c = (F.col(k) for k in ("open", "high", "low", "close"))
        name = x["pattern"]
        if name.endswith("engulfing"):
            return getattr(I, name)(o, c)
        return getattr(I, name)(o, h, low, c)

    def cond_and(self, x):
        return C.all_of(*[C.sure(self.cond(y)) for y in x["conditions"]])

    def cond_or(self, x):
        return C.any_of(*[C.sure(self.cond(y)) for y in x["conditions"]])

    def cond_not(self, x):
        return C.negate(self.cond(x["condition"]))

    def cond_regime_state(self, x):
        return C.regime(self.cond(x["enter_when"]), self.cond(x["exit_when"]), x.get("initial", False))

    def cond_time_of_day(self, x):
        return C.time_of_day(F.col("ts"), x["start_hour_utc"], x["end_hour_utc"], x.get("inclusive_end", False))

    def cond_day_of_week(self, x):
        return C.day_of_week(F.col("ts"), x["weekdays"])

    def cond_rsi(self, x):
        return C.level_state(F.col(self._scan_name("rsi", {"period": x.get("period", 14)})), x["comparison"], x["threshold"])

    def cond_bollinger_bands(self, x):
        source = F.col(x.get("source", "close"))
        if x["form"] == "squeeze":
            width = self.keep({"width": x}, 2 * x["num_std"] * I.stddev(source, x["period"], ddof=0))
            return C.squeeze(self.ranked(width, x.get("squeeze_window") or 100), x.get("squeeze_percentile") or 0.2)
        return C.bollinger_state(F.col("close"), source, x["form"], x["period"], x["num_std"])

    def cond_zscore(self, x):
        z = self.keep({"z": x}, I.zscore(F.col(x.get("source", "close")), x["period"]))
        return C.zscore_state(z, x["form"], x["threshold"])


def split_gate(condition: dict) -> tuple[dict | None, tuple | None]:
    """The part of an entry that columns can tell, and the gate on the simulator's past: (kind, predicate, n, negated)."""
    parts = condition["conditions"] if condition["type"] == "and" else [condition]
    inner = [p["condition"] if p["type"] == "not" else p for p in parts]
    gates = [(g, p["type"] == "not") for g, p in zip(inner, parts) if g["type"] in GATES]
    core = [p for g, p in zip(inner, parts) if g["type"] not in GATES]
    gate = None
    if gates:
        g, negated = gates[0]
        gate = (g["type"].removeprefix("prior_"), g["predicate"], g.get("n", 1), negated)
    return ({"type": "and", "conditions": core} if core else None), gate


def costs_of(spec: dict, fees: dict | None = None, stated: bool = False) -> tuple[float, float, bool]:
    """Commission and slippage of a fill, and whether the document left them at their defaults.

    ``fees`` maps (exchange, symbol) to the venue's (commission, slippage); what it doesn't
    list costs the default. The ``costs`` block of a document is what its author assumed: it is
    traded at only if ``stated``.
    """
    own = {**DEFAULT_COSTS, **{k: v for k, v in spec.get("costs", {}).items() if k in DEFAULT_COSTS}}
    venue = spec.get("instrument", {})
    exchange = venue.get("exchange", "").lower()
    listed = (fees or {}).get(({"binance": "binance_spot"}.get(exchange, exchange), venue.get("symbol")))
    paid = (own["commission_pct"], own["slippage_pct"]) if stated else listed or tuple(DEFAULT_COSTS.values())
    return *paid, own == DEFAULT_COSTS


def config_of(spec: dict, gate: tuple | None, **costs) -> tuple[TraderConfig, int]:
    """The simulator's configuration, and the period of the true range its levels need. The last of each kind of exit counts."""
    stop = target = max_bars = None
    atr = 14
    for e in spec["exit"]["exits"]:
        m = e.get("method", {})
        if e["type"] == "stop_loss":
            names = {"percent": ("percent", "value"), "atr_multiple": ("atr", "mult"), "fixed_price": ("price", "price"), "trailing_percent": ("trailing_percent", "value"), "trailing_atr": ("trailing_atr", "mult")}
            stop = (names[m["kind"]][0], m[names[m["kind"]][1]])
            atr = m.get("atr_period", atr)
        elif e["type"] == "take_profit":
            names = {"percent": ("percent", "value"), "r_multiple": ("r", "r"), "fixed_price": ("price", "price"), "atr_multiple": ("atr", "mult")}
            target = (names[m["kind"]][0], m[names[m["kind"]][1]])
            atr = atr if stop and "atr" in stop[0] else m.get("atr_period", atr)
        elif e["type"] == "time":
            max_bars = e["max_bars_held"]
        elif e["type"] == "r_multiple":  # a stop of so many true ranges, and its reward
            stop = ("atr", e.get("atr_multiple", 1.0))
            target = ("atr", min(e.get("atr_multiple", 1.0) * e.get("r", e.get("reward_multiple", 2.0)), 20.0))
            atr = e.get("atr_period", 14)
    sizing = spec.get("position_sizing", {"mode": "fixed_percent_equity", "percent": 1.0})
    how = {"fixed_percent_equity": ("percent", "percent"), "risk_based": ("risk", "risk_percent"), "fixed_quantity": ("quantity", "quantity")}[sizing["mode"]]
    costs["side"] = -1 if spec.get("direction") == "short" else 1
    return TraderConfig(sizing=(how[0], sizing[how[1]]), stop=stop, target=target, max_bars=max_bars, gate=gate, **costs), atr


def signals(spec: dict, bars: DataFrame, fees: dict | None = None, stated_costs: bool = False) -> tuple[DataFrame, TraderConfig]:
    """Bars with ``entry``, ``leave`` and ``atr``, and the simulator's configuration. Filters restrict entries only.

    A limit entry fills like a market one, at the next open; its offset is checked only.
    What ``errors`` names is rejected, never passed over.
    """
    found = errors(spec)
    if found:
        raise ValueError(", ".join(found))
    spec = stripped(spec)
    core, gate = split_gate(spec["entry"]["condition"])
    fee, slip, _ = costs_of(spec, fees, stated_costs)
    config, atr = config_of(spec, gate, fee=fee, slip=slip)
    needs = {"kind": "indicator", "name": "atr", "params": {"period": atr}} if any(r and "atr" in r[0] for r in (config.stop, config.target)) else None
    work = Compiler(bars, {"spec": spec, "atr": needs}, spec["primary_timeframe"])
    entry = C.sure(work.cond(core)) if core else F.lit(True)
    for f in spec.get("filters", []):
        if f["type"] == "session":
            entry = entry & C.session_hours(F.col("ts"), *f["hours_utc"])
        elif f["type"] == "weekday":
            entry = entry & C.iso_weekdays(F.col("ts"), f["days"])
        else:
            entry = entry & C.sure(work.cond(f["condition"]))
    leaves = [C.sure(work.cond(e["condition"])) for e in spec["exit"]["exits"] if e["type"] == "condition"]
    level = work.expr(needs) if needs else F.lit(None).cast("double")
    out = work.df.withColumn("entry", entry).withColumn("leave", C.any_of(*leaves) if leaves else F.lit(False)).withColumn("atr", level)
    return out.select("symbol", "ts", "open", "high", "low", "close", "entry", "leave", "atr"), config


def backtest(spec: dict, bars: DataFrame, equity: bool = False, fees: dict | None = None, stated_costs: bool = False) -> DataFrame:
    """Trades of a document over bars of any number of symbols, or its equity curves."""
    table, config = signals(spec, bars, fees, stated_costs)
    return simulate(table, config, equity=equity)
