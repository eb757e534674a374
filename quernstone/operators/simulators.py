"""Position simulators: state machines that walk a series bar by bar.

All obey the same clock. What was decided at the close before fills at this open; then
funding, stops and targets act inside the bar; then equity is marked; then decisions are
taken at this close. What is still open at the end is valued, not traded. Each is a kernel
of ``ordered_scan``: it holds a position and a few counters, never the series.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_DOWN, Decimal

from pyspark.sql import DataFrame

from quernstone.operators.sequential import ordered_scan

BREAKEVEN = 1e-9


@dataclass(frozen=True)
class TraderConfig:
    """What a strategy of one side (1 long, -1 short) trades by; ``gate`` is ("trade" or "signal", predicate, n, negated)."""

    cash: float = 10_000.0
    fee: float = 0.001
    slip: float = 0.0005
    sizing: tuple[str, float] = ("percent", 1.0)
    stop: tuple[str, float] | None = None
    target: tuple[str, float] | None = None
    max_bars: int | None = None
    gate: tuple | None = None
    side: int = 1


@dataclass
class Open:
    """A position, real or shadow."""

    signal: int
    signal_ts: object
    fill_ts: object
    fill: float
    size: float
    stop: float | None
    target: float | None
    anchor: float
    leaving: bool = False


@dataclass
class Past:
    """Outcomes so far: of completed trades, and of evaluated signals in signal order."""

    returns: list[float] = field(default_factory=list)
    exits: list[int] = field(default_factory=list)
    signals: list[list] = field(default_factory=list)

    def trade_gate(self, predicate: str, n: int, bar: int) -> bool:
        if not self.returns:
            return False
        if predicate == "bars_since_last_at_least":
            return bar - self.exits[-1] >= n
        wanted = (lambda r: r > BREAKEVEN) if "win" in predicate or "won" in predicate else (lambda r: r < -BREAKEVEN)
        length = n if predicate.startswith("consecutive") else 1
        return len(self.returns) >= length and all(wanted(r) for r in self.returns[-length:])

    def signal_gate(self, predicate: str, bar: int) -> bool:
        known = next((s for s in reversed(self.signals) if s[2] is not None and s[2] <= bar), None)
        if known is None:
            return False
        if predicate == "last_fired":
            return known[1]
        return known[3] > BREAKEVEN if predicate == "last_would_have_won" else known[3] < -BREAKEVEN


class BarTrader:
    """One position at a time, next-open fills, stop before target, trailing stops, gates on the past.

    A signal that a gate turns down goes on as a shadow position; its outcome is known
    once the shadow closes, so nothing looks ahead.
    """

    def __init__(self, config: TraderConfig, equity: bool = False):
        self.c, self.emit_equity = config, equity
        self.cash, self.bar = config.cash, -1
        self.position: Open | None = None
        self.entry: tuple | None = None
        self.shadows: list[Open] = []
        self.past = Past()
        self.last: tuple | None = None

    def _level(self, rule: tuple[str, float] | None, fill: float, atr: float) -> float | None:
        if rule is None:
            return None
        kind, v = rule
        share, gap = fill * (1 - self.c.side * abs(v)), fill - self.c.side * v * atr
        return {"percent": share, "trailing_percent": share, "atr": gap, "trailing_atr": gap, "price": v}[kind]

    def _aim(self, fill: float, stop: float | None, atr: float) -> float | None:
        if self.c.target is None:
            return None
        kind, v = self.c.target
        if kind == "r":
            return fill + v * (fill - stop) if stop is not None else None
        return {"percent": fill * (1 + self.c.side * v), "atr": fill + self.c.side * v * atr, "price": v}[kind]

    def _open(self, pending: tuple, ts, raw_fill: float, size: float | None = None) -> Open | None:
        signal, signal_ts, atr = pending
        fill = raw_fill * (1 + self.c.side * self.c.slip)
        stop = self._level(self.c.stop, fill, atr)
        if size is None:
            each = fill * (1 + self.c.fee)
            how, v = self.c.sizing
            if how == "quantity":
                size = min(v, self.cash / each)
            else:
                share = v
                if how == "risk":
                    loss = abs(self.c.stop[1]) if self.c.stop[0].endswith("percent") else self.c.stop[1] * atr / fill
                    share = min(v / loss, 1.0) if loss > 0 else 0.0
                size = share * self.cash / each
        if size <= 0:
            return None
        return Open(signal, signal_ts, ts, fill, size, stop, self._aim(fill, stop, atr), fill)

    def _inside(self, p: Open, o: float, h: float, low: float) -> tuple[float, str] | None:
        up, down = (h, low) if self.c.side > 0 else (-low, -h)  # a short position sees prices upside down
        of = lambda x: self.c.side * x
        if p.stop is not None and down <= of(p.stop):
            return of(min(of(o), of(p.stop))), "stop_loss"
        if p.target is not None and up >= of(p.target):
            return of(max(of(o), of(p.target))), "take_profit"
        return None

    def _trail(self, p: Open, h: float, low: float, atr: float) -> None:
        nearer = max if self.c.side > 0 else min
        p.anchor = nearer(p.anchor, h if self.c.side > 0 else low)
        if self.c.stop is not None and self.c.stop[0].startswith("trailing"):
            p.stop = nearer(p.stop, self._level(self.c.stop, p.anchor, atr))

    def _leave(self, p: Open, ts, px: float, reason: str) -> tuple:
        fill = px * (1 - self.c.side * self.c.slip)
        first, last = (p.size * x * (1 + s * self.c.fee) for x, s in ((p.fill, self.c.side), (fill, -self.c.side)))
        gain = self.c.side * (last - first)
        return p.signal_ts, p.fill_ts, ts, p.fill, fill, p.size, gain, gain / first, reason

    def _settle(self, ts, px: float, reason: str) -> tuple:
        p, self.position = self.position, None
        trade = self._leave(p, ts, px, reason)
        self.cash += self.c.side * p.size * trade[4] * (1 - self.c.side * self.c.fee)
        self.past.returns.append(trade[7])
        self.past.exits.append(self.bar)
        self._resolve(p.signal, trade[7])
        return trade

    def _resolve(self, signal: int, ret: float) -> None:
        for s in self.past.signals:
            if s[0] == signal and s[2] is None:
                s[2], s[3] = self.bar, ret

    def _wants_out(self, p: Open, leave: bool) -> bool:
        return leave or (self.c.max_bars is not None and self.bar - p.signal >= self.c.max_bars)

    def push(self, row: tuple) -> list[tuple]:
        ts, o, h, low, c, raw, leave, atr = row
        atr = 0.0 if atr is None or atr != atr else atr
        self.bar += 1
        self.last = (ts, c)
        trades = []
        if self.entry is not None:
            pending, self.entry = self.entry, None
            self.position = self._open(pending, ts, o)
            if self.position is not None:
                self.cash -= self.c.side * self.position.size * self.position.fill * (1 + self.c.side * self.c.fee)
        elif self.position is not None and self.position.leaving:
            trades.append(self._settle(ts, o, "signal"))
        if self.position is not None:
            hit = self._inside(self.position, o, h, low)
            if hit:
                trades.append(self._settle(ts, *hit))
            else:
                self._trail(self.position, h, low, atr)
        self._walk_shadows(ts, o, h, low, bool(leave), atr)
        value = self.cash + (self.c.side * self.position.size * c if self.position is not None else 0.0)
        if self.position is None and self.entry is None and raw:
            gate = self.c.gate
            passed = gate is None or gate[3] != (self.past.trade_gate(gate[1], gate[2], self.bar) if gate[0] == "trade" else self.past.signal_gate(gate[1], self.bar))
            if passed:
                self.entry = (self.bar, ts, atr)
            if gate is not None and gate[0] == "signal":
                self.past.signals.append([self.bar, passed, None, None])
                if not passed:
                    self.shadows.append(Open(self.bar, ts, None, 0.0, 1.0, None, None, 0.0))
                    self.shadows[-1].anchor = atr  # until it fills: the signal bar's range
        if self.position is not None and not self.position.leaving:
            self.position.leaving = self._wants_out(self.position, bool(leave))
        return [(ts, value)] if self.emit_equity else trades

    def _walk_shadows(self, ts, o: float, h: float, low: float, leave: bool, atr: float) -> None:
        still = []
        for s in self.shadows:
            if s.fill_ts is None:
                s = self._open((s.signal, s.signal_ts, s.anchor), ts, o, size=1.0)
            done = (o, "signal") if s.leaving else self._inside(s, o, h, low)
            if done:
                self._resolve(s.signal, self._leave(s, ts, *done)[7])
                continue
            self._trail(s, h, low, atr)
            s.leaving = self._wants_out(s, leave)
            still.append(s)
        self.shadows = still

    def close(self) -> list[tuple]:
        if self.emit_equity or self.position is None:
            return []
        return [self._settle(*self.last, "end_of_data")]


TRADES = "entry_ts timestamp_ntz, fill_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, exit_price double, size double, pnl double, ret double, reason string"
EQUITY = "ts timestamp_ntz, equity double"


def simulate(signals: DataFrame, config: TraderConfig, keys: tuple[str, ...] = ("symbol",), equity: bool = False) -> DataFrame:
    """Bars with booleans ``entry`` and ``leave`` and a double ``atr`` -> trades, or the equity curve."""
    columns = ["ts", "open", "high", "low", "close", "entry", "leave", "atr"]
    return ordered_scan(signals, list(keys), ["ts"], columns, lambda key: BarTrader(config, equity), EQUITY if equity else TRADES)


@dataclass
class PerpPosition:
    side: int
    entry_ts: object
    quantity: list[float]
    fills: list[float]
    stop: float | None = None
    funding: float = 0.0
    stamps: int = 0


class PerpTrader:
    """One position over one or two perpetual legs: fills at the open, funding on the mark, decisions by ``decide``.

    A bar is (ts, legs, ...rest), a leg being (open, high, low, close, mark, funding or None).
    Subclasses give ``shares`` (signed share of cash for each leg), ``decide`` and, if
    there is a stop, ``stop_at`` and ``trail``.
    """

    def __init__(self, cash: float = 10_000.0, cost: float = 0.001):
        self.cash, self.cost = cash, cost
        self.p: PerpPosition | None = None
        self.enter: int | None = None
        self.leave: str | None = None
        self.last: tuple | None = None

    def stop_at(self, side: int, fill: float, rest: tuple) -> float | None:
        return None

    def trail(self, leg: tuple, rest: tuple) -> None:
        pass

    def _settle(self, ts, prices: list[float], reason: str, charge: bool = True) -> tuple:
        p, self.p = self.p, None
        gain = sum(q * (x - f) for q, x, f in zip(p.quantity, prices, p.fills))
        cost = sum(abs(q) * x for q, x in zip(p.quantity, prices)) * self.cost if charge else 0.0
        self.cash += gain - cost
        return p.entry_ts, ts, p.side, gain, p.funding, cost, gain + p.funding - cost, p.stamps, reason

    def push(self, row: tuple) -> list[tuple]:
        ts, legs, rest = self.read(row)
        opens = [leg[0] for leg in legs]
        self.last = (ts, [leg[4] for leg in legs])
        out = []
        if self.leave is not None and self.p is not None:
            out.append(self._settle(ts, opens, self.leave))
        elif self.enter is not None and self.p is None:
            side = self.enter
            quantity = [side * s * self.cash / o for s, o in zip(self.shares(), opens)]
            self.p = PerpPosition(side, ts, quantity, opens, self.stop_at(side, opens[0], rest))
            self.cash -= sum(abs(q) * o for q, o in zip(quantity, opens)) * self.cost
        self.enter = self.leave = None
        if self.p is not None:
            for q, leg in zip(self.p.quantity, legs):
                if leg[5] is not None and leg[5] == leg[5]:
                    flow = funding_cashflow(q, leg[4], leg[5])
                    self.cash += flow
                    self.p.funding += flow
                    self.p.stamps += 1
        if self.p is not None and self.p.stop is not None:
            o, h, low = legs[0][:3]
            long = self.p.side > 0
            if (low <= self.p.stop) if long else (h >= self.p.stop):
                out.append(self._settle(ts, [min(o, self.p.stop) if long else max(o, self.p.stop)], "stop"))
            else:
                self.trail(legs[0], rest)
        self.decide(legs, rest)
        return out

    def close(self) -> list[tuple]:
        return [self._settle(*self.last, "end_of_data", charge=False)] if self.p is not None else []


def funding_cashflow(quantity: float, mark: float, rate: float) -> float:
    """What a holder of ``quantity`` gets at a funding stamp; longs pay a positive rate."""
    return -quantity * mark * rate


PERP_TRADES = "entry_ts timestamp_ntz, exit_ts timestamp_ntz, side int, price_pnl double, funding_pnl double, cost double, net_pnl double, stamps int, reason string"


class PairTrader(PerpTrader):
    """Both legs against each other's spread: in at |z| >= entry, out at |z| <= exit or >= stop."""

    def __init__(self, entry: float = 2.0, exit_: float = 0.5, stop: float | None = 4.0, weight: float = 1.0, gross: float = 1.0, **kw):
        super().__init__(**kw)
        self.z, self.weight, self.gross = (entry, exit_, stop), weight, gross

    def read(self, row: tuple):
        ts, ao, ac, am, af, bo, bc, bm, bf, z = row
        return ts, [(ao, ao, ao, ac, am, af), (bo, bo, bo, bc, bm, bf)], (z,)

    def shares(self) -> list[float]:
        first = self.gross / (1 + self.weight)
        return [first, -self.weight * first]

    def decide(self, legs: list[tuple], rest: tuple) -> None:
        (z,), (entry, exit_, stop) = rest, self.z
        if z is None or z != z:
            return
        if self.p is None:
            if abs(z) >= entry:
                self.enter = -1 if z > 0 else 1
        elif abs(z) <= exit_:
            self.leave = "reversion"
        elif stop is not None and abs(z) >= stop:
            self.leave = "stop"


class TrendTrader(PerpTrader):
    """Long or short when three averages fall in line anew; trailing stop on closes, out on the opposite line-up."""

    def __init__(self, atr_multiple: float = 3.0, warm: int = 74, share: float = 1.0, short: bool = True, **kw):
        super().__init__(**kw)
        self.k, self.warm, self.share, self.short = atr_multiple, warm, share, short
        self.bar, self.was = -1, 0

    def read(self, row: tuple):
        ts, o, h, low, c, mark, funding, regime, atr = row
        self.bar += 1
        return ts, [(o, h, low, c, mark, funding)], (regime, atr)

    def shares(self) -> list[float]:
        return [self.share]

    def stop_at(self, side: int, fill: float, rest: tuple) -> float:
        return fill - side * self.k * rest[1]

    def trail(self, leg: tuple, rest: tuple) -> None:
        new = leg[3] - self.p.side * self.k * rest[1]
        self.p.stop = max(self.p.stop, new) if self.p.side > 0 else min(self.p.stop, new)

    def decide(self, legs: list[tuple], rest: tuple) -> None:
        regime, fresh = int(rest[0] or 0), int(rest[0] or 0) != self.was
        self.was = regime
        if self.bar < self.warm:
            return
        if self.p is None:
            if regime and fresh and (self.short or regime > 0):
                self.enter = regime
        elif regime == -self.p.side:
            self.leave = "flip"


class CarryTrader(PerpTrader):
    """On the side that funding pays while its z-score is extreme; fixed stop, out when it is normal again."""

    def __init__(self, entry: float = 1.5, exit_: float = 0.5, atr_multiple: float = 3.0, share: float = 1.0, **kw):
        super().__init__(**kw)
        self.z, self.k, self.share, self.rate = (entry, exit_), atr_multiple, share, None

    def read(self, row: tuple):
        ts, o, h, low, c, mark, funding, z, atr = row
        if funding is not None and funding == funding:
            self.rate = funding
        return ts, [(o, h, low, c, mark, funding)], (z, atr)

    def shares(self) -> list[float]:
        return [self.share]

    def stop_at(self, side: int, fill: float, rest: tuple) -> float:
        return fill - side * self.k * rest[1]

    def decide(self, legs: list[tuple], rest: tuple) -> None:
        z, (entry, exit_) = rest[0], self.z
        if z is None or z != z:
            return
        if self.p is None:
            if abs(z) >= entry and self.rate:
                self.enter = -1 if self.rate > 0 else 1
        elif abs(z) <= exit_:
            self.leave = "normalize"


class DecimalBroker:
    """The 0/1 engine in decimals, all in: quantities floored to a step, fills at the open with cost on each side."""

    def __init__(self, cash: str = "10000", cost_bps: float = 10.0, step: str = "0.00001"):
        self.cash, self.units, self.step = Decimal(cash), Decimal(0), Decimal(step)
        self.c = Decimal(str(cost_bps)) / Decimal(10_000)
        self.want = 0

    def push(self, row: tuple) -> list[tuple]:
        ts, o, pos = row
        px = Decimal(str(o))
        action = None
        if self.want and not self.units:
            fill = px * (1 + self.c)
            self.units = (self.cash / fill / self.step).to_integral_value(ROUND_DOWN) * self.step
            self.cash -= self.units * fill
            action = "buy" if self.units else None
        elif not self.want and self.units:
            self.cash += self.units * px * (1 - self.c)
            self.units, action = Decimal(0), "sell"
        self.want = int(pos)
        return [(ts, float(self.cash + self.units * px), action)]

    def close(self) -> list[tuple]:
        return []


class TrendState:
    """In on a confirmed breakout, out on a chandelier stop, a lost trend or lost membership; then a cooldown."""

    def __init__(self, atr_multiple: float = 3.0, cooldown: int = 4):
        self.k, self.cooldown = atr_multiple, cooldown
        self.inside, self.top, self.wait = False, 0.0, 0

    def push(self, row: tuple) -> list[tuple]:
        ts, c, fast, slow, breakout, atr, member = row
        known = None not in (fast, slow, atr) and atr == atr
        if self.inside:
            self.top = max(self.top, c)
            if not known or c <= self.top - self.k * atr or fast < slow or not member:
                self.inside, self.wait = False, self.cooldown
        elif self.wait:
            self.wait -= 1
        elif known and member and breakout is not None and breakout == breakout and c > fast > slow and c > breakout:
            self.inside, self.top = True, c
        return [(ts, int(self.inside))]

    def close(self) -> list[tuple]:
        return []


class EdgeGate:
    """In when the expected value after costs is positive; out by probability, trailing stop or age, in that order."""

    def __init__(self, p_min: float = 0.52, hysteresis: float = 0.02, trail: float = 3.0, max_hold: int = 20):
        self.p_min, self.p_out, self.trail, self.max_hold = p_min, 0.5 - hysteresis, trail, max_hold
        self.inside, self.top, self.age = False, 0.0, 0

    def push(self, row: tuple) -> list[tuple]:
        ts, c, p, edge, ev, atr = row
        if self.inside:
            self.age += 1
            self.top = max(self.top, c)
            reason = "exit_probability" if p < self.p_out else "exit_trail" if c <= self.top - self.trail * atr else "exit_max_hold" if self.age >= self.max_hold else None
            self.inside = reason is None
            return [(ts, "EXIT" if reason else "HOLD", reason or "hold_position", int(self.inside))]
        if ev > 0 and p >= self.p_min:
            self.inside, self.top, self.age = True, c, 0
            return [(ts, "ENTER_LONG", "enter", 1)]
        if p < self.p_min and edge <= 0:
            return [(ts, "HOLD", "hold_flat", 0)]
        return [(ts, "SKIP", "skip_probability" if p < self.p_min else "skip_cost" if edge > 0 else "skip_ev", 0)]

    def close(self) -> list[tuple]:
        return []


class Overlay:
    """Delays entries of a 0/1 position while liquidity is poor: at most ``defers`` bars, then that episode is dropped."""

    def __init__(self, defers: int = 3):
        self.defers, self.count, self.was = defers, 0, 0
        self.inside = self.skipped = False

    def push(self, row: tuple) -> list[tuple]:
        ts, pos, ok = row
        verdict = None
        if not pos:
            self.inside = self.skipped = False
        elif not self.was or not (self.inside or self.skipped):
            if ok:
                verdict, self.inside, self.count = "ALLOW", True, 0
            else:
                self.count += 1
                verdict = "DEFER" if self.count <= self.defers else "SKIP"
                if verdict == "SKIP":
                    self.skipped, self.count = True, 0
        self.was = pos
        return [(ts, int(bool(pos) and self.inside), verdict)]

    def close(self) -> list[tuple]:
        return []


class Cooldown:
    """Greedy choice of events at least ``seconds`` apart and at most ``daily`` a day."""

    def __init__(self, seconds: float = 60.0, daily: int = 50):
        self.seconds, self.daily, self.last, self.today, self.taken = seconds, daily, None, None, 0

    def push(self, row: tuple) -> list[tuple]:
        micros, *rest = row
        day = micros // 86_400_000_000
        if day != self.today:
            self.today, self.taken = day, 0
        if self.taken >= self.daily or (self.last is not None and micros - self.last < self.seconds * 1e6):
            return []
        self.last, self.taken = micros, self.taken + 1
        return [(micros, *rest)]

    def close(self) -> list[tuple]:
        return []


class RiskLadder:
    """Signals in order through the risk checks; what is approved counts against those after it."""

    def __init__(self, equity: float, kill: bool = False, daily: float = 0.0, weekly: float = 0.0, total: float = 0.05, symbol: float = 0.5):
        self.equity, self.blocked = equity, "kill_switch" if kill else "daily_loss" if daily <= -0.02 else "weekly_loss" if weekly <= -0.05 else None
        self.total, self.symbol = total, symbol
        self.risk, self.notional = 0.0, {}

    def push(self, row: tuple) -> list[tuple]:
        signal, action, symbol, enabled, stale_s, size, price, stop = row
        return [(signal, *self._judge(action, symbol, enabled, stale_s, size, price, stop))]

    def _judge(self, action, symbol, enabled, stale_s, size, price, stop) -> tuple[bool, str]:
        if action == "EXIT":
            return True, "exit"
        if action == "SELL":
            return False, "sell_blocked"
        if self.blocked:
            return False, self.blocked
        if not enabled:
            return False, "disabled"
        if stale_s > 600:
            return False, "stale_data"
        if not size or size <= 0:
            return False, "bad_size"
        risk, value = size * abs(price - stop), size * price
        if self.risk + risk > self.total * self.equity:
            return False, "total_risk"
        if self.notional.get(symbol, 0.0) + value > self.symbol * self.equity:
            return False, "symbol_exposure"
        self.risk += risk
        self.notional[symbol] = self.notional.get(symbol, 0.0) + value
        return True, "approved"

    def close(self) -> list[tuple]:
        return []


class Guards:
    """Entry guards over an equity path, in order; a drawdown kill is for good, a daily halt until the next UTC day."""

    def __init__(self, drawdown: float = 0.15, daily: float = 0.03, trades: int = 10, cooldown_h: float = 4.0):
        self.limits = (drawdown, daily, trades, cooldown_h)
        self.peak = self.day_start = 0.0
        self.killed = self.halted = False
        self.day, self.trades, self.last = None, 0, {}

    def push(self, row: tuple) -> list[tuple]:
        micros, symbol, equity = row
        drawdown, daily, trades, cooldown = self.limits
        day = micros // 86_400_000_000
        if day != self.day:
            self.day, self.day_start, self.trades, self.halted = day, equity, 0, False
        self.peak = max(self.peak, equity)
        if not self.killed and self.peak > 0 and equity / self.peak - 1 <= -drawdown:
            self.killed = True
        if not self.killed and not self.halted and self.day_start > 0 and equity / self.day_start - 1 <= -daily:
            self.halted = True
        before = self.last.get(symbol)
        reason = (
            "drawdown_kill" if self.killed else "daily_halt" if self.halted else "max_trades" if self.trades >= trades
            else "cooldown" if before is not None and micros - before < cooldown * 3.6e9 else None
        )
        if reason is None:
            self.trades, self.last[symbol] = self.trades + 1, micros
        return [(micros, symbol, reason is None, reason or "allowed")]

    def close(self) -> list[tuple]:
        return []


class PaperBroker:
    """Cash, one quantity for each symbol, fills with cost; orders beyond cash or holdings are turned down."""

    def __init__(self, cash: float = 100_000.0, cost: float = 0.001):
        self.cash, self.cost, self.held, self.marks = cash, cost, {}, {}

    def push(self, row: tuple) -> list[tuple]:
        order, symbol, side, quantity, price = row
        self.marks[symbol] = price
        own = self.held.get(symbol, 0.0)
        if side == "buy" and quantity * price * (1 + self.cost) <= self.cash:
            self.cash -= quantity * price * (1 + self.cost)
            self.held[symbol], status = own + quantity, "filled"
        elif side == "sell" and own >= quantity:
            self.cash += quantity * price * (1 - self.cost)
            self.held[symbol], status = own - quantity, "filled"
        else:
            status = "rejected"
        exposure = sum(q * self.marks[s] for s, q in self.held.items())
        return [(order, status, self.cash, self.cash + exposure, exposure)]

    def close(self) -> list[tuple]:
        return []


class Continuity:
    """Order book updates by sequence number: apply what follows on, skip what is old, resync after a gap."""

    def __init__(self):
        self.last = None

    def push(self, row: tuple) -> list[tuple]:
        first, final = row
        if self.last is None or first <= self.last + 1 <= final:
            verdict = "apply"
        else:
            verdict = "skip" if final <= self.last else "resync"
        if verdict != "skip":
            self.last = final
        return [(first, final, verdict)]

    def close(self) -> list[tuple]:
        return []


class Gaps:
    """Tells when a series that paused longer than allowed goes on, and how long it paused."""

    def __init__(self, key, seconds: float = 7200):
        self.seconds, self.last = seconds, None

    def push(self, row):
        (micros,) = row
        gap = None if self.last is None else micros - self.last
        self.last = micros
        return [(micros, gap / 1e6)] if gap is not None and gap > self.seconds * 1e6 else []

    def close(self) -> list[tuple]:
        return []


class Latch:
    """A regime latch and a running maximum, bar by bar."""

    def __init__(self, key):
        self.on, self.top = False, None

    def push(self, row):
        at, close, enter, leave = row
        self.on = False if leave else True if enter else self.on
        self.top = close if self.top is None else max(self.top, close)
        return [(at, self.on, self.top)]

    def close(self) -> list[tuple]:
        return []
