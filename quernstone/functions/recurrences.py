"""Recurrent indicators as small states: each ``push`` takes a bar's values and gives the indicator's.

None stands for what is not there yet. Two families must not be mixed: the classic one has
a warm-up (and Wilder's average true range starts from a plain mean); the research one
starts from the first row.
"""

from __future__ import annotations


class Ema:
    """e = a*x + (1-a)*e from the first value; given out from the n-th on if ``warm``."""

    def __init__(self, n: int, warm: bool = True, alpha: float | None = None):
        self.a = alpha if alpha is not None else 2 / (n + 1)
        self.least, self.seen, self.e = n if warm else 1, 0, None

    def push(self, x: float | None) -> float | None:
        if x is None:
            return None
        self.e = x if self.e is None else self.a * x + (1 - self.a) * self.e
        self.seen += 1
        return self.e if self.seen >= self.least else None


class TrueRange:
    def __init__(self):
        self.before = None

    def push(self, high: float, low: float, close: float) -> float:
        p, self.before = self.before, close
        return high - low if p is None else max(high - low, abs(high - p), abs(low - p))


class Atr:
    """Wilder's: the mean of the first n true ranges, then smoothed; None before that."""

    def __init__(self, n: int):
        self.n, self.tr, self.first, self.value = n, TrueRange(), [], None

    def push(self, high: float, low: float, close: float) -> float | None:
        tr = self.tr.push(high, low, close)
        if self.value is not None:
            self.value = (self.value * (self.n - 1) + tr) / self.n
        else:
            self.first.append(tr)
            if len(self.first) == self.n:
                self.value = sum(self.first) / self.n
        return self.value


class ResearchAtr:
    """Exponential with a = 1/n from the first row."""

    def __init__(self, n: int):
        self.tr, self.ema = TrueRange(), Ema(n, warm=False, alpha=1 / n)

    def push(self, high: float, low: float, close: float) -> float:
        return self.ema.push(self.tr.push(high, low, close))


class Rsi:
    """100 where nothing fell; the research variant has no warm-up and gives None there."""

    def __init__(self, n: int, research: bool = False):
        self.up, self.down = Ema(n, False, 1 / n), Ema(n, False, 1 / n)
        self.before, self.seen, self.least, self.research = None, 0, 1 if research else n, research

    def push(self, close: float) -> float | None:
        change = 0.0 if self.before is None else close - self.before
        self.before = close
        up, down = self.up.push(max(change, 0.0)), self.down.push(max(-change, 0.0))
        self.seen += 1
        if self.seen < self.least:
            return None
        if down == 0:
            return None if self.research else 100.0
        return 100 - 100 / (1 + up / down)


class Macd:
    """Line, signal and histogram."""

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.fast, self.slow, self.signal = Ema(fast), Ema(slow), Ema(signal)

    def push(self, close: float) -> tuple[float | None, float | None, float | None]:
        f, s = self.fast.push(close), self.slow.push(close)
        line = f - s if f is not None and s is not None else None
        signal = self.signal.push(line)
        return line, signal, line - signal if signal is not None else None


class Keltner:
    """Upper, middle, lower: an exponential mean of closes and multiples of the true range."""

    def __init__(self, n: int = 20, atr: int = 10, multiple: float = 2.0):
        self.mid, self.atr, self.k = Ema(n), Atr(atr), multiple

    def push(self, high: float, low: float, close: float) -> tuple[float | None, float | None, float | None]:
        m, a = self.mid.push(close), self.atr.push(high, low, close)
        return (m + self.k * a, m, m - self.k * a) if m is not None and a is not None else (None, m, None)


class Adx:
    """Wilder's directional index: ADX, +DI, -DI."""

    def __init__(self, n: int = 14):
        self.n, self.tr = n, TrueRange()
        self.high = self.low = None
        self.sums, self.seen = [0.0, 0.0, 0.0], 0
        self.dx, self.value = [], None

    def push(self, high: float, low: float, close: float) -> tuple[float | None, float | None, float | None]:
        tr = self.tr.push(high, low, close)
        if self.high is None:
            self.high, self.low = high, low
            return None, None, None
        up, down = high - self.high, self.low - low
        self.high, self.low = high, low
        moves = (tr, up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0)
        self.seen += 1
        self.sums = [s + x if self.seen <= self.n else s - s / self.n + x for s, x in zip(self.sums, moves)]
        if self.seen < self.n or not self.sums[0]:
            return None, None, None
        plus, minus = 100 * self.sums[1] / self.sums[0], 100 * self.sums[2] / self.sums[0]
        dx = 100 * abs(plus - minus) / (plus + minus) if plus + minus else 0.0
        if self.value is not None:
            self.value = (self.value * (self.n - 1) + dx) / self.n
        else:
            self.dx.append(dx)
            if len(self.dx) == self.n:
                self.value = sum(self.dx) / self.n
        return self.value, plus, minus


class Psar:
    """Parabolic stop and reverse: value, and direction by the side of the close it lies on (None if equal)."""

    def __init__(self, step: float = 0.02, most: float = 0.2):
        self.step, self.most = step, most
        self.bars: list[tuple[float, float]] = []
        self.rising, self.sar, self.extreme, self.factor = True, None, None, step

    def push(self, high: float, low: float, close: float) -> tuple[float | None, int | None]:
        if len(self.bars) < 2:
            self.bars.append((high, low))
            if len(self.bars) == 2:
                self.rising = high >= self.bars[0][0]
                self.extreme = max(self.bars[0][0], high) if self.rising else min(self.bars[0][1], low)
                self.sar = self.bars[0][1] if self.rising else self.bars[0][0]
            return None, None
        (h1, l1), (h2, l2) = self.bars
        sar = self.sar + self.factor * (self.extreme - self.sar)
        sar = min(sar, l1, l2) if self.rising else max(sar, h1, h2)
        if (low < sar) if self.rising else (high > sar):
            self.rising, sar, self.factor = not self.rising, self.extreme, self.step
            self.extreme = high if self.rising else low
        elif (high > self.extreme) if self.rising else (low < self.extreme):
            self.extreme, self.factor = high if self.rising else low, min(self.factor + self.step, self.most)
        self.sar, self.bars = sar, [(h2, l2), (high, low)]
        return sar, 1 if sar < close else -1 if sar > close else None


class Bands:
    """Value and direction from bars and their true range. Bands tighten only, unless the close before broke through them."""

    def __init__(self, multiple: float = 3.0):
        self.k = multiple
        self.upper = self.lower = self.close = None
        self.up = False

    def push(self, high: float, low: float, close: float, a: float | None) -> tuple[float | None, int | None]:
        mid = (high + low) / 2
        if a is None or a != a:
            self.close = close
            return None, None
        bu, bl = mid + self.k * a, mid - self.k * a
        if self.upper is None:
            self.upper, self.lower, self.up = bu, bl, close > mid
        else:
            self.upper = bu if bu < self.upper or self.close > self.upper else self.upper
            self.lower = bl if bl > self.lower or self.close < self.lower else self.lower
            self.up = close >= self.lower if self.up else close > self.upper
        self.close = close
        return (self.lower if self.up else self.upper), 1 if self.up else -1


class Supertrend(Bands):
    """The same with Wilder's true range of n bars."""

    def __init__(self, n: int = 10, multiple: float = 3.0):
        super().__init__(multiple)
        self.atr = Atr(n)

    def push(self, high: float, low: float, close: float) -> tuple[float | None, int | None]:
        return super().push(high, low, close, self.atr.push(high, low, close))
