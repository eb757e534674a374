"""Queries that SQL can't express, on whole tables, against plain loops written for the test."""

import datetime as dt

import numpy as np
import pytest

from quernstone.functions import scalars as S
from quernstone.operators import chunked
from quernstone.operators.joins import day_of
from quernstone.queries import QUERIES
from quernstone.queries.validation import FEATURES, micro_matrix
from quernstone.sources.bars import daily_bars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    out = {}
    for r in daily_bars(spark, SF).orderBy("symbol", "ts").collect():
        out.setdefault(r["symbol"], []).append(r)
    return out


def same(a, b, places=4):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= 10**-places * (1 + abs(b)))


def test_adx(spark, series):
    """Wilder's sums over the first n moves, then smoothed; the index averages n of their ratios, then is smoothed."""
    n, got = 14, {(r["symbol"], r["ts"]): r for r in QUERIES["X5_adx"](spark, SF).collect()}
    for symbol, bars in series.items():
        tr, up, down = [bars[0]["high"] - bars[0]["low"]], [0.0], [0.0]
        for a, b in zip(bars, bars[1:]):
            rise, fall = b["high"] - a["high"], a["low"] - b["low"]
            tr.append(max(b["high"] - b["low"], abs(b["high"] - a["close"]), abs(b["low"] - a["close"])))
            up.append(rise if rise > fall and rise > 0 else 0.0)
            down.append(fall if fall > rise and fall > 0 else 0.0)
        sums, dx, adx = None, [], None
        for i, b in enumerate(bars):
            want = (None, None, None)
            if i >= n:
                sums = [sum(x[1 : n + 1]) for x in (tr, up, down)] if i == n else [s - s / n + x[i] for s, x in zip(sums, (tr, up, down))]
                if sums[0]:
                    plus, minus = 100 * sums[1] / sums[0], 100 * sums[2] / sums[0]
                    dx.append(100 * abs(plus - minus) / (plus + minus) if plus + minus else 0.0)
                    adx = (adx * (n - 1) + dx[-1]) / n if adx is not None else sum(dx) / n if len(dx) == n else None
                    want = (adx, plus, minus)
            r = got.pop((symbol, b["ts"]))
            assert all(same(x, y) for x, y in zip((r["adx_value"], r["adx_plus"], r["adx_minus"]), want)), (symbol, i)
    assert not got


def test_parabolic_stop(spark, series):
    """The stop follows the extreme faster with each new one, never into the last two bars, and turns where it is crossed."""
    got = {(r["symbol"], r["ts"]): r for r in QUERIES["X7_psar"](spark, SF).collect()}
    for symbol, bars in series.items():
        high, low = [b["high"] for b in bars], [b["low"] for b in bars]
        long = high[1] >= high[0]
        stop, best, pace = (low[0], max(high[:2]), 0.02) if long else (high[0], min(low[:2]), 0.02)
        for i, b in enumerate(bars):
            r = got.pop((symbol, b["ts"]))
            if i < 2:
                assert r["psar_value"] is None
                continue
            stop += pace * (best - stop)
            stop = min(stop, low[i - 1], low[i - 2]) if long else max(stop, high[i - 1], high[i - 2])
            if (long and low[i] < stop) or (not long and high[i] > stop):
                long, stop, pace, best = not long, best, 0.02, low[i] if long else high[i]
            elif (long and high[i] > best) or (not long and low[i] < best):
                best, pace = high[i] if long else low[i], min(pace + 0.02, 0.2)
            assert same(r["psar_value"], stop) and r["psar_direction"] == (1 if stop < b["close"] else -1 if stop > b["close"] else None), (symbol, i)
    assert not got


def events(spark):
    return sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r["event_type"], r["ts"], r["event_id"]))


def test_cooldown(spark):
    """Greedy by event type: half an hour apart, thirty a day."""
    want, last, days = [], {}, {}
    for r in events(spark):
        k, day = r["event_type"], (r["event_type"], r["ts"].date())
        if (k not in last or r["ts"] - last[k] >= dt.timedelta(seconds=1800)) and days.get(day, 0) < 30:
            last[k], days[day] = r["ts"], days.get(day, 0) + 1
            want.append((k, r["event_id"]))
    assert sorted((r["event_type"], r["event_id"]) for r in QUERIES["K4_cooldown"](spark, SF).collect()) == sorted(want)


def test_sequence_continuity(spark):
    want, last = [], {}
    for k, i in sorted((r["event_type"], r["event_id"]) for r in events(spark)):
        first, final = 10 * i, 10 * i + 9 + (500 if i % 7 == 0 else 0)
        verdict = "apply" if k not in last or first <= last[k] + 1 <= final else "skip" if final <= last[k] else "resync"
        if verdict != "skip":
            last[k] = final
        want.append((k, first, final, verdict))
    assert sorted(map(tuple, QUERIES["ST8_sequence_continuity"](spark, SF).select("symbol", "first_id", "final_id", "verdict").collect())) == sorted(want)


def test_ridge(spark):
    rows = {}
    for r in micro_matrix(spark, SF).orderBy("symbol", "bar").collect():
        rows.setdefault(r["symbol"], []).append([r[c] for c in FEATURES] + [r["y"]])
    got = {r["symbol"]: r for r in QUERIES["V17_ridge"](spark, SF).collect()}
    assert sorted(got) == sorted(rows)
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for k, m in rows.items():
        m = np.array(m)
        cut = int(len(m) * 0.7)
        x, y = m[:, :-1], m[:, -1]
        sd = x[:cut].std(axis=0)
        z = (x - x[:cut].mean(axis=0)) / np.where(sd == 0, 1.0, sd)
        b = np.linalg.solve(z[:cut].T @ z[:cut] + np.eye(5), z[:cut].T @ (y[:cut] - y[:cut].mean()))
        p = y[:cut].mean() + z @ b
        fit = lambda s: 1 - ((y[s] - p[s]) ** 2).sum() / ((y[s] - y[s].mean()) ** 2).sum()
        ic = np.corrcoef(rank(y[cut:]), rank(np.round(p[cut:], 12)))[0, 1]
        r = got[k]
        assert (r["n_train"], r["n_test"]) == (cut, len(m) - cut)
        assert abs(r["r2_train"] - fit(slice(0, cut))) < 1e-5 and abs(r["r2_test"] - fit(slice(cut, None))) < 1e-5 and abs(r["ic"] - ic) < 1e-3


def test_normal_distribution(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    xs = [-40.0, -8.5, -7.0, -3.3, -0.1, 0.0, 0.7, 5.0, 7.2, 9.0, None]
    ps = [1e-12, 0.001, 0.02, 0.3, 0.5, 0.8, 0.99, 1 - 1e-9, 0.0, 1.0, None]
    rows = spark.createDataFrame(list(zip(xs, ps)), "x double, p double").select("x", "p", S.norm_cdf(F.col("x")).alias("c"), S.norm_ppf(F.col("p")).alias("q")).collect()
    for r in rows:
        assert r["c"] is None if r["x"] is None else abs(r["c"] - NormalDist().cdf(r["x"])) < 1e-13
        assert r["q"] is None if r["p"] in (0.0, 1.0, None) else abs(r["q"] - NormalDist().inv_cdf(r["p"])) < 1e-7


def test_chunks_change_nothing(spark, monkeypatch):
    """Sums, maxima, numbers, as-of values and first breaches over chunks, against one walk."""
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(chunked, "FAN_OUT", 3)
    draw = random.Random(4)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randrange(900)), i, float(draw.randrange(-50, 50))) for i, k in enumerate(draw.choices("ab", k=400))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v double").withColumn("day", day_of("ts"))
    out = chunked.running_sum(df, ["k"], "day", ["ts", "id"], F.col("v"), "s")
    out = chunked.running_max(out, ["k"], "day", ["ts", "id"], "v", "m")
    got = {r["id"]: (r["s"], r["m"], r["n"]) for r in chunked.numbered(out, ["k"], "day", ["ts", "id"], "n").collect()}
    for k in "ab":
        walk, s, m = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 0.0, -99.0
        for n, r in enumerate(walk):
            s, m = s + r[3], max(m, r[3])
            assert got[r[2]] == (s, m, n)
    points = spark.createDataFrame([(i, k, t + dt.timedelta(minutes=draw.choice([0, 30])), float(draw.randrange(-60, 60))) for i, (k, t, _, _) in enumerate(rows[:150])], "pid int, k string, at timestamp_ntz, bound double")
    hits = {r["pid"]: (r["hit_ts"], r["hit_value"]) for r in chunked.first_at_or_below(points, df, ["k"], "pid", "at", "bound", "ts", "v", day_of("_t")).collect()}
    for p in points.collect():
        low = sorted((r[1], r[3]) for r in rows if r[0] == p["k"] and r[1] >= p["at"] and r[3] <= p["bound"])
        assert hits.get(p["pid"]) == (low[0] if low else None)
    quotes = df.groupBy("k", "ts").agg(F.max("v").alias("v"))
    known = {(r["k"], r["ts"]): r["v"] for r in quotes.collect()}
    for strict in (False, True):
        for r in chunked.asof(points, quotes, ["k"], "at", "ts", ["v"], day_of("_t"), strict).collect():
            before = [t for k, t in known if k == r["k"] and (t < r["at"] if strict else t <= r["at"])]
            assert r["v"] == (known[r["k"], max(before)] if before else None)


def pooled(x, y):
    """Isotonic values by pooling neighbours that fall, at the sorted ``x``."""
    order = np.argsort(x)
    pools = []
    for v in y[order]:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    return x[order], np.concatenate([np.full(n, v) for v, n in pools])


def test_fold_fit(spark):
    """Newton's method, pooled neighbours, all pairs and a plain median, against a fold's fit."""
    from pyspark.sql import functions as F

    from quernstone.plans import validation as V

    draw = np.random.default_rng(8)
    n = 900
    x = draw.normal(size=(n, 2)) * [3.0, 0.2]
    r = (0.4 * x[:, 0] - 4 * x[:, 1] + draw.normal(size=n) * 2) / 100
    implied = np.where(np.arange(n) % 9 == 0, 0.0, 50 + 100 * draw.random(n))
    day = [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    rows = [("s", t, *map(float, a), None if i == 3 else float(b), float(c)) for i, (t, a, b, c) in enumerate(zip(day, x, r, implied))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double, r double, implied double")
    plan = V.folds(spark, "2020-01-01", 500, 200, 100, 400, 2, purge_h=48)
    got = V.fit_folds(df, plan, ["a", "b"], least=(300, 100, 100)).orderBy("ts").collect()
    assert {g["fold"] for g in got} == {0} and [g["ts"] for g in got] == day[700:800]  # the second fold has no whole test span

    train = np.array([i for i in range(498) if i != 3])
    y = (r > 0).astype(float)
    scale = x[train].std(axis=0, ddof=1)
    z = np.c_[x / scale, np.ones(n)]
    w, own = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z[train] @ w))
        w -= np.linalg.solve((z[train].T * (p * (1 - p))) @ z[train] + own, z[train].T @ (p - y[train]) + own @ w)
    raw = 1 / (1 + np.exp(-z @ w))
    val, test = slice(500, 700), slice(700, 800)
    up, down = raw[val][y[val] == 1], raw[val][y[val] == 0]
    auc = ((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down))
    k = np.median((abs(r[val]) * 1e4 / np.where(implied[val] > 0, implied[val], 1))[implied[val] > 0])
    assert abs(got[0]["val_auc"] - auc) < 1e-3 and abs(got[0]["k"] - k) < 1e-9
    assert np.abs(np.array([g["p_up"] for g in got]) - np.interp(raw[test], *pooled(raw[val], y[val]))).mean() < 2e-3

    trees = V.boost_folds(df, plan, ["a", "b"], least=(300, 100, 100)).collect()
    assert len(trees) == 100 and trees[0]["val_auc"] > 0.7 and all(0 <= g["p_up"] <= 1 for g in trees) and abs(trees[0]["k"] - got[0]["k"]) < 1e-12
    hits = lambda rows: sum((g["p_up"] >= 0.5) == (g["y"] == 1) for g in rows)
    assert hits(trees) > 60 and hits(trees) > hits(got) - 15
    for fit in (V.fit_folds, V.boost_folds):
        assert fit(df.limit(0), plan, ["a", "b"]).collect() == [] and fit(df.withColumn("r", F.lit(0.5)), plan, ["a", "b"], least=(300, 100, 100)).collect() == []


def test_one_tree():
    """A tree of two levels against trying every feature and cut of every node."""
    from quernstone.plans import boosting as B

    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 3)).round(1)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + draw.normal(size=400) > 0).astype(float)
    how = B.Boosting(trees=1, depth=2, rate=0.5, row_share=2.0, column_share=1.0, least_weight=5.0)
    got = B.scores(x, y, [x], how)[0]
    base = np.log(y.mean() / (1 - y.mean()))
    p = np.full(400, y.mean())
    g, h = p - y, p * (1 - p)
    codes = B.coded(x, B.edges_of(x))
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + how.ridge)

    def split(rows):
        found = []
        for f in range(3):
            for cut in range(B.BINS):
                left, right = rows[codes[rows, f] <= cut], rows[codes[rows, f] > cut]
                if h[left].sum() >= how.least_weight and h[right].sum() >= how.least_weight:
                    found.append((round(score(left) + score(right) - score(rows), 10), -f, -cut, left, right))
        return max(found, key=lambda t: t[:3])[3:] if found else (rows, rows[:0])

    want = np.zeros(400)
    for half in split(np.arange(400)):
        for rows in split(half):
            if len(rows):
                want[rows] = base - how.rate * g[rows].sum() / (h[rows].sum() + how.ridge)
    assert np.abs(got - 1 / (1 + np.exp(-want))).max() < 1e-12
    more = B.scores(x, y, [x], B.Boosting(trees=100))[0]
    loss = lambda q: -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))
    assert loss(more) < loss(got) < loss(p)


def test_isotonic_and_area():
    from quernstone.plans import boosting as B

    draw = np.random.default_rng(5)
    x, y = draw.integers(0, 20, 300) / 10.0, draw.integers(0, 2, 300).astype(float)
    at, value = B.pooled(x, y)
    assert (np.diff(value) >= 0).all() and at.tolist() == sorted(set(x.tolist()))
    # no other rising sequence is nearer: means of all stretches bound it from both sides
    mean = lambda i, j: y[(x >= at[i]) & (x <= at[j])].mean()
    for k in range(len(at)):
        assert abs(value[k] - max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1))) < 1e-12
    up, down = x[y == 1], x[y == 0]
    assert abs(B.auc(x, y) - ((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down))) < 1e-12


def ema(xs, n, alpha=None):
    """From the first value on; none before the n-th."""
    a, e, out = alpha or 2 / (n + 1), None, []
    for i, x in enumerate(xs):
        e = x if e is None else a * x + (1 - a) * e
        out.append(e if alpha or i >= n - 1 else None)
    return out


def true_ranges(bars):
    return [b["high"] - b["low"] if i == 0 else max(b["high"] - b["low"], abs(b["high"] - bars[i - 1]["close"]), abs(b["low"] - bars[i - 1]["close"])) for i, b in enumerate(bars)]


def test_turtle(spark, series):
    """The slow trend follower and its run, bar by bar."""
    got = {r["symbol"]: r for r in QUERIES["B17_turtle"](spark, SF).collect()}
    assert set(got) == set(series)
    for symbol, bars in series.items():
        close, opens = [b["close"] for b in bars], [b["open"] for b in bars]
        fast, slow, atr = ema(close, 50), ema(close, 200), ema(true_ranges(bars), 14, 1 / 14)
        pos, inside, top, wait = [], False, 0.0, 0
        for i, c in enumerate(close):
            ok = fast[i] is not None and slow[i] is not None
            if inside:
                top = max(top, c)
                if c <= top - 3 * atr[i] or fast[i] < slow[i]:
                    inside, wait = False, 4
            elif wait:
                wait -= 1
            elif ok and i >= 55 and c > fast[i] > slow[i] and c > max(b["high"] for b in bars[i - 55 : i]):
                inside, top = True, c
            pos.append(int(inside))
        total, held = 0.0, [0, *pos[:-1]]
        for i, h in enumerate(held):
            was = held[i - 1] if i else 0
            last = i == len(held) - 1
            g = opens[i + 1] / opens[i] if h and not last else 1.0
            g *= (1 / 1.001 if h and not was else 1.0) * (0.999 if was and not h else 1.0) * (0.999 if last and h else 1.0)
            total += np.log(g)
        assert got[symbol]["bars_in"] == sum(pos) and abs(got[symbol]["log_total"] - total) < 1e-4


def test_feature_matrix(spark):
    """Returns, volatility, averages and bands of each hourly bar, against numpy on whole series."""
    from quernstone.sources.bars import event_bars

    own = {}
    for r in event_bars(spark, SF).orderBy("symbol", "ts").collect():
        own.setdefault(r["symbol"], []).append(r)
    got = {(r["symbol"], r["ts"]): r for r in QUERIES["X10_feature_matrix"](spark, SF).collect()}
    assert len(got) == sum(map(len, own.values()))
    for symbol, bars in own.items():
        c, high, low, volume = (np.array([b[k] for b in bars]) for k in ("close", "high", "low", "volume"))
        line = [f - s if f is not None and s is not None else None for f, s in zip(ema(c, 12), ema(c, 26))]
        signal = [None] * (len(line) - len([x for x in line if x is not None])) + ema([x for x in line if x is not None], 9)
        change = np.maximum(np.diff(c, prepend=c[0]), 0), np.maximum(-np.diff(c, prepend=c[0]), 0)
        up, down = ema(change[0], 14, 1 / 14), ema(change[1], 14, 1 / 14)
        mean, atr = ema(c, 20, 2 / 21), ema(true_ranges(bars), 14, 1 / 14)
        logs = np.log(c)
        for i, b in enumerate(bars):
            r = got[symbol, b["ts"]]
            for n in (1, 3, 6, 12, 24):
                assert same(r[f"ret_{n}"], logs[i] - logs[i - n] if i >= n else None)
            for n in (24, 72):
                assert same(r[f"vol_{n}"], np.diff(logs[i - n : i + 1]).std(ddof=1) if i >= n else None)
            assert same(r["ema_gap"], c[i] / mean[i] - 1) and same(r["atr_pct"], atr[i] / c[i])
            assert same(r["rsi"], 100 - 100 / (1 + up[i] / down[i]) if down[i] else None)
            assert same(r["macd"], line[i] - signal[i] if signal[i] is not None else None)
            w = slice(i - 19, i + 1)
            if i >= 19:
                sd = c[w].std(ddof=1)
                assert same(r["percent_b"], (c[i] - c[w].mean() + 2 * sd) / (4 * sd) if sd else None)
                assert same(r["donchian"], (c[i] - low[w].min()) / (high[w].max() - low[w].min()) if high[w].max() > low[w].min() else None)
                sv = volume[w].std(ddof=1)
                assert same(r["volume_z"], (volume[i] - volume[w].mean()) / sv if sv else None)
            else:
                assert r["percent_b"] is None and r["donchian"] is None and r["volume_z"] is None
            assert same(r["hour_sin"], np.sin(2 * np.pi * b["ts"].hour / 24)) and same(r["day_cos"], np.cos(2 * np.pi * b["ts"].weekday() / 7))
