"""Ranks in windows, exact quantiles, greedy picks, missing spans, lookups in spans and shifted weights, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import chunked, cooldown
from quernstone.operators.joins import day_of
from quernstone.operators.quantiles import exact_quantiles
from quernstone.operators.rangerank import range_ranks, with_matched_percentile, with_percentile_rank
from quernstone.plans import validation as V
from quernstone.sources import store

T0 = dt.datetime(2020, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_percentile_rank(spark, n):
    draw = random.Random(n)
    rows = [(k, hours(i * 30), None if draw.random() < 0.02 else float(draw.randrange(12))) for k in ("a", "b", None) for i in range(150)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, v double").where("symbol IS NOT NULL")
    got = {(r["symbol"], r["ts"]): r["rank"] for r in with_percentile_rank(df, "v", n, "rank").collect()}
    assert len(got) == 300
    for k in ("a", "b"):
        own = [r for r in rows if r[0] == k]
        for i, (_, ts, v) in enumerate(own):
            window = [r[2] for r in own[max(0, i - n + 1) : i + 1]]
            if len(window) < n or None in window:
                assert got[k, ts] is None
            else:
                assert abs(got[k, ts] - (sum(x < v for x in window) + (sum(x == v for x in window) + 1) / 2) / n) < 1e-12


def test_wide_windows_and_their_plan(spark):
    """Ten thousand bars to a window; no row sees them as a list."""
    draw = np.random.default_rng(1)
    v = draw.normal(size=12_000).round(2)
    rows = [("a", i, max(0, i - 9_999), float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "symbol string, i long, lo long, v double")
    found = range_ranks(df, ["symbol"], "i", "v", "lo", "i", 10_000)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = {r["i"]: (r["less"], r["equal"], r["n"]) for r in found.collect()}
    for i in (*range(0, 12_000, 997), 9_999, 10_000, 11_999):
        window = v[max(0, i - 9_999) : i + 1]
        assert got[i] == ((window < v[i]).sum(), (window == v[i]).sum(), len(window))


def test_matched_percentile(spark):
    draw = random.Random(3)
    rows = [(k, hours(h), float(draw.randrange(30)), h % 5) for k in "ab" for h in sorted(draw.sample(range(900), 300))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, v double, g int")
    got = {(r["symbol"], r["ts"]): r["pct"] for r in with_matched_percentile(df, "v", "g", 10, 8, "pct", longest=241).collect()}
    for k, ts, v, g in rows:
        every = [r for r in rows if r[0] == k and ts - dt.timedelta(days=10) <= r[1] <= ts]
        own = [r for r in every if r[3] == g]
        some = [r[2] for r in (every if len(own) < 8 else own)]
        assert abs(got[k, ts] - (sum(x < v for x in some) + 0.5 * sum(x == v for x in some)) / len(some)) < 1e-12


def test_exact_quantiles(spark):
    """Any doubles: signs, zeros, infinities, tiny and huge ones, repeats; interpolated like numpy does."""
    draw = np.random.default_rng(2)
    groups = {
        "one": [3.5],
        "ties": [1.0] * 50 + [2.0] * 50,
        "wide": list(draw.normal(size=500) * 10.0 ** draw.integers(-300, 300, 500)),
        "near": list(1.0 + np.arange(40) * 2.0**-52),
        "zeros": [0.0, -0.0, 5e-324, -5e-324],
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    wanted = {"least": 0.0, "low": 0.05, "mid": 0.5, "high": 0.9, "most": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], F.col("v"), wanted).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        for name, q in wanted.items():
            x = np.sort(np.array(xs))
            at = (len(x) - 1) * q
            lo, share = int(at), at - int(at)
            want = x[lo] if share == 0 else (1 - share) * x[lo] + share * x[lo + 1]
            assert got[k][name] == want, (k, name)
    assert exact_quantiles(df.where("k = 'ties'"), [], F.col("v"), {"q": 0.5}).collect() == [(1.5,)]
    assert exact_quantiles(df.limit(0), ["k"], F.col("v"), wanted).collect() == []
    odd = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (float("nan"),)], "v double")
    row = exact_quantiles(odd, [], F.col("v"), {"a": 0.0, "b": 2 / 3, "c": 1.0}).first()
    assert (row["a"], row["b"]) == (float("-inf"), float("inf")) and row["c"] != row["c"]


@pytest.mark.parametrize("cap", [1, 3, 30])
def test_greedy_picks(spark, cap):
    """Dense and sparse days, ties, a first pick after midnight that depends on the day before, null keys."""
    draw = random.Random(cap)
    rows = []
    for k in ("a", "b", None):
        for _ in range(400):
            at = draw.choice([0, 86_400 - 900, 86_400, 5 * 86_400]) + draw.randrange(0, 4000 if k == "a" else 90_000)
            rows.append((k, at * 1_000_000, draw.randrange(10**6)))
    df = spark.createDataFrame(rows, "k string, t long, o long").repartition(5)
    want = []
    for k in ("a", "b", None):
        last, day, n = None, None, 0
        for _, t, o in sorted(r for r in rows if r[0] == k):
            n = n if t // cooldown.DAY == day else 0
            if (last is None or t - last >= 1800 * 1_000_000) and n < cap:
                last, day, n = t, t // cooldown.DAY, n + 1
                want.append((k, t, o))
    got = [tuple(r) for r in cooldown.picked(df, ["k"], "t", "o", 1800, cap).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_missing_spans(spark):
    draw = random.Random(5)
    bars = sorted({(k, draw.randrange(60)) for k in "ab" for _ in range(50)})
    cached = spark.createDataFrame([(k, hours(h)) for k, h in bars], "symbol string, ts timestamp_ntz")
    wishes = [("a", 5, 20), ("a", 18, 40), ("a", 50, 50), ("b", -10, 5), ("b", 55, 90), ("c", 0, 3)]
    wished = spark.createDataFrame([(k, hours(a), hours(b)) for k, a, b in wishes], "symbol string, start timestamp_ntz, end timestamp_ntz")
    spans = store.missing_spans(wished, cached, ["symbol"], 3600).collect()
    got = {(r["symbol"], h) for r in spans for h in range(-10, 100) if r["start"] <= hours(h) < r["end"]}
    want = {(k, h) for k, a, b in wishes for h in range(a, b)} - set(bars)
    assert got == want
    for r in spans:  # as few spans as can be: no two touch
        assert not any(s["symbol"] == r["symbol"] and s["start"] == r["end"] for s in spans)
    source = spark.createDataFrame([(k, hours(h), h) for k in "abc" for h in range(-10, 100)], "symbol string, ts timestamp_ntz, v int")
    fetched = [(r["symbol"], r["v"]) for r in store.fetch_missing(wished, cached, source, ["symbol"], 3600).collect()]
    assert len(fetched) == len(set(fetched)) and set(fetched) == want


def test_first_of_each_key(spark):
    rows = [("a", 2, "late"), ("a", 1, "y"), ("a", 1, "x"), ("b", 9, "only")]
    df = spark.createDataFrame(rows, "k string, arrival int, v string")
    first = {tuple(sorted((r["k"], r["v"]) for r in store.first_of(df.repartition(n), ["k"], ["arrival"]).collect())) for n in (1, 3, 7)}
    assert len(first) == 1 and {v for _, v in first.pop()} in ({"x", "only"}, {"y", "only"})
    there = spark.createDataFrame([("b",)], "k string")
    assert [r["k"] for r in store.absent(df, there, ["k"], ["arrival"]).collect()] == ["a"]


@pytest.mark.parametrize("span, fan", [(1, 64), (5, 4), (400, 4), (400, 64)])
def test_first_in_a_span(spark, monkeypatch, span, fan):
    monkeypatch.setattr(chunked, "FAN_OUT", fan)
    draw = random.Random(span)
    rows = [(k, hours(draw.randrange(700)), float(draw.randrange(60))) for k in "ab" for _ in range(300)]
    points = [(i, draw.choice("abc"), hours(draw.randrange(-20, 720)) + dt.timedelta(minutes=draw.choice([0, 30])), float(draw.randrange(-2, 62))) for i in range(150)]
    series = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    asked = spark.createDataFrame([(i, k, t, t + dt.timedelta(hours=span), b) for i, k, t, b in points], "pid int, k string, at timestamp_ntz, until timestamp_ntz, bound double")
    hits = {r["pid"]: (r["hit_ts"], r["hit_value"]) for r in chunked.first_in_range(asked, series, ["k"], "pid", "at", "until", "bound", "ts", "v", day_of("_t")).collect()}
    for i, k, t, b in points:
        low = sorted((r[1], r[2]) for r in rows if r[0] == k and t <= r[1] <= t + dt.timedelta(hours=span) and r[2] <= b)
        assert hits.get(i) == (low[0] if low else None)


def test_shifted_totals(spark, monkeypatch):
    """Every shift at once, in blocks, against moving the weights round by hand."""
    monkeypatch.setattr(V, "CORRELATED", 16)
    draw = np.random.default_rng(6)
    rows, data = [], {}
    for symbol, n in (("a", 75), ("b", 16), ("c", 1)):
        opens, w = np.exp(draw.normal(size=n) / 9), draw.random(n)
        data[symbol] = opens, w
        rows += [(symbol, hours(24 * i), float(o), float(x)) for i, (o, x) in enumerate(zip(opens, w))]
    got = {(r["symbol"], r["shift"]): r["gross"] for r in V.shifted_totals(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, w double")).collect()}
    assert len(got) == 75 + 16 + 1
    for symbol, (opens, w) in data.items():
        n = len(w)
        move = np.append(opens[1:] / opens[:-1] - 1, 0.0)
        for s in range(n):
            moved = np.roll(w, s)
            assert abs(got[symbol, s] - (moved[:-1] * move[1:]).sum()) < 1e-12


def test_ranks_of_a_null(spark):
    drawn = spark.createDataFrame([(i, "a", float(i), 2.0) for i in range(4)] + [(0, "b", 1.0, 5.0)], "sim int, symbol string, v double, actual double")
    got = {r["symbol"]: (r["null_rank"], r["p_value"]) for r in V.with_rank(drawn, ["symbol"], "v").collect()}
    assert got == {"a": (0.5, 0.5), "b": (1.0, 0.0)}


def test_pair_correlations(spark):
    """Every two symbols, over what both have, whichever tiles and buckets they lie in."""
    from quernstone.operators.correlation import pair_correlations

    draw = np.random.default_rng(7)
    rows = [(f"s{k}", T0 + dt.timedelta(days=int(d)), None if draw.random() < 0.05 else float(draw.normal())) for k in range(23) for d in sorted(draw.choice(900, 400, replace=False))]
    rows += [("flat", T0 + dt.timedelta(days=d), 1.0) for d in range(900)]
    got = {(r["a"], r["b"]): r["rho"] for r in pair_correlations(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, r double")).collect()}
    data = {}
    for k, t, r in rows:
        if r is not None:
            data.setdefault(k, {})[t] = r
    names = sorted(data)
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    for (a, b), rho in got.items():
        both = sorted(set(data[a]) & set(data[b]))
        if "flat" in (a, b):
            assert rho is None
        else:
            assert abs(rho - np.corrcoef([data[a][t] for t in both], [data[b][t] for t in both])[0, 1]) < 1e-9


def test_failure_states(spark, tmp_path):
    """One alert a streak, one recovery, and a streak that is forgotten, whatever the batches."""
    from quernstone.streaming import engine as E
    from quernstone.streaming.failures import failure_states

    draw = random.Random(8)
    rows = [(i, draw.choice("abc"), hours(0) + dt.timedelta(minutes=37 * i), draw.random() < 0.6) for i in range(200)]
    want, state = [], {}
    for i, k, t, bad in rows:
        n, last = state.get(k, (0, None))
        n = 0 if last is None or t - last > dt.timedelta(hours=5) else n
        if bad:
            state[k] = (n + 1, t)
            want += [(i, k, "alert", 3)] if n + 1 == 3 else []
        else:
            state[k] = (0, None)
            want += [(i, k, "recovered", n)] if n >= 3 else []
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, bad boolean")
    for parts in (1, 5):
        path, schema = E.staged(df, "test-failures", "ts", parts)
        with E.rocksdb(spark):
            out = E.drain(failure_states(E.read_stream(spark, path, schema), "k", "id", 3, 5), "test-failures-out")
        assert sorted(map(tuple, out.collect())) == want


def test_sweep_cells_mutate_documents(spark):
    """Each cell is the document with other numbers in all the places of an axis; axes that matter least go where the grid is too large."""
    import json

    from quernstone.plans import sweeps

    average = lambda n: {"kind": "indicator", "name": "sma", "params": {"period": n}}
    cross = lambda side: {"type": "crossover", "series": average(20), "threshold": average(40), "direction": side}
    plain = {"entry": {"condition": cross("above")}, "exit": {"exits": [{"type": "condition", "condition": cross("below")}]}}
    stopped = {**plain, "exit": {"exits": [*plain["exit"]["exits"], {"type": "stop_loss", "method": {"kind": "percent", "value": 0.1}}]}}
    docs = spark.createDataFrame([(1, json.dumps(plain)), (2, json.dumps(stopped)), (3, json.dumps({"entry": {}}))], "id int, doc string")
    cells = sweeps.sweep_cells(docs, "id", "doc").collect()
    own = [c for c in cells if c["id"] == 1]
    assert len(own) == 25 and {c["cell"] for c in own} == set(range(25))
    got = {(sweeps.crossing(json.loads(c["document"])), c["away"]) for c in own}
    near = {20: {10: 2, 15: 1, 20: 0, 25: 1, 35: 2}, 40: {20: 2, 30: 1, 40: 0, 50: 1, 70: 2}}
    assert got == {((a, b) if a != b else None, x + y) for a, x in near[20].items() for b, y in near[40].items()}
    # 5 x 5 x 5 is too much: the stop matters most, then the shorter average
    other = [json.loads(c["document"]) for c in cells if c["id"] == 2]
    assert len(other) == 25 and {d["exit"]["exits"][1]["method"]["value"] for d in other} == {0.05, 0.075, 0.1, 0.125, 0.175}
    assert {d["entry"]["condition"]["threshold"]["params"]["period"] for d in other} == {40}
    assert not [c for c in cells if c["id"] == 3]
    assert sweeps.with_crossings(sweeps.sweep_cells(docs, "id", "doc")).count() == 24  # where both are 20 there is no crossing
