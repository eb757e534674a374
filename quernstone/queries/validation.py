"""Validation statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import conditions as C
from quernstone.functions import indicators as I
from quernstone.functions import scalars as S
from quernstone.operators import chunked
from quernstone.operators import engines as G
from quernstone.operators import joins as J
from quernstone.operators.quantiles import exact_quantiles
from quernstone.plans import sweeps
from quernstone.plans import validation as V
from quernstone.queries.aggregates import BPS, PORT, SIG, TRADES, VEC, WEIGHTS, signals, vector_run, vector_trades, weights
from quernstone.queries.joins import CELLS, FOLDS, MEMBERS, book, cells, folds
from quernstone.queries.registry import add, col, rounded, sql_rounded
from quernstone.queries.windows import RUN, W, sma
from quernstone.sources.bars import DAILY, HOURLY, daily_bars, event_bars, scan
from quernstone.sources.store import written



def engine_sql(src: str, keys: str, prefix: str = "z") -> str:
    """The vector engine over a table with open and pos, by keys, as CTEs ending in {prefix}r."""
    w = f"OVER (PARTITION BY {keys} ORDER BY ts)"
    return f"""{prefix}0 AS (SELECT *, coalesce(lag(pos) {w}, 0) AS held, lead(open) {w} AS nxt FROM {src}), {prefix}1 AS (SELECT *, coalesce(lag(held) {w}, 0) AS was FROM {prefix}0),
{prefix}r AS (SELECT *, (CASE WHEN held = 1 AND nxt IS NOT NULL THEN nxt / open ELSE 1 END) * (CASE WHEN held = 1 AND was = 0 THEN 1 / 1.001::DOUBLE ELSE 1 END)
 * (CASE WHEN held = 0 AND was = 1 THEN 0.999::DOUBLE ELSE 1 END) * (CASE WHEN nxt IS NULL AND held = 1 THEN 0.999::DOUBLE ELSE 1 END) - 1 AS r FROM {prefix}1)"""


def fsma(n: int, keys: str) -> str:
    o = f"OVER (PARTITION BY {keys} ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(close) {o} = {n} THEN avg(close) {o} END"


@add("V1_walk_forward_cold", f"WITH {DAILY}, {FOLDS}, fb AS (SELECT fold, symbol, ts, open, close FROM bars JOIN folds ON ts >= start AND ts < \"end\"), s AS (SELECT *, coalesce(({fsma(5, 'fold, symbol')}) > ({fsma(20, 'fold, symbol')}), false)::INT AS pos FROM fb), {engine_sql('s', 'fold, symbol')} SELECT fold, symbol, {sql_rounded({'total': 'exp(sum(ln(1 + r))) - 1'})} FROM zr GROUP BY 1, 2")
def v1(spark, sf_dir):
    """Each window on its own: indicators start anew in it."""
    w = Window.partitionBy("fold", "symbol").orderBy("ts")
    held = J.in_windows(daily_bars(spark, sf_dir), folds(spark), "ts", "start", "end")
    run = G.vector_backtest(held.withColumn("pos", C.compare(I.sma(col.close, 5, w), ">", I.sma(col.close, 20, w)).cast("int")), BPS, keys=("fold", "symbol"))
    return V.run_return(run, ["fold", "symbol"]).select("fold", "symbol", *rounded({"total": F.col("total")}))


@add("F11_run_slices", f"WITH {SIG}, {engine_sql('sig', 'symbol')}, {FOLDS} SELECT fold, symbol, {sql_rounded({'total': 'exp(sum(ln(1 + r))) - 1'})} FROM zr JOIN folds ON ts >= start AND ts < \"end\" GROUP BY 1, 2")
def f11(spark, sf_dir):
    """One run cut into windows."""
    cut = J.in_windows(vector_run(spark, sf_dir), folds(spark), "ts", "start", "end")
    return V.run_return(cut, ["fold", "symbol"]).select("fold", "symbol", *rounded({"total": F.col("total")}))


@add("F9_fold_masks", f"WITH {DAILY}, f AS (SELECT i AS fold, TIMESTAMP '1996-01-01' + INTERVAL (i * 30) DAY AS t0 FROM range(12) r(i)) SELECT fold, symbol, count(*) FILTER (ts >= t0 AND ts < t0 + INTERVAL 364 DAY) AS train, count(*) FILTER (ts >= t0 + INTERVAL 365 DAY AND ts < t0 + INTERVAL 395 DAY) AS val, count(*) FILTER (ts >= t0 + INTERVAL 395 DAY AND ts < t0 + INTERVAL 425 DAY) AS test FROM bars, f GROUP BY 1, 2")
def f9(spark, sf_dir):
    f = V.folds(spark, "1996-01-01", 365, 30, 30, 30, 12)
    held = J.in_windows(daily_bars(spark, sf_dir).select("symbol", "ts"), f, "ts", "train_start", "test_end")
    part = lambda a, b: F.count_if((col.ts >= F.col(a)) & (col.ts < F.col(b)))
    return held.groupBy("fold", "symbol").agg(part("train_start", "train_end").alias("train"), part("val_start", "val_end").alias("val"), part("test_start", "test_end").alias("test"))


@add("V8_purged_folds", f"""WITH {DAILY}, s AS (SELECT symbol, min(ts) AS a, max(ts) + INTERVAL 1 DAY AS b FROM bars GROUP BY 1), f AS (SELECT symbol, a, b, unnest(range(greatest(0, (date_diff('day', a, b) - 425) // 30 + 1))) AS fold FROM s)
SELECT symbol, fold, a + INTERVAL (fold * 30) DAY AS train_start, a + INTERVAL (fold * 30 + 364) DAY AS train_end, a + INTERVAL (fold * 30 + 365) DAY AS val_start, a + INTERVAL (fold * 30 + 395) DAY AS test_start, a + INTERVAL (fold * 30 + 425) DAY AS test_end FROM f""")
def v8(spark, sf_dir):
    """As many folds of each series as its bars have room for, the day before validation purged."""
    return V.series_folds(daily_bars(spark, sf_dir), 365, 30, 30, 30).drop("val_end")


@add("V10_stitched_oos", f"WITH {DAILY}, f AS (SELECT i AS fold, TIMESTAMP '1997-01-01' + INTERVAL (i * 30) DAY AS t0 FROM range(12) r(i)) SELECT symbol, ts, min(fold) AS fold FROM bars JOIN f ON ts >= t0 AND ts < t0 + INTERVAL 45 DAY GROUP BY 1, 2")
def v10(spark, sf_dir):
    f = V.folds(spark, "1997-01-01", 0, 0, 45, 30, 12)
    return J.in_windows(daily_bars(spark, sf_dir).select("symbol", "ts"), f, "ts", "test_start", "test_end").groupBy("symbol", "ts").agg(F.min("fold").alias("fold"))


@add("V2_sweep_axes", """WITH d AS (SELECT p_partkey, p_size * 12 AS a, p_size % 7 + 1 AS b, (p_partkey % 30 / 100.0 + 0.01)::DOUBLE AS s FROM part WHERE p_partkey % 17 <> 0),
x AS (SELECT p_partkey, 'indicator_period' AS axis, a::DOUBLE AS base, CASE WHEN a = b THEN 4 ELSE 2 END AS places FROM d UNION ALL SELECT p_partkey, 'indicator_period', b::DOUBLE, 2 FROM d WHERE a <> b
 UNION ALL SELECT p_partkey, 'stop_loss_pct', round(s, 6), 1 FROM d WHERE p_partkey % 3 <> 0),
y AS (SELECT *, CASE axis WHEN 'stop_loss_pct' THEN [greatest(0.02, base * 0.5), greatest(0.02, base * 0.75), base, least(0.2, base * 1.25), least(0.2, base * 1.75)]
 ELSE [greatest(5.0, round_even(base * 0.5, 0)), greatest(5.0, round_even(base * 0.75, 0)), base, round_even(base * 1.25, 0), round_even(base * 1.75, 0)] END::DOUBLE[] AS pts FROM x)
SELECT DISTINCT p_partkey, axis, base, places::BIGINT AS places, round(unnest(pts), 6) AS point FROM y""")
def v2(spark, sf_dir):
    """What a sweep varies in documents that are rows, and the neighbourhood each value is tried in."""
    from quernstone.plans.spec import sweep_axes
    from quernstone.queries.simulators import documents

    axes = sweep_axes(documents(spark, sf_dir).where("p_partkey % 17 <> 0"), "p_partkey", "document")
    return axes.select("p_partkey", "axis", "base", "places", F.explode("points").alias("point"))


GRID = "grid AS (SELECT f.i AS fast, s.i AS slow FROM (VALUES (5), (10)) f(i), (VALUES (20), (30), (40)) s(i))"
MA = {n: f"m{n}" for n in (5, 10, 20, 30, 40)}


@add("V3_grid_execution", f"WITH {DAILY}, {GRID}, ma AS (SELECT symbol, ts, open, {', '.join(f'{sma(chr(99) + chr(108) + chr(111) + chr(115) + chr(101), n)} AS m{n}' for n in MA)} FROM bars), s AS (SELECT fast, slow, symbol, ts, open, coalesce(CASE fast WHEN 5 THEN m5 ELSE m10 END > CASE slow WHEN 20 THEN m20 WHEN 30 THEN m30 ELSE m40 END, false)::INT AS pos FROM ma, grid), {engine_sql('s', 'fast, slow, symbol')} SELECT fast, slow, symbol, {sql_rounded({'total': 'exp(sum(ln(1 + r))) - 1'})} FROM zr GROUP BY 1, 2, 3")
def v3(spark, sf_dir):
    """Every average once, then all cells side by side."""
    ma = daily_bars(spark, sf_dir).select("symbol", "ts", "open", *[I.sma(col.close, n).alias(m) for n, m in MA.items()])
    grid = spark.createDataFrame([(f, s) for f in (5, 10) for s in (20, 30, 40)], "fast int, slow int")
    fast = F.when(F.col("fast") == 5, F.col("m5")).otherwise(F.col("m10"))
    slow = F.when(F.col("slow") == 20, F.col("m20")).when(F.col("slow") == 30, F.col("m30")).otherwise(F.col("m40"))
    run = V.backtest_cells(ma, grid, ["fast", "slow"], C.compare(fast, ">", slow).cast("int"), BPS)
    return V.run_return(run, ["fast", "slow", "symbol"]).select("fast", "slow", "symbol", *rounded({"total": F.col("total")}))


DOCUMENT_SWEEP = f"""WITH {HOURLY}, d AS (SELECT p_partkey, p_size % 10 + 5 AS a, p_size % 10 + 10 + 5 * (p_partkey % 4) AS b FROM part),
pt AS (SELECT p_partkey, axis, base, [greatest(5.0, round_even(base * 0.5, 0)), greatest(5.0, round_even(base * 0.75, 0)), base, round_even(base * 1.25, 0), round_even(base * 1.75, 0)]::DOUBLE[] AS p FROM (SELECT p_partkey, 'a' AS axis, a::DOUBLE AS base FROM d UNION ALL SELECT p_partkey, 'b', b::DOUBLE FROM d)),
st AS (SELECT p_partkey, axis, base, unnest(list_sort(list_distinct(p))) AS v FROM pt), sk AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, axis ORDER BY v) AS k FROM st),
sa AS (SELECT s.p_partkey, s.axis, s.v::INT AS v, abs(s.k - o.k) AS away FROM sk s JOIN sk o ON o.p_partkey = s.p_partkey AND o.axis = s.axis AND o.v = o.base),
cell AS (SELECT x.p_partkey, x.v AS fast, y.v AS slow, x.away + y.away AS away FROM sa x JOIN sa y ON y.p_partkey = x.p_partkey AND y.axis = 'b' WHERE x.axis = 'a' AND x.v <> y.v),
pairs AS (SELECT DISTINCT fast, slow FROM cell), per AS (SELECT fast AS n FROM pairs UNION SELECT slow FROM pairs),
px AS (SELECT symbol, ts, open, row_number() {W} - 1 AS i, sum(round(close * 1000000)::BIGINT) {RUN} AS upto FROM bars),
sm AS (SELECT a.symbol, a.i, n, a.upto - coalesce(b.upto, 0) AS total FROM px a JOIN per ON a.i - n + 1 >= 0 LEFT JOIN px b ON b.symbol = a.symbol AND b.i = a.i - n),
g AS (SELECT fast, slow, px.symbol, ts, open, sign(f.total * slow - s.total * fast) AS side FROM pairs JOIN px ON true LEFT JOIN sm f ON f.symbol = px.symbol AND f.i = px.i AND f.n = fast LEFT JOIN sm s ON s.symbol = px.symbol AND s.i = px.i AND s.n = slow),
t AS (SELECT *, lag(side) OVER (PARTITION BY fast, slow, symbol ORDER BY ts) AS side_before FROM g),
pp AS (SELECT *, coalesce(last_value(CASE WHEN side_before <= 0 AND side > 0 THEN 1 WHEN side_before >= 0 AND side < 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY fast, slow, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS pos FROM t),
{engine_sql('pp', 'fast, slow, symbol')}, runs AS (SELECT fast, slow, symbol, exp(sum(ln(1 + r))) - 1 AS total FROM zr GROUP BY 1, 2, 3),
ru AS (SELECT p_partkey, symbol, count(*) AS cells, max(total) AS best, min(total) AS worst, max(total) FILTER (away = 0) AS own, avg(total) FILTER (away = 1) AS nb FROM cell JOIN runs USING (fast, slow) GROUP BY 1, 2)
SELECT p_partkey, symbol, cells, {sql_rounded({'best': 'best', 'worst': 'worst', 'own': 'own', 'neighbour_avg': 'nb', 'peakiness': 'greatest(0, least(1, (own - nb) / greatest(abs(own), 0.01)))'}, 5)} FROM ru"""


def crossing_documents(spark, sf_dir):
    """A document for each part: in where one average of closes crosses above another, out where it crosses below."""
    a = F.col("p_size") % 10 + 5
    average = lambda n: F.concat(F.lit('{"kind":"indicator","name":"sma","params":{"period":'), n.cast("string"), F.lit("}}"))
    cross = lambda side: F.concat(F.lit('{"type":"crossover","series":'), average(a), F.lit(',"threshold":'), average(a + 5 + 5 * (F.col("p_partkey") % 4)), F.lit(f',"direction":"{side}"}}'))
    text = F.concat(F.lit('{"schema_version":"1.0","primary_timeframe":"1h","direction":"long","entry":{"condition":'), cross("above"), F.lit('},"exit":{"exits":[{"type":"condition","condition":'), cross("below"), F.lit("}]}}"))
    return scan(spark, sf_dir, "part", ["p_partkey", "p_size"]).select("p_partkey", text.alias("document"))


@add("V3_document_sweep", DOCUMENT_SWEEP)
def v3_documents(spark, sf_dir):
    """The grids that the axes of all documents span, in one job, and what each document's own cell is worth among its neighbours."""
    told = sweeps.document_sweep(crossing_documents(spark, sf_dir), "p_partkey", "document", event_bars(spark, sf_dir), BPS)
    return told.select("p_partkey", "symbol", "cells", *rounded({c: F.col(c) for c in ("best", "worst", "own", "neighbour_avg", "peakiness")}, 5))


#: Simulations: of the bootstrap by days, of the permutation nulls, and of the nulls that draw entries and shifts.
RESAMPLES, PERMUTATIONS, DRAWS = 1000, 100, 1000


def rank_sql(value: str, by: str = "") -> str:
    """null_rank and p_value of draws beside their ``actual`` value."""
    below = f"avg((round({value}, 9) < round(actual, 9))::INT) OVER ({by})"
    return f"{below} AS null_rank, 1 - {below} AS p_value"


def perm_sql(joint: bool) -> str:
    key = "sim || '-' || strftime(ts, '%Y-%m-%d %H:%M:%S')" if joint else "sim || '-' || symbol || '-' || strftime(ts, '%Y-%m-%d %H:%M:%S')"
    return f"""pr AS (SELECT symbol, ts, close, ln(close) - ln(lag(close) {W}) AS r, row_number() {W} AS k, first_value(close) {W} AS c0 FROM bars), sims AS (SELECT i AS sim FROM range({PERMUTATIONS}) t(i)),
sh AS (SELECT sim, symbol, r, row_number() OVER (PARTITION BY sim, symbol ORDER BY ('0x' || substr(md5({key}), 1, 8))::BIGINT, ts) + 1 AS k FROM pr, sims WHERE r IS NOT NULL),
pth AS (SELECT sim, pr.symbol, pr.ts, c0 * exp(sum(coalesce(sh.r, 0)) OVER (PARTITION BY sim, pr.symbol ORDER BY pr.ts ROWS UNBOUNDED PRECEDING)) AS close FROM pr JOIN sims ON true LEFT JOIN sh USING (sim, symbol, k)),
pp AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY sim, symbol ORDER BY ts), close) AS open FROM pth)"""


@add("V4_permutation_null", f"WITH {DAILY}, {perm_sql(False)}, s AS (SELECT *, coalesce(({fsma(10, 'sim, symbol')}) > ({fsma(30, 'sim, symbol')}), false)::INT AS pos FROM pp), {engine_sql('s', 'sim, symbol')}, nul AS (SELECT sim, symbol, sum(ln(1 + r)) AS v FROM zr GROUP BY 1, 2) SELECT sim, symbol, {sql_rounded({'log_total': 'v', 'actual': 'actual'}, 4)}, {rank_sql('v', 'PARTITION BY symbol')} FROM nul JOIN act USING (symbol)".replace(f"WITH {DAILY}", f"WITH {VEC}, act AS (SELECT symbol, sum(ln(1 + r)) AS actual FROM run GROUP BY 1)", 1))
def v4(spark, sf_dir):
    """Would the rule have earned as much on the same returns in another order?"""
    paths = V.permuted_closes(daily_bars(spark, sf_dir), V.simulations(spark, PERMUTATIONS))
    w = Window.partitionBy("sim", "symbol").orderBy("ts")
    run = G.vector_backtest(paths.withColumn("pos", C.compare(I.sma(col.close, 10, w), ">", I.sma(col.close, 30, w)).cast("int")), BPS, keys=("sim", "symbol"))
    actual = vector_run(spark, sf_dir).groupBy("symbol").agg(F.sum(F.ln(F.col("r") + 1)).alias("actual"))
    drawn = run.groupBy("sim", "symbol").agg(F.sum(F.ln(F.col("r") + 1)).alias("log_total")).join(actual, "symbol")
    return V.with_rank(drawn, ["symbol"], "log_total").select("sim", "symbol", *rounded({"log_total": F.col("log_total"), "actual": F.col("actual")}, 4), "null_rank", "p_value")


@add("V5_joint_permutation", f"""WITH {DAILY}, {perm_sql(True)}, nul AS (SELECT sim, symbol, arg_max(ln(close), ts) AS last, avg(ln(close)) AS mid FROM pp GROUP BY 1, 2), act AS (SELECT symbol, avg(ln(close)) AS actual FROM bars GROUP BY 1)
SELECT sim, symbol, {sql_rounded({'last': 'last', 'mid': 'mid', 'actual': 'actual'}, 4)}, {rank_sql('mid', 'PARTITION BY symbol')} FROM nul JOIN act USING (symbol)""")
def v5(spark, sf_dir):
    """One order for the returns of all symbols, which keeps what they have in common. The end of a path is that of the real one; its mean level is not."""
    bars = daily_bars(spark, sf_dir)
    paths = V.permuted_closes(bars, V.simulations(spark, PERMUTATIONS), joint=True)
    actual = bars.groupBy("symbol").agg(F.avg(F.ln("close")).alias("actual"))
    drawn = paths.groupBy("sim", "symbol").agg(F.max_by(F.ln("close"), "ts").alias("last"), F.avg(F.ln("close")).alias("mid")).join(actual, "symbol")
    return V.with_rank(drawn, ["symbol"], "mid").select("sim", "symbol", *rounded({c: F.col(c) for c in ("last", "mid", "actual")}, 4), "null_rank", "p_value")


MOMENTS = f"{SIG}, {engine_sql('sig', 'symbol')}, c AS (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS m FROM zr), mo AS (SELECT symbol, any_value(m) AS m, count(*) AS n, stddev_samp(r) AS sd, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS g, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS k FROM c GROUP BY 1)"


def deflated_sql(sr: str, trials: int, n: str, spread: float) -> str:
    """Deflated Sharpe of the moments above; the best of that many trials without skill is a number of its own."""
    from statistics import NormalDist

    best = (1 - V.EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / trials) + V.EULER_GAMMA * NormalDist().inv_cdf(1 - math.exp(-1) / trials)
    z = f"(({sr} - {spread * best!r}::DOUBLE) * sqrt({n} - 1) / sqrt(greatest(1 - g * {sr} + (k - 1) / 4 * {sr} * {sr}, 1e-9)))"
    return S.norm_cdf_sql(z)


@add("V6_deflated_sharpe", f"WITH {MOMENTS} SELECT symbol, {sql_rounded({'dsr': deflated_sql('(m / sd)', 20, 'n', 0.02)})} FROM mo")
def v6(spark, sf_dir):
    run = vector_run(spark, sf_dir).groupBy("symbol").agg((F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sr"), F.count("*").alias("n"), F.skewness("r").alias("g"), (F.kurtosis("r") + 3).alias("k"))
    return run.select("symbol", *rounded({"dsr": V.deflated_sharpe(F.col("sr"), F.lit(20), F.col("n"), F.col("g"), F.col("k"), spread=0.02)}))


SCORES = "x AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 40.0 - 0.3 END AS d, (p_partkey % 100) / 100.0 AS k, (p_partkey % 37) / 37.0 AS p, (p_size % 11) / 10.0 AS q, p_size % 2 = 0 AS st FROM part)"


def pw(x: str, pts: list[tuple[float, float]]) -> str:
    out = f"CASE WHEN {x} <= {pts[0][0]} THEN {pts[0][1]}"
    for (a, ya), (b, yb) in zip(pts, pts[1:]):
        out += f" WHEN {x} <= {b} THEN {ya} + ({x} - {a}) / ({b} - {a}) * ({yb} - {ya})"
    return f"{out} ELSE {pts[-1][1]} END"


COMP = f"y AS (SELECT p_partkey, st, CASE WHEN d IS NULL THEN 75 WHEN d > 0.8 THEN 0 ELSE {pw('d', [(-0.5, 100.0), (0.5, 60.0), (0.8, 30.0)])} END::DOUBLE AS wf, ({pw('k', [(0.0, 0.0), (0.3, 20.0), (0.7, 60.0), (1.0, 100.0)])})::DOUBLE AS sw, ({pw('p', [(0.0, 0.0), (0.05, 20.0), (0.2, 50.0), (1.0, 100.0)])})::DOUBLE AS mc, ({pw('q', [(0.0, 100.0), (0.5, 60.0), (0.95, 20.0), (1.0, 0.0)])})::DOUBLE AS ds FROM x), zc AS (SELECT *, CASE WHEN st THEN 0.5 * wf + 0.25 * sw + 0.1 * mc + 0.15 * ds ELSE 0.35 * wf + 0.25 * sw + 0.25 * mc + 0.15 * ds END AS score FROM y)"


@add("V7_composite", f"WITH {SCORES}, {COMP} SELECT p_partkey, {sql_rounded({'score': 'score'}, 4)}, CASE WHEN score < 30 THEN 'likely_robust' WHEN score < 60 THEN 'mixed_signals' ELSE 'likely_overfit' END AS verdict FROM zc")
def v7(spark, sf_dir):
    p = scan(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    got = V.composite(F.when(size % 7 != 0, size / 40.0 - 0.3), (key % 100) / 100.0, (key % 37) / 37.0, (size % 11) / 10.0, size % 2 == 0)
    return p.select("p_partkey", *rounded({"score": got["score"]}, 4), got["verdict"].alias("verdict"))


@add("SP22_top_contributions", f"WITH {SCORES}, {COMP}, u AS (SELECT p_partkey, unnest([struct_pack(v := wf, n := 'walk_forward'), struct_pack(v := sw, n := 'sweep'), struct_pack(v := mc, n := 'monte_carlo'), struct_pack(v := ds, n := 'deflated')]) AS z FROM y) SELECT p_partkey, arg_max(z.n, (round(z.v, 6), z.n)) AS top FROM u GROUP BY 1")
def sp22(spark, sf_dir):
    p = scan(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    got = V.composite(F.when(size % 7 != 0, size / 40.0 - 0.3), (key % 100) / 100.0, (key % 37) / 37.0, (size % 11) / 10.0, size % 2 == 0)
    parts = F.array(*[F.struct(F.round(got[n], 6).alias("v"), F.lit(n).alias("n")) for n in ("walk_forward", "sweep", "monte_carlo", "deflated")])
    return p.select("p_partkey", F.array_max(parts)["n"].alias("top"))


def hex_draw(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


@add("V11_block_bootstrap", f"WITH {TRADES}, dd AS (SELECT exit_ts::DATE AS day, sum(ln(1 + ret)) AS r FROM trades GROUP BY 1), dn AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS n FROM dd), sims AS (SELECT i AS sim FROM range({RESAMPLES}) t(i)), dr AS (SELECT sim, {hex_draw('sim || chr(45) || k')} % n AS k FROM dn, sims), nul AS (SELECT sim, sum(r) AS v FROM dr JOIN dn USING (k) GROUP BY 1) SELECT sim, {sql_rounded({'log_total': 'v', 'actual': '(SELECT sum(r) FROM dd)', **{f'p{q:02}': f'(SELECT quantile_cont(v, {q / 100}) FROM nul)' for q in (5, 50, 95)}}, 5)} FROM nul")
def v11(spark, sf_dir):
    """The interval of what the trades would have come to on other days like theirs."""
    trades = vector_trades(spark, sf_dir)
    drawn = V.block_bootstrap(trades, V.simulations(spark, RESAMPLES)).select("sim", F.ln("total").alias("log_total"))
    actual = trades.agg(F.sum(F.ln(F.col("ret") + 1)).alias("actual"))
    interval = exact_quantiles(drawn, [], F.col("log_total"), {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return drawn.join(actual).join(interval).select("sim", *rounded({c: F.col(c) for c in ("log_total", "actual", "p05", "p50", "p95")}, 5))


@add("V12_random_entries", f"WITH {TRADES}, n AS (SELECT symbol, count(*) AS n FROM trades GROUP BY 1), sims AS (SELECT i AS sim FROM range({DRAWS}) t(i)), e AS (SELECT sim, symbol, ts, open, lead(open, 10) {W} AS exit_open, {hex_draw('sim || chr(45) || symbol || chr(45) || strftime(ts, chr(37) || chr(89) || chr(45) || chr(37) || chr(109) || chr(45) || chr(37) || chr(100))')} AS d FROM bars, sims".replace(f"lead(open, 10) {W}", "lead(open, 10) OVER (PARTITION BY sim, symbol ORDER BY ts)") + f"), q AS (SELECT *, row_number() OVER (PARTITION BY sim, symbol ORDER BY d, ts) AS k FROM e WHERE exit_open IS NOT NULL), nul AS (SELECT sim, symbol, count(*) AS trades, avg(exit_open / open - 1) AS v FROM q JOIN n USING (symbol) WHERE k <= n GROUP BY 1, 2), act AS (SELECT symbol, avg(ret) AS actual FROM trades GROUP BY 1) SELECT sim, symbol, trades, {sql_rounded({'mean': 'v', 'actual': 'actual'}, 5)}, {rank_sql('v', 'PARTITION BY symbol')} FROM nul JOIN act USING (symbol)")
def v12(spark, sf_dir):
    """As many entries as the strategy had, at random bars, held ten bars: how many of them did better than its own trades?"""
    n = vector_trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("actual"))
    e = daily_bars(spark, sf_dir).select("symbol", "ts", "open", F.lead("open", 10).over(I.series()).alias("exit_open")).where("exit_open IS NOT NULL")
    e = written(e.join(n, "symbol").join(e.groupBy("symbol").agg(F.count("*").alias("bars")), "symbol"), "entries").join(V.simulations(spark, DRAWS))
    chance = V.draw(F.col("sim"), F.col("symbol"), F.date_format("ts", "yyyy-MM-dd"))
    drawn = V.least_draws(e, ["sim", "symbol"], chance, "ts", "n", "bars")
    each = drawn.groupBy("sim", "symbol").agg(F.count("*").alias("trades"), F.avg(F.col("exit_open") / F.col("open") - 1).alias("mean"), F.first("actual").alias("actual"))
    return V.with_rank(each, ["symbol"], "mean").select("sim", "symbol", "trades", *rounded({"mean": F.col("mean"), "actual": F.col("actual")}, 5), "null_rank", "p_value")


def auc_of(counts: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, auc) of (keys, s, n, n1): rows of each score, and those among them that came true; ranks of ties are averaged.

    Scores are summed before they are ranked, and ranked range by range of ``width``.
    """
    x = chunked.running_sum(counts.withColumn("_range", F.floor(F.col("s") / width)), keys, "_range", ["s"], F.col("n"), "_upto")
    rank = F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2
    t = x.groupBy(*keys).agg(F.sum(rank * F.col("n1")).alias("sr"), F.sum("n1").cast("double").alias("n1"), F.sum(F.col("n") - F.col("n1")).cast("double").alias("n0"))
    n1, n0 = F.col("n1"), F.col("n0")
    return t.withColumn("auc", (F.col("sr") - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0)))


@add("V13_auc", f"WITH x AS (SELECT l_returnflag AS g, l_extendedprice AS s, (l_discount > 0.05)::INT AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2 AS rk FROM x), t AS (SELECT g, sum(rk) FILTER (y = 1) AS sr, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM r GROUP BY 1) SELECT g, {sql_rounded({'auc': '(sr - n1 * (n1 + 1) / 2) / (n1 * n0)'})} FROM t")
def v13(spark, sf_dir):
    """Area under the curve from average ranks."""
    x = scan(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("s"), (F.col("l_discount") > 0.05).cast("int").alias("y"))
    counts = x.groupBy("g", "s").agg(F.count("*").alias("n"), F.sum("y").alias("n1"))
    return auc_of(counts, ["g"], 100.0).select("g", *rounded({"auc": F.col("auc")}))


#: Bars of a block of labels that stays together.
LABEL_BLOCK = 168
LABELS = f"lb AS (SELECT symbol, ts, ln(close) - ln(lag(close, 5) {W}) AS s, (ln(lead(close) {W}) > ln(close))::INT AS y FROM bars), ok AS (SELECT *, row_number() {W} - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM lb WHERE s IS NOT NULL AND y IS NOT NULL)"


@add("V13_label_null", f"""WITH {DAILY}, {LABELS}, sims AS (SELECT i AS sim FROM range(20) t(i)), blocks AS (SELECT DISTINCT symbol, k // {LABEL_BLOCK} AS block FROM ok),
ord AS (SELECT sim, symbol, block, ('0x' || substr(md5(sim || '-' || symbol || '-' || block), 1, 8))::BIGINT AS d FROM blocks, sims),
moved AS (SELECT sim, o.symbol, o.y, row_number() OVER (PARTITION BY sim, o.symbol ORDER BY d, block, k) - 1 AS k FROM ok o JOIN ord ON ord.symbol = o.symbol AND block = k // {LABEL_BLOCK}),
j AS (SELECT m.sim, o.symbol, o.s, m.y FROM ok o JOIN moved m USING (symbol, k) UNION ALL SELECT -1, symbol, s, y FROM ok),
r AS (SELECT *, rank() OVER (PARTITION BY sim, symbol ORDER BY s) + (count(*) OVER (PARTITION BY sim, symbol, s) - 1) / 2 AS rk FROM j),
t AS (SELECT sim, symbol, sum(rk) FILTER (y = 1) AS sr, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM r GROUP BY 1, 2),
a AS (SELECT sim, symbol, (sr - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM t)
SELECT a.symbol, {sql_rounded({'auc': 'any_value(o.auc)', 'null_mean': 'avg(a.auc)'})}, (1 + count(*) FILTER (round(a.auc, 9) >= round(o.auc, 9)))::DOUBLE / (1 + count(*)) AS p_value FROM a JOIN a o ON o.symbol = a.symbol AND o.sim = -1 WHERE a.sim >= 0 GROUP BY 1""")
def v13_null(spark, sf_dir):
    """Is a score's area under the curve more than chance? Labels are moved in whole weeks of bars, which keeps their runs."""
    w = I.series()
    x = daily_bars(spark, sf_dir).select("symbol", "ts", I.log_return(col.close, 5).alias("s"), (F.ln(F.lead("close").over(w)) > F.ln("close")).cast("int").alias("y"))
    x = x.where("s IS NOT NULL AND y IS NOT NULL").withColumn("k", F.row_number().over(w) - 1)
    moved = V.block_permuted(x, V.simulations(spark, 20), LABEL_BLOCK)
    both = x.select("symbol", "k", "s").join(moved, ["symbol", "k"]).unionByName(x.select("symbol", "k", "s", F.lit(-1).cast("long").alias("sim"), "y"))
    each = auc_of(both.groupBy("sim", "symbol", "s").agg(F.count("*").alias("n"), F.sum("y").alias("n1")), ["sim", "symbol"], 0.5)
    real = each.where("sim = -1").select("symbol", F.col("auc").alias("real"))
    drawn = each.where("sim >= 0").join(real, "symbol")
    above = F.count_if(F.round("auc", 9) >= F.round("real", 9))
    return drawn.groupBy("symbol").agg(*rounded({"auc": F.first("real"), "null_mean": F.avg("auc")}), ((1 + above) / (1 + F.count("*"))).alias("p_value"))


@add("V14_circular_shift_null", f"""WITH {WEIGHTS}, k AS (SELECT *, row_number() {W} - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM wt), sims AS (SELECT i AS sim FROM range({DRAWS}) t(i)), m AS (SELECT sim, symbol, (k + {hex_draw('sim || chr(45) || symbol')} % n) % n AS k, w FROM k, sims), j AS (SELECT m.sim, k.symbol, k.ts, k.open, m.w FROM k JOIN m USING (symbol, k)), a AS (SELECT *, coalesce(lag(w) OVER q, 0) AS a, coalesce(lead(open) OVER q / open - 1, 0) AS mv FROM j WINDOW q AS (PARTITION BY sim, symbol ORDER BY ts)), nul AS (SELECT sim, sum(a * mv) AS v FROM a GROUP BY 1),
act AS (SELECT sum(a * mv) AS actual FROM (SELECT coalesce(lag(w) {W}, 0) AS a, coalesce(lead(open) {W} / open - 1, 0) AS mv FROM wt)) SELECT sim, {sql_rounded({'gross': 'v', 'actual': 'actual'}, 4)}, {rank_sql('v')} FROM nul, act""")
def v14(spark, sf_dir):
    """Were the weights well timed? Against the same weights moved round by random numbers of bars."""
    drawn = V.circular_shift(weights(spark, sf_dir).select("symbol", "ts", "open", "w"), V.simulations(spark, DRAWS))
    return V.with_rank(drawn, [], "gross").select("sim", *rounded({"gross": F.col("gross"), "actual": F.col("actual")}, 4), "null_rank", "p_value")


GM = {"expectancy": "p_retailprice - 1000", "profit_factor": "p_size / 20.0", "sharpe": "(p_partkey % 20) / 10.0", "dsr": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE 0.9 + (p_partkey % 11) / 100.0 END", "fold_positive": "(p_partkey % 10) / 9.0", "null_rank": "0.9 + (p_partkey % 9) / 80.0", "cost_edge": "(p_partkey % 7) / 7.0", "plateau": "0.6 + (p_partkey % 5) / 10.0", "stressed": "p_retailprice - 950", "per_day": "(p_partkey % 60) / 10.0"}


@add("V15_gates", f"""WITH m AS (SELECT p_partkey, p_size, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in GM.items())} FROM part),
f AS (SELECT *, list_filter([CASE WHEN NOT (expectancy > 0 AND profit_factor >= 1.15) THEN 'G1' END, CASE WHEN sharpe < 0.8 THEN 'G2' END, CASE WHEN dsr < 0.95 THEN 'G3' END, CASE WHEN fold_positive < 0.6 THEN 'G4' END,
 CASE WHEN null_rank < 0.95 THEN 'G5' END, CASE WHEN cost_edge > 0.5 THEN 'G6' END, CASE WHEN plateau < 0.7 THEN 'G7' END, CASE WHEN stressed <= 0 THEN 'G8' END, CASE WHEN NOT (per_day BETWEEN 0.2 AND 5) THEN 'G9' END], lambda g: g IS NOT NULL) AS failed FROM m)
SELECT p_partkey, failed, CASE WHEN p_size % 10 = 0 THEN 'REJECTED' WHEN len(list_filter(failed, lambda g: g <> 'G9')) > 0 THEN 'REJECTED' WHEN p_size % 4 = 1 THEN 'CONDITIONAL' WHEN list_contains(failed, 'G9') AND per_day < 0.2 THEN 'PASS_LOW_FREQUENCY' WHEN len(failed) > 0 THEN 'REJECTED' ELSE 'PASS' END AS verdict FROM f""")
def v15(spark, sf_dir):
    m = scan(spark, sf_dir, "part").select("p_partkey", "p_size", *[F.expr(f"cast({v} as double)").alias(k) for k, v in GM.items()])
    failed, verdict = V.gate_verdict(F.col("p_size") % 10, F.col("p_size") % 4 != 1)
    return m.select("p_partkey", failed.alias("failed"), verdict.alias("verdict"))


@add("V16_plateau", f"WITH {CELLS}, n AS (SELECT a.x, a.y, a.v, median(b.v) AS nb FROM cells a JOIN cells b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL) SELECT {sql_rounded({'plateau': 'arg_max(nb, v) / max(v)'}, 4)} FROM n")
def v16(spark, sf_dir):
    grid = cells(spark, sf_dir)
    steps = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    around = grid.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("v").alias("av"), F.explode(steps).alias("s")).select("ax", "ay", "av", "s.x", "s.y")
    nb = around.join(grid, ["x", "y"]).groupBy("ax", "ay", "av").agg(F.median("v").alias("nb"))
    return nb.agg((F.max_by("nb", "av") / F.max("av")).alias("p")).select(*rounded({"plateau": F.col("p")}, 4))


OLS = f"o AS (SELECT symbol, ts, ln(close) - ln(lag(close) {W}) AS x, ln(lead(close) {W}) - ln(close) AS y, percent_rank() {W} < 0.7 AS train FROM bars)"


@add("V17_predictability", f"WITH {DAILY}, {OLS}, b AS (SELECT symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o WHERE train GROUP BY 1), t AS (SELECT symbol, y, a + b * x AS p FROM o JOIN b USING (symbol) WHERE NOT train AND x IS NOT NULL AND y IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY y) AS ry, rank() OVER (PARTITION BY symbol ORDER BY p) AS rp FROM t) SELECT symbol, {sql_rounded({'r2': '1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))', 'ic': 'corr(ry, rp)'}, 4)} FROM k GROUP BY 1")
def v17(spark, sf_dir):
    """Next return on the last one: fitted on the first 70%, judged on the rest."""
    x = daily_bars(spark, sf_dir).select("symbol", "ts", I.log_return(col.close).alias("x"), I.forward_label(col.close, 1).alias("y"), (F.percent_rank().over(I.series()) < 0.7).alias("train"))
    fit = x.where("train").groupBy("symbol").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    t = x.where("NOT train AND x IS NOT NULL AND y IS NOT NULL").join(fit, "symbol").withColumn("p", F.col("a") + F.col("b") * F.col("x"))
    t = t.withColumn("ry", F.rank().over(Window.partitionBy("symbol").orderBy("y"))).withColumn("rp", F.rank().over(Window.partitionBy("symbol").orderBy("p")))
    return t.groupBy("symbol").agg(*rounded({"r2": 1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / (F.var_pop("y") * F.count("*")), "ic": F.corr("ry", "rp")}, 4))


@add("V18_drift", "WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS paper, 5.0::DOUBLE AS bt, c_nationkey AS n, c_custkey % 40 / 100.0::DOUBLE AS dd FROM customer) SELECT c_custkey, CASE WHEN n < 5 THEN 'insufficient_data' WHEN dd > 1.5 * 2 * 0.1 THEN 'critical' WHEN abs(paper - bt) / greatest(abs(bt), 1e-9) <= 0.3 * 2 THEN 'healthy' WHEN abs(paper - bt) / greatest(abs(bt), 1e-9) <= 0.6 * 2 THEN 'watch' ELSE 'critical' END AS health FROM x")
def v18(spark, sf_dir):
    x = scan(spark, sf_dir, "customer")
    health = V.drift_health(F.col("c_acctbal") / 1000, F.lit(5.0), F.col("c_nationkey"), 24, F.col("c_custkey") % 40 / 100.0, F.lit(0.1))
    return x.select("c_custkey", health.alias("health"))


FOLD_FEATURES = ["r1", "r5", "z"]


def fold_rows(spark, sf_dir):
    """Three features of each day, the log return over the next, and the move that the average true range implies for it."""
    w = I.series()
    gap = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close").over(w)), F.abs(F.col("low") - F.lag("close").over(w)))
    x = daily_bars(spark, sf_dir).withColumn("range", gap)
    return x.select(
        "symbol", "ts", I.log_return(col.close).alias("r1"), I.log_return(col.close, 5).alias("r5"), I.zscore(col.close, 20).alias("z"),
        I.forward_label(col.close, 1).alias("r"), (I.sma(F.col("range"), 14) / col.close * 1e4).alias("implied"),
    )


def fold_report(spark, sf_dir, fit):
    plan = V.folds(spark, "1996-01-01", 365, 90, 90, 365, 3)
    told = fit(fold_rows(spark, sf_dir), plan, FOLD_FEATURES)
    hit = (F.col("p_up") >= 0.5) == (F.col("y") == 1)
    return told.groupBy("fold", "symbol").agg(F.count("*").alias("n"), *rounded({"accuracy": F.avg(hit.cast("int")), "p_mean": F.avg("p_up"), "val_auc": F.first("val_auc"), "k": F.first("k")}, 4))


@add("V9_fold_model")
def v9(spark, sf_dir):
    """A logistic model of the next bar's direction for each fold, calibrated on its validation span and judged on its test span."""
    return fold_report(spark, sf_dir, V.fit_folds)


@add("V9_boosted_folds")
def v9_boosted(spark, sf_dir):
    """The same folds with 300 boosted trees."""
    return fold_report(spark, sf_dir, V.boost_folds)


@add("F10_dataset_rows", f"WITH {DAILY} SELECT symbol, count(*) AS n FROM (SELECT symbol, {sma('close', 20)} AS m, ln(lead(close, 5) {W}) - ln(close) AS y FROM bars) WHERE m IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def f10(spark, sf_dir):
    x = daily_bars(spark, sf_dir).select("symbol", I.sma(col.close, 20).alias("m"), I.forward_label(col.close, 5).alias("y"))
    return x.dropna().groupBy("symbol").agg(F.count("*").alias("n"))


UP = f"{DAILY}, sig AS (SELECT *, coalesce(1 / (1 + exp(-20 * (ln(close) - ln(lag(close, 5) {W})))) >= 0.5, false)::INT AS pos FROM bars)"


@add("B17_naive_sign", f"WITH {UP}, {engine_sql('sig', 'symbol')} SELECT symbol, {sql_rounded({'log_total': 'sum(ln(1 + r))'}, 4)} FROM zr GROUP BY 1")
def b17_naive(spark, sf_dir):
    """In whenever the chance of a rise is a half or more, whatever it costs: what a gate saves shows against this."""
    chance = 1 / (1 + F.exp(-20 * I.log_return(col.close, 5)))
    run = G.vector_backtest(daily_bars(spark, sf_dir).withColumn("pos", C.sure(chance >= 0.5).cast("int")), BPS)
    return run.groupBy("symbol").agg(*rounded({"log_total": F.sum(F.ln(F.col("r") + 1))}, 4))


PORTFOLIO = PORT[len(WEIGHTS) :]
EQUAL = f"""{DAILY}, mf AS (SELECT date_trunc('month', ts) AS m, min(ts) AS f FROM bars GROUP BY 1), nl AS (SELECT m, count(*) AS n FROM bars JOIN mf ON ts = f GROUP BY 1),
wt AS (SELECT b.symbol, b.ts, b.open, CASE WHEN x.symbol IS NOT NULL THEN 1.0::DOUBLE / n ELSE 0 END AS w FROM bars b JOIN mf ON date_trunc('month', b.ts) = m JOIN nl USING (m) LEFT JOIN bars x ON x.symbol = b.symbol AND x.ts = f)"""


@add("B17_equal_weight", f"WITH {EQUAL}{PORTFOLIO} SELECT ts, {sql_rounded({'r': 'gross - cost'})} FROM port")
def b17_equal(spark, sf_dir):
    """Equal parts of what is listed on a month's first day, held for the month."""
    bars = daily_bars(spark, sf_dir).withColumn("month", F.date_trunc("month", "ts"))
    first = bars.groupBy("month").agg(F.min("ts").alias("first"))  # a row for each month
    listed = bars.select("symbol", "month", "ts").join(first, "month").where(col.ts == F.col("first")).select("symbol", "month")
    share = listed.groupBy("month").agg((F.lit(1.0) / F.count("*")).alias("share"))
    held = bars.join(listed.withColumn("in", F.lit(True)), ["symbol", "month"], "left").join(share, "month")
    return G.portfolio_backtest(held.withColumn("w", F.when(F.col("in"), F.col("share")).otherwise(0.0)), BPS).select("ts", *rounded({"r": F.col("r")}))


MEMBER_SIG = "sigm AS (SELECT s.* REPLACE (CASE WHEN m.member THEN s.pos ELSE 0 END AS pos) FROM sig s ASOF LEFT JOIN members m ON s.symbol = m.symbol AND s.ts >= m.month)"
CELL = f"{SIG}, {MEMBERS}, {MEMBER_SIG}, {WEIGHTS[len(SIG) + 2:].replace('FROM sig)', 'FROM sigm)')}{PORTFOLIO}"


@add("SP6_trend_cell", f"WITH {CELL}, {FOLDS} SELECT fold, count(*) AS days, {sql_rounded({'total': 'sum(gross - cost)', 'cost': 'sum(cost)'}, 5)} FROM port JOIN folds ON ts >= start AND ts < \"end\" GROUP BY 1")
def sp6_cell(spark, sf_dir):
    """A trend cell: the month's universe carried forward, signals of its members, weights, the portfolio's run, cut into windows."""
    bars = signals(spark, sf_dir)
    month = F.date_trunc("month", "ts").cast("timestamp_ntz")
    members = bars.groupBy("symbol", month.alias("month")).agg((F.sum(col.close * F.col("volume")) > 100_000).alias("member"))
    inside = J.asof(bars, members, ["symbol"], "ts", "month", ["member"]).withColumn("pos", F.when(F.col("member"), F.col("pos")).otherwise(0))
    sized = G.target_weights(inside.withColumn("vol", I.stddev(col.close, 20) / col.close), "vol", 0.2, 0.4, 1.0)
    run = J.in_windows(G.portfolio_backtest(sized, BPS), folds(spark), "ts", "start", "end")
    return run.groupBy("fold").agg(F.count("*").alias("days"), *rounded({"total": F.sum("r"), "cost": F.sum("cost")}, 5))


FEATURES = ["spread_bps", "imbalance", "flow", "updates", "vol"]


def micro_matrix(spark, sf_dir):
    """Five features of the book for each hour, and the log return of the mid over the next. A mid of zero has neither a relative spread nor a return."""
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    mid = (F.col("bid") + F.col("ask")) / 2
    b = book(spark, sf_dir).withColumn("mid", mid).withColumn("d", F.ln(mid) - F.ln(F.lag(mid).over(w)))
    flow = (F.col("bq") - F.col("aq")) / F.nullif(F.col("bq") + F.col("aq"), F.lit(0.0))
    hours = b.groupBy("symbol", F.date_trunc("hour", "ts").alias("bar")).agg(
        (F.avg((F.col("ask") - F.col("bid")) / F.nullif(F.col("mid"), F.lit(0.0))) * 1e4).alias("spread_bps"), F.avg(flow).alias("imbalance"), F.sum(F.signum(F.col("bq") - F.col("aq"))).alias("flow"),
        F.count("*").cast("double").alias("updates"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("vol"), F.max_by("mid", F.struct("ts", "event_id")).alias("last"),
    )
    n = Window.partitionBy("symbol").orderBy("bar")
    return hours.withColumn("y", F.ln(F.lead("last").over(n)) - F.ln("last")).dropna().drop("last")


@add("V17_ridge")
def v17_ridge(spark, sf_dir):
    """The next hour's return by ridge regression on the book: fitted on the first 70%, standardised by them, judged on the rest."""
    return V.ridge_report(micro_matrix(spark, sf_dir), FEATURES, "y", "bar").select("symbol", "n_train", "n_test", *rounded({k: F.col(k) for k in ("r2_train", "r2_test", "ic")}, 6))
