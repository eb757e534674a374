"""Is a result real? Walk-forward, sweeps, nulls, deflation, gates and drift, spread over the cluster.

Random draws are ranks or remainders of md5 hashes of (simulation, row), so a null does not
depend on how rows lie on machines, and SQL can repeat it.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import scalars as S
from quernstone.functions.indicators import running
from quernstone.operators import engines as G
from quernstone.operators.quantiles import exact_quantiles
from quernstone.plans import boosting
from quernstone.sources.store import written

EULER_GAMMA = 0.5772156649015329
YEAR_DAYS = 365


def draw(*parts: Column) -> Column:
    """32 pseudo-random bits of some values, as a long."""
    told = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 8), 16, 10).cast("long")


def simulations(spark: SparkSession, n: int) -> DataFrame:
    """Numbers 0..n-1: a plan's own size, to be broadcast."""
    return F.broadcast(spark.range(n).withColumnRenamed("id", "sim"))


def folds(spark: SparkSession, start: str, train: int, validate: int, test: int, step: int, n: int, purge_h: int = 24) -> DataFrame:
    """Days-long train (purged before validation), validation and test spans, rolled on by ``step``."""
    at = lambda days: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"))
    k = F.col("id") * step
    return spark.range(n).select(
        F.col("id").alias("fold"), at(k).alias("train_start"), (at(k + train) - F.expr(f"INTERVAL {purge_h} HOURS")).alias("train_end"),
        at(k + train).alias("val_start"), at(k + train + validate).alias("val_end"),
        at(k + train + validate).alias("test_start"), at(k + train + validate + test).alias("test_end"),
    )


def series_folds(bars: DataFrame, train: int, validate: int, test: int, step: int, purge_h: int = 24) -> DataFrame:
    """(symbol, fold, spans as in ``folds``): all folds that fit between the first bar of a series and the end of its last day."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("b"))
    room = F.floor((F.datediff("b", "a") - (train + validate + test)) / step) + 1
    each = span.where(room > 0).select("symbol", "a", F.explode(F.sequence(F.lit(0).cast("long"), room - 1)).alias("fold"))
    at = lambda days: F.col("a") + F.make_dt_interval((F.col("fold") * step + days).cast("int"))
    return each.select(
        "symbol", "fold", at(0).alias("train_start"), (at(train) - F.expr(f"INTERVAL {purge_h} HOURS")).alias("train_end"), at(train).alias("val_start"),
        at(train + validate).alias("val_end"), at(train + validate).alias("test_start"), at(train + validate + test).alias("test_end"),
    )


def permuted_closes(bars: DataFrame, sims: DataFrame, joint: bool = False) -> DataFrame:
    """(sim, symbol, ts, open, high, low, close): the series' log returns in a random order, a path for each simulation.

    ``joint`` draws one order for all symbols. High and low lie a thousandth off the close.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    r = bars.select("symbol", "ts", "close", (F.ln("close") - F.ln(F.lag("close").over(w))).alias("r"), F.row_number().over(w).alias("k"), F.first("close").over(w).alias("c0"))
    moves = r.where("r IS NOT NULL").join(sims)
    key = [F.col("sim"), F.col("ts")] if joint else [F.col("sim"), F.col("symbol"), F.col("ts")]
    order = Window.partitionBy("sim", "symbol").orderBy(draw(*key), "ts")
    shuffled = moves.select("sim", "symbol", "r", (F.row_number().over(order) + 1).alias("k"))
    slots = r.select("symbol", "ts", "k", "c0").join(sims)
    path = slots.join(shuffled, ["sim", "symbol", "k"], "left")
    walk = running(Window.partitionBy("sim", "symbol").orderBy("ts"))
    path = path.withColumn("close", F.col("c0") * F.exp(F.sum(F.coalesce("r", F.lit(0.0))).over(walk)))
    path = path.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("sim", "symbol").orderBy("ts")), F.col("close")))
    return path.select("sim", "symbol", "ts", "open", (F.col("close") * 1.001).alias("high"), (F.col("close") * 0.999).alias("low"), "close")


def block_bootstrap(trades: DataFrame, sims: DataFrame) -> DataFrame:
    """(sim, total): days of trades drawn with replacement, as many as there are, compounded."""
    daily = trades.groupBy(F.to_date("exit_ts").alias("day")).agg(F.sum(F.ln(F.col("ret") + 1)).alias("r"))
    numbered = daily.withColumn("k", F.row_number().over(Window.orderBy("day")) - 1)  # a row for each trading day
    n = numbered.agg(F.count("*").alias("n"))
    slots = numbered.select("k").join(F.broadcast(n)).join(sims)
    drawn = slots.select("sim", (draw(F.col("sim"), F.col("k")) % F.col("n")).alias("k"))
    return drawn.join(numbered.select("k", "r"), "k").groupBy("sim").agg(F.exp(F.sum("r")).alias("total"))


#: Bars of a block of the cross-correlation below.
CORRELATED = 1 << 16


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def cross_correlation(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sums of a[p] * b[q] by p - q, from 1 - len(b) to len(a) - 1, by fast Fourier transforms."""

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        size = 1 << (len(x) + len(y) - 1).bit_length()
        both = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
        return np.concatenate([both[size - len(y) + 1 :], both[: len(x)]])

    return pd.Series([one(np.asarray(x), np.asarray(y)) for x, y in zip(a, b)], dtype=object)


def shifted_totals(weights: DataFrame) -> DataFrame:
    """(symbol, n, shift, gross): the gross return of each symbol's weights (symbol, ts, open, w), moved round by every possible number of bars.

    A weight earns the move of the bar after its own, and the first bar earns nothing. All shifts are
    one circular cross-correlation of moves and weights: blocks of ``CORRELATED`` bars are
    correlated with each other and the sums of one shift are added up.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    x = weights.withColumn("k", F.row_number().over(w) - 1).withColumn("m", F.coalesce(F.lead("open").over(w) / F.col("open") - 1, F.lit(0.0)))
    x = x.withColumn("m", F.when(F.col("k") == 0, 0.0).otherwise(F.col("m"))).withColumn("block", F.floor(F.col("k") / CORRELATED))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(c).alias("x")))), lambda s: s["x"])
    blocks = x.groupBy("symbol", "block").agg(in_order("m").alias("m"), in_order("w").alias("w"), F.count("*").alias("own"))
    sizes = blocks.groupBy("symbol").agg(F.sum("own").alias("n"))
    other = blocks.select("symbol", F.col("block").alias("other"), F.col("w").alias("v"))
    pairs = blocks.select("symbol", "block", "m").join(other, "symbol").join(sizes, "symbol")
    apart = (F.col("block") - F.col("other")) * CORRELATED
    told = pairs.select("symbol", "n", apart.alias("apart"), F.size("v").alias("back"), F.posexplode(cross_correlation("m", "v")).alias("at", "part"))
    shift = F.pmod(F.col("apart") + F.col("at") - F.col("back"), F.col("n"))  # at - back + 1 bars apart, less the one that a weight waits
    return told.groupBy("symbol", "n", shift.alias("shift")).agg(F.sum("part").alias("gross"))


def circular_shift(weights: DataFrame, sims: DataFrame) -> DataFrame:
    """(sim, gross, actual): what portfolios of randomly shifted weights earned, and what the weights did."""
    totals = shifted_totals(weights)
    n = weights.groupBy("symbol").agg(F.count("*").alias("n"))
    drawn = n.join(sims).select("sim", "symbol", (draw(F.col("sim"), F.col("symbol")) % F.col("n")).alias("shift"))
    real = totals.where("shift = 0").agg(F.sum("gross").alias("actual"))
    null = drawn.join(totals.select("symbol", "shift", "gross"), ["symbol", "shift"]).groupBy("sim").agg(F.sum("gross").alias("gross"))
    return null.join(real)  # one row


def with_rank(drawn: DataFrame, keys: list[str], value: str, places: int = 9) -> DataFrame:
    """Draws beside what was really ``actual``, with ``null_rank``, the share of the draws below it, and ``p_value``, that at or above it, by ``keys``.

    Both are rounded before they are compared, so that a draw that repeats the real run counts as a tie.
    """
    below = (F.round(value, places) < F.round("actual", places)).cast("int")
    told = drawn.groupBy(*keys).agg(F.avg(below).alias("null_rank"), (1 - F.avg(below)).alias("p_value"))
    return drawn.join(told, keys) if keys else drawn.join(told)


def block_permuted(labels: DataFrame, sims: DataFrame, block: int) -> DataFrame:
    """(sim, symbol, k, y): labels (symbol, k, y) with blocks of so many in a row put in a random order, for each simulation."""
    cut = labels.select("symbol", "k", "y", F.floor(F.col("k") / block).alias("block")).join(sims)
    cut = cut.withColumn("d", draw(F.col("sim"), F.col("symbol"), F.col("block")))
    order = Window.partitionBy("sim", "symbol").orderBy("d", "block", "k")
    return cut.select("sim", "symbol", "y", (F.row_number().over(order) - 1).alias("k"))


def least_draws(rows: DataFrame, groups: list[str], order: Column, ties: str, wanted: str, rows_in_group: str) -> DataFrame:
    """Of each group of ``rows`` the ``wanted`` (a column) with the least ``order``, a draw of 32 bits, ties by ``ties``.

    Draws above what so many of ``rows_in_group`` will hardly need are left out before anything
    is sorted; a group that comes out short all the same is drawn from all its rows.
    """
    n, size = F.col(wanted), F.col(rows_in_group)
    bound = (n + 8 * F.sqrt(n) + 16) / size * 2**32
    rows = rows.withColumn("_d", order)
    w = Window.partitionBy(*groups).orderBy("_d", ties)
    few = rows.where(F.col("_d") <= bound)
    ranked = few.withColumn("_k", F.row_number().over(w)).withColumn("_have", F.count("*").over(Window.partitionBy(*groups)))
    enough = ranked.where(F.col("_have") >= F.least(n, size))
    # groups without enough, or without any, of those draws
    short = rows.select(*groups).distinct().join(enough.select(*groups).distinct(), groups, "left_anti")
    rest = rows.join(short, groups, "left_semi").withColumn("_k", F.row_number().over(w)).withColumn("_have", size)
    return enough.unionByName(rest).where(F.col("_k") <= n).drop("_d", "_k", "_have")


def expected_max_sharpe(trials: Column) -> Column:
    """Of that many trials without any skill, in units of their spread."""
    best = lambda n: (1 - EULER_GAMMA) * S.norm_ppf(1 - 1 / n) + EULER_GAMMA * S.norm_ppf(1 - F.exp(F.lit(-1.0)) / n)
    return S.let(trials.cast("double"), lambda n: F.when(n < 2, F.lit(0.0)).otherwise(best(n)))


def deflated_sharpe(sharpe: Column, trials: Column, n: Column, skew: Column, kurtosis: Column, spread: float = 1.0) -> Column:
    """Probability that the true Sharpe ratio is positive after that many trials."""
    width = F.sqrt(F.greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, F.lit(1e-9)))
    return S.norm_cdf((sharpe - spread * expected_max_sharpe(trials)) * F.sqrt(n - 1) / width)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between (x, y) points, flat beyond the ends. Steps between points are those of their decimals: 0.8 - 0.5 is 0.3."""
    out = F.when(x <= points[0][0], points[0][1])
    step = lambda a, b: float(Decimal(str(b)) - Decimal(str(a)))
    for (a, ya), (b, yb) in zip(points, points[1:]):
        out = out.when(x <= b, ya + (x - a) / step(a, b) * step(ya, yb))
    return out.otherwise(points[-1][1])


def composite(degradation: Column, peakiness: Column, p_value: Column, real: Column, stateful: Column) -> dict[str, Column]:
    """Four contributions of 0 to 100 points each, their weighted score and verdict. Null degradation: it did not even work in sample.

    Fixed values: the points of the four maps, the weights and the bounds of the verdicts.
    """
    wf = F.when(degradation.isNull(), 75.0).when(degradation > 0.8, 0.0).otherwise(piecewise(degradation, [(-0.5, 100.0), (0.5, 60.0), (0.8, 30.0)]))
    sweep = F.coalesce(piecewise(peakiness, [(0.0, 0.0), (0.3, 20.0), (0.7, 60.0), (1.0, 100.0)]), F.lit(30.0))
    mc = F.coalesce(piecewise(p_value, [(0.0, 0.0), (0.05, 20.0), (0.2, 50.0), (1.0, 100.0)]), F.lit(50.0))
    dsr = piecewise(real, [(0.0, 100.0), (0.5, 60.0), (0.95, 20.0), (1.0, 0.0)])
    score = F.when(stateful, 0.50 * wf + 0.25 * sweep + 0.10 * mc + 0.15 * dsr).otherwise(0.35 * wf + 0.25 * sweep + 0.25 * mc + 0.15 * dsr)
    verdict = F.when(score < 30, "likely_robust").when(score < 60, "mixed_signals").otherwise("likely_overfit")
    return {"walk_forward": wf, "sweep": sweep, "monte_carlo": mc, "deflated": dsr, "score": score, "verdict": verdict}


#: Gate -> the metric it reads and whether a value passes.
GATES = {
    "G1": ("expectancy", lambda m: (m("expectancy") > 0) & (m("profit_factor") >= 1.15)),
    "G2": ("sharpe", lambda m: m("sharpe") >= 0.8),
    "G3": ("dsr", lambda m: m("dsr") >= 0.95),
    "G4": ("fold_positive", lambda m: m("fold_positive") >= 0.6),
    "G5": ("null_rank", lambda m: m("null_rank") >= 0.95),
    "G6": ("cost_edge", lambda m: m("cost_edge") <= 0.5),
    "G7": ("plateau", lambda m: m("plateau") >= 0.7),
    "G8": ("stressed", lambda m: m("stressed") > 0),
    "G9": ("per_day", lambda m: m("per_day").between(0.2, 5)),
}


def gate_verdict(trades: Column, feasible: Column, m=F.col) -> tuple[Column, Column]:
    """Gates failed (a null metric skips its gate), and the verdict."""
    failed = F.array_compact(F.array(*[F.when(m(metric).isNotNull() & ~passes(m), F.lit(g)) for g, (metric, passes) in GATES.items()]))
    hard = F.filter(failed, lambda g: g != "G9")
    verdict = (
        F.when(trades == 0, "REJECTED").when(F.size(hard) > 0, "REJECTED").when(~feasible, "CONDITIONAL")
        .when(F.array_contains(failed, "G9") & (m("per_day") < 0.2), "PASS_LOW_FREQUENCY").when(F.size(failed) > 0, "REJECTED").otherwise("PASS")
    )
    return failed, verdict


def drift_health(paper: Column, backtest: Column, n: Column, bars_per_day: float, drawdown: Column, allowed: Column) -> Column:
    """Two-sided deviation against bands that widen with the root of the bar rate (4h is the base)."""
    k = (bars_per_day / 6) ** 0.5
    deviation = F.abs(paper - backtest) / F.greatest(F.abs(backtest), F.lit(1e-9))
    return (
        F.when(n < 5, "insufficient_data").when(drawdown > 1.5 * k * allowed, "critical")
        .when(deviation <= 0.30 * k, "healthy").when(deviation <= 0.60 * k, "watch").otherwise("critical")
    )


def run_return(run: DataFrame, keys: list[str]) -> DataFrame:
    """Total net return of vector runs."""
    return run.groupBy(*keys).agg((F.exp(F.sum(F.ln(F.col("r") + 1))) - 1).alias("total"))


def backtest_cells(bars: DataFrame, cells: DataFrame, axes: list[str], signal, per_side_bps: float) -> DataFrame:
    """Every cell's vector run: bars times cells, one job. ``signal`` gives the 0/1 position from the cell's columns."""
    both = bars.join(cells).withColumn("pos", signal)
    return G.vector_backtest(both, per_side_bps, keys=(*axes, "symbol"))


def ridge_report(rows: DataFrame, features: list[str], target: str, order: str, alpha: float = 1.0, share: float = 0.7) -> DataFrame:
    """(symbol, n_train, n_test, r2_train, r2_test, ic): a ridge regression for each symbol on its first ``share`` of rows.

    Features are standardised by the training rows. Sums of products are one aggregate; the
    small system of a symbol is solved row by row, so no task holds a symbol's rows.
    """
    own, w = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy(order)
    cut = rows.withColumn("train", F.row_number().over(w) <= F.floor(F.count("*").over(own) * share))
    means = [F.avg(c).alias(f"m_{c}") for c in features] + [F.stddev_pop(c).alias(f"s_{c}") for c in features]
    known = cut.where("train").groupBy("symbol").agg(*means, F.avg(target).alias("mean_y"))
    z = cut.join(known, "symbol").select(
        "symbol", "train", F.col(target).alias("y"), "mean_y",
        F.array(*[(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in features]).alias("z"),
    )
    k = len(features)
    at = lambda i: F.get("z", F.lit(i))
    sums = [F.sum(at(i) * at(j)) for i in range(k) for j in range(k)] + [F.sum(at(i) * (F.col("y") - F.col("mean_y"))) for i in range(k)]

    @F.pandas_udf("array<double>")
    def solved(moments: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.solve(np.array(m[: k * k]).reshape(k, k) + alpha * np.eye(k), m[k * k :]).tolist() for m in moments], dtype=object)

    fit = z.where("train").groupBy("symbol").agg(F.array(*sums).alias("moments")).select("symbol", solved("moments").alias("b"))
    told = z.join(fit, "symbol").withColumn("p", F.col("mean_y") + F.aggregate(F.zip_with("z", "b", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    ranked = Window.partitionBy("symbol", "train")
    middle = lambda c: F.rank().over(ranked.orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol", "train", c)) - 1) / 2
    told = told.withColumn("ry", middle("y")).withColumn("rp", middle("p"))
    side = told.groupBy("symbol", "train").agg(
        F.count("*").alias("n"), (1 - F.sum((F.col("y") - F.col("p")) ** 2) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"), F.corr("ry", "rp").alias("ic")
    )
    of = lambda c, train: F.max(F.when(F.col("train") == train, F.col(c)))
    return side.groupBy("symbol").agg(of("n", True).alias("n_train"), of("n", False).alias("n_test"), of("r2", True).alias("r2_train"), of("r2", False).alias("r2_test"), of("ic", False).alias("ic"))


def fold_learner(features: list[str], n: int):
    """A standardised logistic model with an L2 weight of 1 in all."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    joined = VectorAssembler(inputCols=features, outputCol="_x")
    return Pipeline(stages=[joined, LogisticRegression(featuresCol="_x", labelCol="y", maxIter=200, regParam=1.0 / max(n, 1))])


def labelled(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows without a null, and ``y``: 1 where the return ahead is positive."""
    return rows.dropna(subset=[*features, "r"]).withColumn("y", (F.col("r") > 0).cast("double"))


def fold_schema(rows: DataFrame) -> str:
    return f"fold long, symbol string, ts {rows.schema['ts'].dataType.simpleString()}, y double, p_up double, val_auc double, k double"


SPANS = [("train_start", "train_end"), ("val_start", "val_end"), ("test_start", "test_end")]


def boost_folds(rows: DataFrame, plan: DataFrame, features: list[str], least: tuple[int, int, int] = (1000, 100, 100), how: boosting.Boosting = boosting.Boosting()) -> DataFrame:
    """What ``fit_folds`` gives, by boosted trees: a task a fold, all folds side by side.

    Rows go to each fold whose spans hold them. A task holds the rows of a fold, a number for each
    feature while they are binned and a byte for each after that.
    """
    part = F.coalesce(*[F.when((F.col("ts") >= F.col(a)) & (F.col("ts") < F.col(b)), i) for i, (a, b) in enumerate(SPANS)])
    held = labelled(rows, features).join(plan, (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("test_end"))).withColumn("_part", part).where("_part IS NOT NULL")
    names = ["fold", "symbol", "ts", "y", "p_up", "val_auc", "k"]

    def fitted(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["symbol", "ts"])
        train, val, test = (found[found["_part"] == i] for i in range(3))
        if any(len(x) < n for x, n in zip((train, val, test), least)) or train["y"].nunique() < 2 or val["y"].nunique() < 2:
            return pd.DataFrame(columns=names)
        numbers = [x[features].to_numpy(float) for x in (train, val, test)]
        on_val, on_test = boosting.scores(numbers[0], train["y"].to_numpy(), numbers[1:], how)
        implied, moved = val["implied"].to_numpy(float), np.abs(val["r"].to_numpy()) * 1e4
        known = implied > 0
        k = float(np.median(moved[known] / implied[known])) if known.any() else 1.0
        p = np.interp(on_test, *boosting.pooled(on_val, val["y"].to_numpy()))
        return test[["fold", "symbol", "ts", "y"]].assign(p_up=p, val_auc=boosting.auc(on_val, val["y"].to_numpy()), k=k)

    used = held.select("fold", "symbol", "ts", *features, "r", "implied", "y", "_part")
    return used.groupBy("fold").applyInPandas(fitted, fold_schema(rows))


def fit_folds(rows: DataFrame, plan: DataFrame, features: list[str], least: tuple[int, int, int] = (1000, 100, 100), at_once: int = 4) -> DataFrame:
    """(fold, symbol, ts, y, p_up, val_auc, k): each fold's test rows with the calibrated chance of a rise, by a logistic model.

    ``rows`` are (symbol, ts, features, r, implied), ``r`` the log return ahead and ``implied`` the move,
    in hundredths of a per cent, that volatility implies. A fold learns from its training span, and from
    its validation span alone come the isotonic calibration, the area under the curve of the scores
    before it, and ``k``, the median of real to implied moves (1 if none is implied). All symbols of a
    fold share a model. Rows with a null are left out; a fold with fewer rows than ``least`` in one of
    its spans, or with labels all alike, gives none. Folds are a plan's few, each a distributed fit,
    ``at_once`` of them side by side.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = written(labelled(rows, features), "fold-rows")  # read by every fit, and again when the result is

    def fitted(fold) -> DataFrame | None:
        train, val, test = (known.where((F.col("ts") >= F.lit(fold[a])) & (F.col("ts") < F.lit(fold[b]))) for a, b in SPANS)
        sizes = [part.agg(F.count("*"), F.count_distinct("y")).first() for part in (train, val, test)]
        if any(s[0] < n for s, n in zip(sizes, least)) or sizes[0][1] < 2 or sizes[1][1] < 2:
            return None
        model = fold_learner(features, sizes[0][0]).fit(train)
        scored = lambda part: model.transform(part).withColumn("raw", vector_to_array("probability")[1])
        told = scored(val)
        ratio = F.when(F.col("implied") > 0, F.abs("r") * 1e4 / F.col("implied"))
        middle = exact_quantiles(told, [], ratio, {"k": 0.5}).first()
        k = middle["k"] if middle else 1.0
        auc = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", numBins=0).evaluate(told)
        calibrated = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="p_up").fit(told.select("raw", "y")).transform(scored(test))
        return calibrated.select(F.lit(fold["fold"]).alias("fold"), "symbol", "ts", "y", "p_up", F.lit(auc).alias("val_auc"), F.lit(k).alias("k"))

    with ThreadPool(at_once) as pool:
        found = [x for x in pool.map(fitted, plan.orderBy("fold").collect()) if x is not None]
    if not found:
        return rows.sparkSession.createDataFrame([], fold_schema(rows))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
