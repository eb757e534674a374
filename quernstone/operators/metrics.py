"""Metrics of runs, trades, folds, sweeps and nulls as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.indicators import running

DAY_MICROS = 86_400_000_000


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def equity_metrics(run: DataFrame, bars_per_year: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Total return, CAGR over calendar years of 365.25 days, volatility, Sharpe, Sortino (downside over all bars), max drawdown."""
    w = Window.partitionBy(*keys).orderBy("ts")
    seen = run.withColumn("_dd", 1 - F.col("equity") / F.max("equity").over(running(w)))
    years = (F.max(micros("ts")) - F.min(micros("ts"))) / (365.25 * DAY_MICROS)
    final = F.max_by("equity", "ts")
    down = F.sqrt(F.avg(F.pow(F.least(F.col("r"), F.lit(0.0)), 2)))
    root = bars_per_year**0.5
    return seen.groupBy(*keys).agg(
        (final - 1).alias("total_return"),
        (F.pow(final, safe_div(F.lit(1.0), years)) - 1).alias("cagr"),
        (F.stddev_samp("r") * root).alias("volatility"),
        (safe_div(F.avg("r"), F.stddev_samp("r")) * root).alias("sharpe"),
        (safe_div(F.avg("r"), down) * root).alias("sortino"),
        F.max("_dd").alias("max_drawdown"),
    )


def drawdown_recovery(run: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Deepest drawdown, its peak and trough, and whole days from that peak to the first recovery (null while under water)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    peaks = run.withColumn("peak", F.max("equity").over(running(w))).withColumn("dd", 1 - F.col("equity") / F.col("peak"))
    peaks = peaks.withColumn("peak_ts", F.max(F.when(F.col("equity") == F.col("peak"), F.col("ts"))).over(running(w)))
    worst = peaks.groupBy(*keys).agg(F.max("dd").alias("max_dd"), F.min_by("ts", F.struct(-F.col("dd"), F.col("ts"))).alias("trough_ts"), F.min_by("peak_ts", F.struct(-F.col("dd"), F.col("ts"))).alias("peak_ts"), F.min_by("peak", F.struct(-F.col("dd"), F.col("ts"))).alias("peak"))
    after = run.join(worst, list(keys)).where((F.col("ts") > F.col("trough_ts")) & (F.col("equity") >= F.col("peak"))).groupBy(*keys).agg(F.min("ts").alias("recovered_ts"))
    days = F.floor((micros("recovered_ts") - micros("peak_ts")) / DAY_MICROS)
    return worst.join(after, list(keys), "left").withColumn("recovery_days", days)


def trade_stats(trades: DataFrame, keys: tuple[str, ...] = ("symbol",), pnl: str = "ret") -> DataFrame:
    """Number, win rate, profit factor (at most 1e6), mean win and loss, expectancy, extremes, longest streaks."""
    x = F.col(pnl)
    w = Window.partitionBy(*keys).orderBy("entry_ts")
    won = trades.withColumn("_won", (x > 0).cast("int"))
    # runs of equal outcome: the difference of two row numbers is constant within one
    runs = won.withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_won").orderBy("entry_ts")))
    lengths = runs.groupBy(*keys, "_won", "_run").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max(F.when(F.col("_won") == 1, F.col("n"))).alias("win_streak"), F.max(F.when(F.col("_won") == 0, F.col("n"))).alias("loss_streak"))
    gain, loss = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))
    stats = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.avg((x > 0).cast("int")).alias("win_rate"),
        F.when(loss > 0, F.least(gain / F.nullif(loss, F.lit(0.0)), F.lit(1e6))).when(gain > 0, F.lit(1e6)).otherwise(0.0).alias("profit_factor"),
        F.avg(F.when(x > 0, x)).alias("avg_win"),
        F.avg(F.when(x < 0, x)).alias("avg_loss"),
        F.avg(x).alias("expectancy"),
        F.max(x).alias("best"),
        F.min(x).alias("worst"),
    )
    return stats.join(lengths, list(keys)).na.fill(0, ["win_streak", "loss_streak"])


def exposure(trades: DataFrame, run: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Share of the run's span in which a trade was open, 0 to 1."""
    held = trades.groupBy(*keys).agg(F.sum(micros("exit_ts") - micros("entry_ts")).alias("_held"))
    span = run.groupBy(*keys).agg((F.max(micros("ts")) - F.min(micros("ts"))).alias("_span"))
    return span.join(held, list(keys), "left").select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("_held"), F.lit(0)) / F.nullif(F.col("_span"), F.lit(0)))).alias("exposure"))


def sample_skew(n: Column, g1: Column) -> Column:
    """Bias-adjusted skewness from the population's."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-adjusted excess kurtosis from the population's."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def net_metrics(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Profit factor on returns (losses include zero; infinite as null), expectancy in bps, adjusted moments."""
    x, n = F.col("ret"), F.count("ret").cast("double")
    gain, loss = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x <= 0, -x).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count("ret").alias("trades"),
        safe_div(gain, loss).alias("profit_factor"),
        (F.avg(x) * 1e4).alias("expectancy_bps"),
        sample_skew(n, F.skewness("ret")).alias("skew"),
        (sample_kurtosis(n, F.kurtosis("ret")) + 3).alias("kurtosis"),
    )


def monthly_profit_factor(run: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Summed gains over summed losses of compounded monthly returns."""
    months = run.groupBy(*keys, F.date_trunc("month", "ts").alias("month")).agg((F.exp(F.sum(F.ln(F.col("r") + 1))) - 1).alias("m"))
    m = F.col("m")
    return months.groupBy(*keys).agg(F.count("*").alias("months"), safe_div(F.sum(F.when(m > 0, m).otherwise(0.0)), F.sum(F.when(m <= 0, -m).otherwise(0.0))).alias("profit_factor"))


def null_rollup(values: DataFrame, column: str, real: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of simulated values: moments, range, share at or above the real one, and the real one's rank."""
    x = F.col(column)
    return values.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg((x >= real).cast("int")).alias("p_value"), F.avg((x < real).cast("int")).alias("rank"),
    )


def histogram(values: DataFrame, column: str, bins: int = 24) -> DataFrame:
    """Equal bins from least to largest, the last closed on the right; a single one if they are equal."""
    bounds = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = F.col(column)
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(width < 1e-12, F.lit(0)).otherwise(F.least(F.floor((x - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return values.where(x.isNotNull()).join(F.broadcast(bounds)).groupBy(k.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def downsample(curve: DataFrame, value: str, rows: int, key: str = "symbol") -> DataFrame:
    """(key, ts, value) of the earliest least and earliest largest point of each ``rows`` points."""
    w = Window.partitionBy(key).orderBy("ts")
    cut = curve.select(key, "ts", value, F.floor((F.row_number().over(w) - 1) / rows).alias("_k"))
    point = F.struct("ts", value)
    ends = cut.groupBy(key, "_k").agg(F.min_by(point, F.struct(value, "ts")).alias("a"), F.max_by(point, F.struct(F.col(value), -micros("ts"))).alias("b"))
    return ends.select(key, F.explode(F.array("a", "b")).alias("p")).select(key, "p.ts", f"p.{value}").distinct()
