"""Supporting operators: axis choice, cost and fee lookups, level matching, verdicts, recent closes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.operators import engines as G
from quernstone.plans import lookups as K
from quernstone.plans import validation as V
from quernstone.queries.aggregates import BPS, TRADES, vector_run
from quernstone.queries.joins import POS, positions
from quernstone.queries.registry import add, col, rounded, sql_rounded
from quernstone.queries.validation import MOMENTS, deflated_sql
from quernstone.sources.bars import DAILY, daily_bars, scan


@add("K10_axis_pruning", "WITH a AS (SELECT p_size AS run, p_partkey % 6 AS rank, 2 + count(*) % 5 AS n FROM part GROUP BY 1, 2), c AS (SELECT *, round(exp(sum(ln(n)) OVER (PARTITION BY run ORDER BY rank ROWS UNBOUNDED PRECEDING)))::BIGINT AS cells FROM a) SELECT run, count(*) FILTER (cells <= 50) AS axes, coalesce(max(cells) FILTER (cells <= 50), 1) AS cells, coalesce(string_agg(rank::VARCHAR, ',' ORDER BY rank) FILTER (cells > 50), '') AS dropped FROM c GROUP BY 1")
def k10(spark, sf_dir):
    """The axes of most impact whose grid stays within 50 cells."""
    axes = scan(spark, sf_dir, "part").groupBy(F.col("p_size").alias("run"), (F.col("p_partkey") % 6).alias("rank")).agg((2 + F.count("*") % 5).alias("n"))
    chosen = K.pruned_axes(axes, ["run"], "rank", "n", 50)
    gone = F.sort_array(F.collect_list(F.when(~col.kept, F.col("rank"))))
    return chosen.groupBy("run").agg(
        F.count_if("kept").alias("axes"), F.coalesce(F.max(F.when(col.kept, F.col("cells"))), F.lit(1)).alias("cells"), F.array_join(gone.cast("array<string>"), ",").alias("dropped")
    )


@add("V21_dsr_recount", f"WITH {MOMENTS}, y AS (SELECT *, m / sd * sqrt(252::DOUBLE) AS sr, round_even(greatest(n / 252.0::DOUBLE, 2), 0) AS yr FROM mo), z AS (SELECT *, {deflated_sql('sr', 20, 'n', 1.0)} AS x, {deflated_sql('sr', 20, 'yr', 1.0)} AS y FROM y) SELECT symbol, n, yr::BIGINT AS years, {sql_rounded({'before': 'x', 'after': 'y', 'delta': 'y - x'})} FROM z")
def v21(spark, sf_dir):
    """Deflated Sharpe of stored runs, counted anew by years instead of bars."""
    run = vector_run(spark, sf_dir).groupBy("symbol").agg((F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sr"), F.count("*").alias("n"), F.skewness("r").alias("g"), (F.kurtosis("r") + 3).alias("k"))
    years = F.bround(F.greatest(F.col("n") / 252.0, F.lit(2.0)), 0)
    of = lambda n: V.deflated_sharpe(F.col("sr"), F.lit(20), n, F.col("g"), F.col("k"))
    both = run.select("symbol", "n", years.cast("long").alias("years"), of(F.col("n")).alias("before"), of(years).alias("after"))
    return both.select("symbol", "n", "years", *rounded({"before": col.before, "after": col.after, "delta": col.after - col.before}))


@add("SP7_spot_listing", "SELECT n_name AS symbol, coalesce(m.spot AND m.active, false) AS listed FROM nation LEFT JOIN (SELECT s_nationkey AS k, s_nationkey % 3 <> 0 AS spot, sum(s_acctbal) > 0 AS active FROM supplier GROUP BY 1, 2) m ON n_nationkey = m.k")
def sp7(spark, sf_dir):
    """Whether each wanted symbol is an active spot pair; unlisted ones are not."""
    markets = scan(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.sum("s_acctbal") > 0).alias("active")).withColumn("spot", F.col("s_nationkey") % 3 != 0)
    wanted = scan(spark, sf_dir, "nation")
    return wanted.join(markets, wanted["n_nationkey"] == markets["s_nationkey"], "left").select(F.col("n_name").alias("symbol"), F.coalesce(F.col("spot") & F.col("active"), F.lit(False)).alias("listed"))


SPECS = "sp AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'kraken' ELSE 'binance_spot' END AS exchange, 'P' || (s_nationkey % 5) AS symbol, CASE s_suppkey % 4 WHEN 0 THEN 'crypto_spot' WHEN 1 THEN 'fx_spot' WHEN 2 THEN 'metals_spot' END AS asset_class FROM supplier)"
TIERS = [("binance_spot", "P0", "taker", 7.5), ("binance_spot", "P0", "maker", 5.0), ("binance_spot", "P1", "taker", 9.0), ("kraken", "P2", "taker", 26.0)]


@add("SP16_spec_costs", f"WITH {SPECS}, t AS (SELECT * FROM (VALUES {', '.join(str(t) for t in TIERS)}) v(exchange, symbol, side, bps)) SELECT id, {sql_rounded({'commission': 'coalesce(bps, CASE coalesce(asset_class, $$crypto_spot$$) WHEN $$crypto_spot$$ THEN 10.0 ELSE 0.0 END) / 10000'}, 8)} FROM sp LEFT JOIN t ON t.exchange = CASE sp.exchange WHEN 'binance' THEN 'binance_spot' ELSE sp.exchange END AND t.symbol = sp.symbol AND side = 'taker'")
def sp16(spark, sf_dir):
    """Each document's commission: its listed tier, else its asset class's."""
    s, k = scan(spark, sf_dir, "supplier"), F.col("s_suppkey")
    specs = s.select(
        k.alias("id"), F.when(k % 3 == 0, "binance").when(k % 3 == 1, "kraken").otherwise("binance_spot").alias("exchange"),
        F.concat(F.lit("P"), (F.col("s_nationkey") % 5).cast("string")).alias("symbol"),
        F.when(k % 4 == 0, "crypto_spot").when(k % 4 == 1, "fx_spot").when(k % 4 == 2, "metals_spot").alias("asset_class"),
    )
    tiers = spark.createDataFrame(TIERS, "exchange string, symbol string, side string, bps double")
    return K.costed(specs, tiers).select("id", *rounded({"commission": col.commission}, 8))


@add("SP19_level_match", f"WITH {TRADES}, p AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS place FROM bars), n AS (SELECT t.symbol, trade, arg_min(place, abs(epoch(p.ts) - epoch(entry_ts + INTERVAL 13 HOUR)) * 100000 - place) AS a, arg_min(place, abs(epoch(p.ts) - epoch(exit_ts + INTERVAL 3 HOUR)) * 100000 - place) AS z FROM trades t JOIN p USING (symbol) GROUP BY 1, 2) SELECT symbol, trade, (z - a)::BIGINT AS bars, {sql_rounded({'stop': 'entry_price * 0.95::DOUBLE', 'target': 'entry_price * 1.1::DOUBLE'}, 4)}, abs(exit_price - entry_price * 0.95::DOUBLE) <= 0.02::DOUBLE * greatest(exit_price, entry_price * 0.95::DOUBLE) AS at_stop, abs(exit_price - entry_price * 1.1::DOUBLE) <= 0.02::DOUBLE * greatest(exit_price, entry_price * 1.1::DOUBLE) AS at_target FROM trades JOIN n USING (symbol, trade)")
def sp19(spark, sf_dir):
    """A trade's reconstructed stop and target, whether its exit lies at one, and the bars between its ends by nearest bar."""
    bars = daily_bars(spark, sf_dir).select("symbol", "ts")
    t = G.vector_trades(vector_run(spark, sf_dir), BPS).select("symbol", "trade", "entry_price", "exit_price", (col.entry_ts + F.expr("INTERVAL 13 HOURS")).alias("a"), (col.exit_ts + F.expr("INTERVAL 3 HOURS")).alias("z"))
    t = K.nearest_bar(K.nearest_bar(t, bars, ["symbol"], "a", "at_a"), bars, ["symbol"], "z", "at_z")
    stop, target = col.entry_price * 0.95, col.entry_price * 1.1
    return t.select(
        "symbol", "trade", (col.at_z - col.at_a).cast("long").alias("bars"), *rounded({"stop": stop, "target": target}, 4),
        K.close_prices(col.exit_price, stop, 0.02).alias("at_stop"), K.close_prices(col.exit_price, target, 0.02).alias("at_target"),
    )


FACTS = {"s_ret": "(p_size - 25) / 50.0", "b_ret": "(p_partkey % 41 - 20) / 40.0", "s_sharpe": "(p_partkey % 13 - 6) / 5.0", "b_sharpe": "(p_size % 11 - 5) / 5.0", "s_dd": "p_size / 100.0", "b_dd": "(p_partkey % 53) / 100.0"}


@add("SP20_verdict", f"WITH x AS (SELECT p_partkey AS id, p_size % 9 AS n, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in FACTS.items())} FROM part) SELECT id, CASE WHEN n = 0 THEN 'no_trades' WHEN abs(s_ret - b_ret) < 0.005 THEN 'matched' WHEN s_ret > b_ret THEN 'outperformed' ELSE 'underperformed' END AS result, CASE WHEN n > 0 AND abs(s_sharpe) + abs(b_sharpe) > 0 THEN CASE WHEN s_sharpe - b_sharpe > 0.05 THEN 'better' WHEN s_sharpe - b_sharpe < -0.05 THEN 'worse' ELSE 'similar' END END AS risk, CASE WHEN n > 0 THEN CASE WHEN s_dd - b_dd < -0.02::DOUBLE THEN 'avoided' WHEN s_dd - b_dd > 0.02::DOUBLE THEN 'deeper' END END AS depth FROM x")
def sp20(spark, sf_dir):
    """A strategy against holding, in words."""
    x = scan(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 9).alias("n"), *[F.expr(f"cast({v} as double)").alias(k) for k, v in FACTS.items()])
    side = lambda p: {"ret": F.col(f"{p}_ret"), "sharpe": F.col(f"{p}_sharpe"), "drawdown": F.col(f"{p}_dd")}
    return x.select("id", *K.verdict(side("s"), side("b"), F.col("n")))


@add("SP21_log_returns", f"WITH {DAILY}, l AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS x FROM bars) SELECT symbol, ts, {sql_rounded({'log_return': 'x'})} FROM l WHERE x IS NOT NULL")
def sp21(spark, sf_dir):
    """Log returns of closes, the first bar of each symbol left out."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    return daily_bars(spark, sf_dir).select("symbol", "ts", *rounded({"log_return": F.log(col.close / before)})).where("log_return IS NOT NULL")


@add("SP21_axis_values", "SELECT axis, arg_max(v, id) AS value FROM (SELECT p_size % 4 AS axis, p_partkey AS id, (p_partkey % 7) * 0.5::DOUBLE + (p_partkey % 3) * 0.00001::DOUBLE AS v FROM part) GROUP BY axis, round(v, 4)")
def sp21_axis(spark, sf_dir):
    """Candidate values of an axis that differ in the fourth place at least."""
    k = F.col("p_partkey")
    x = scan(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("axis"), k.alias("id"), ((k % 7) * F.lit(0.5) + (k % 3) * F.lit(0.00001)).alias("value"))
    return K.distinct_places(x, ["axis"], "value", "id").select("axis", "value")


@add("SP25_entry_fee", "SELECT o_orderkey AS position, o_custkey AS owner, coalesce(l_tax, 0)::DOUBLE AS entry_fee FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_linestatus = 'O' WHERE o_orderstatus = 'O'")
def sp25(spark, sf_dir):
    """The fee of the fill that opened each open position; none on file counts as zero."""
    fills = scan(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_linestatus = 'O'").select("l_orderkey", "l_tax")
    held = scan(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    return held.join(fills, held["o_orderkey"] == fills["l_orderkey"], "left").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("owner"), F.coalesce(F.col("l_tax").cast("double"), F.lit(0.0)).alias("entry_fee"))


@add("SP26_open_positions", f"WITH {DAILY}, {POS}, m AS (SELECT symbol, arg_max(close, ts) AS mark FROM bars WHERE ts < TIMESTAMP '1995-06-01' AND symbol <> 'NO' GROUP BY 1) SELECT id, symbol, {sql_rounded({'unrealised': 'coalesce(mark, close) - close'})} FROM pos LEFT JOIN m USING (symbol)")
def sp26(spark, sf_dir):
    """Open positions at their symbol's latest close; a symbol without one is marked at entry."""
    bars = daily_bars(spark, sf_dir)
    marks = bars.where("ts < TIMESTAMP '1995-06-01' AND symbol <> 'NO'").groupBy("symbol").agg(F.max_by("close", "ts").alias("mark"))
    return positions(bars).join(marks, "symbol", "left").select("id", "symbol", *rounded({"unrealised": F.coalesce("mark", "close") - col.close}))


@add("SP28_recent_closes", f"WITH {DAILY}, r AS (SELECT symbol, ts FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 5), g AS (SELECT symbol, ts, epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM r) SELECT symbol, string_agg(strftime(ts, '%Y-%m-%d'), ',' ORDER BY ts) AS closes, CASE WHEN max(gap) > 86400 THEN 'stale_data' END AS event FROM g GROUP BY 1")
def sp28(spark, sf_dir):
    """The last five closes of each symbol, and a warning if two are over a bar apart."""
    r = K.recent(daily_bars(spark, sf_dir), ["symbol"], "ts", 5)
    gaps = F.zip_with(F.slice("times", 2, 4), F.slice("times", 1, 4), lambda b, a: F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp")))
    return r.select("symbol", F.array_join(F.transform("times", lambda t: F.date_format(t, "yyyy-MM-dd")), ",").alias("closes"), F.when(F.exists(gaps, lambda g: g > 86400), "stale_data").alias("event"))
