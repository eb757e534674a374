"""Ledger operators and the reports read from it. Orders are the trader's orders, priorities its strategies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import indicators as I
from quernstone.operators import joins as J
from quernstone.operators import simulators as S
from quernstone.operators.sequential import ordered_scan
from quernstone.plans import ledger as L
from quernstone.queries.aggregates import TRADES, vector_trades
from quernstone.queries.joins import POS, positions
from quernstone.queries.registry import add, col, rounded, sql_rounded
from quernstone.sources.bars import DAILY, daily_bars, scan



def flows(spark, sf_dir):
    o = scan(spark, sf_dir, "orders")
    flow = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")) / 1000
    return o.select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), flow.alias("flow"))


FLOWS = "fl AS (SELECT o_orderpriority AS strategy, o_orderdate AS ts, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END / 1000 AS flow FROM orders)"
SNAP = f"{FLOWS}, eq AS (SELECT *, 1000000 + sum(flow) OVER w AS equity FROM fl WINDOW w AS (PARTITION BY strategy ORDER BY ts, id ROWS UNBOUNDED PRECEDING)), sn AS (SELECT *, greatest(1000000, max(equity) OVER (PARTITION BY strategy ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"


def snaps(spark, sf_dir):
    return L.snapshots(flows(spark, sf_dir), 1_000_000.0, ("strategy",))


@add("T1_risk_ladder")
def t1(spark, sf_dir):
    """Approvals count against later signals of the same run, so signals go through in order, a run for each priority."""
    o = scan(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    x = o.select(
        "o_orderpriority", "o_orderdate", "o_orderkey",
        F.when(key % 11 == 0, "EXIT").when(key % 13 == 0, "SELL").otherwise("BUY").alias("action"),
        (F.col("o_custkey") % 7).cast("string").alias("symbol"), (key % 17 != 0).alias("enabled"), ((key % 900).cast("double")).alias("stale_s"),
        (1 + key % 3).cast("double").alias("size"), (F.col("o_totalprice") / 1e6).alias("price"), (F.col("o_totalprice") / 1.1e6).alias("stop"),
    )
    cols = ["o_orderkey", "action", "symbol", "enabled", "stale_s", "size", "price", "stop"]
    return ordered_scan(x, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], cols, lambda k: S.RiskLadder(100.0), "signal long, approved boolean, reason string")


@add("T2_window_pnl", f"WITH {SNAP} SELECT a.strategy, a.id, {sql_rounded({'pnl': 'a.equity / b.equity - 1'})} FROM sn a ASOF LEFT JOIN (SELECT strategy, ts, arg_max(equity, id) AS equity FROM sn GROUP BY 1, 2) b ON a.strategy = b.strategy AND a.ts - INTERVAL 7 DAY >= b.ts")
def t2(spark, sf_dir):
    s = snaps(spark, sf_dir)
    daily = s.groupBy("strategy", "ts").agg(F.max_by("equity", "id").alias("equity"))
    got = L.window_pnl(daily, s.withColumn("anchor", col.ts - F.expr("INTERVAL 7 DAYS")), ["strategy"])
    return got.select("strategy", "id", *rounded({"pnl": F.col("pnl")}))


@add("T3_fills", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * 1.0005), 0)::BIGINT AS notional FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def t3(spark, sf_dir):
    o = scan(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select("l_returnflag", F.lit("buy").alias("side"), F.lit(1).alias("quantity"), F.col("l_extendedprice").alias("price"))
    return L.fills(o, 5.0, 10.0).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("notional"), 0).cast("long").alias("notional"))


@add("T4_stop_close", f"WITH {DAILY}, {POS}, h AS (SELECT id, pos.symbol, stop, pos.close, min(b.ts) AS breach_ts FROM pos JOIN bars b ON b.symbol = pos.symbol AND b.ts >= entry_ts AND b.low <= stop GROUP BY ALL) SELECT id, symbol, breach_ts, 'EXIT' AS action, {sql_rounded({'fill': 'stop * 0.9995', 'pnl': 'stop * 0.9995 - close'}, 4)} FROM h")
def t4(spark, sf_dir):
    """A position whose stop was touched: a closing order filled at the stop."""
    bars = daily_bars(spark, sf_dir)
    hit = J.first_breach(positions(bars), bars, "id").where("breach_ts IS NOT NULL")
    fill = F.col("stop") * 0.9995
    return hit.select("id", "symbol", "breach_ts", F.lit("EXIT").alias("action"), *rounded({"fill": fill, "pnl": fill - F.col("close")}, 4))


@add("T5_order_fills", f"WITH {DAILY}, {POS} SELECT id, CASE WHEN b.open IS NULL THEN 'rejected' ELSE 'filled' END AS status, {sql_rounded({'fill': 'b.open * 1.0005'}, 4)} FROM pos LEFT JOIN bars b ON b.symbol = pos.symbol AND b.ts = entry_ts + INTERVAL 1 DAY")
def t5(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    p = positions(bars).withColumn("ts", F.col("entry_ts") + F.expr("INTERVAL 1 DAY")).join(bars.select("symbol", "ts", "open"), ["symbol", "ts"], "left")
    return p.select("id", F.when(F.col("open").isNull(), "rejected").otherwise("filled").alias("status"), *rounded({"fill": F.col("open") * 1.0005}, 4))


@add("T6_snapshots", f"WITH {SNAP} SELECT strategy, id, {sql_rounded({'equity': 'equity', 'peak': 'peak'}, 1)}, {sql_rounded({'drawdown': '1 - equity / peak'}, 4)} FROM sn")
def t6(spark, sf_dir):
    return snaps(spark, sf_dir).select("strategy", "id", *rounded({k: F.col(k) for k in ("equity", "peak")}, 1), *rounded({"drawdown": F.col("drawdown")}, 4))


@add("T7_equity_read", f"WITH {SNAP} SELECT id, {sql_rounded({'equity': 'equity'}, 1)} FROM sn WHERE strategy = '1-URGENT' AND ts >= '1998-01-01'")
def t7(spark, sf_dir):
    return snaps(spark, sf_dir).where((F.col("strategy") == "1-URGENT") & (col.ts >= F.lit("1998-01-01").cast("timestamp_ntz"))).select("id", *rounded({"equity": F.col("equity")}, 1))


@add("T8_paper_broker")
def t8(spark, sf_dir):
    o = scan(spark, sf_dir, "orders")
    x = o.select("o_orderpriority", "o_orderdate", "o_orderkey", (F.col("o_custkey") % 5).cast("string").alias("symbol"), F.when(F.col("o_orderkey") % 3 == 0, "sell").otherwise("buy").alias("side"), (1 + F.col("o_orderkey") % 4).cast("double").alias("quantity"), (F.col("o_totalprice") / 100).alias("price"))
    out = ordered_scan(x, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "symbol", "side", "quantity", "price"], lambda k: S.PaperBroker(), "order_id long, status string, cash double, equity double, exposure double")
    return out.select("o_orderpriority", "order_id", "status", *rounded({k: F.col(k) for k in ("cash", "equity", "exposure")}, 4))


@add("T9_guards")
def t9(spark, sf_dir):
    s = snaps(spark, sf_dir).withColumn("micros", F.unix_micros(col.ts.cast("timestamp"))).withColumn("symbol", (F.col("id") % 3).cast("string"))
    return ordered_scan(s, ["strategy"], ["ts", "id"], ["micros", "symbol", "equity"], lambda k: S.Guards(), "micros long, symbol string, allowed boolean, reason string")


@add("T10_daily_summary", f"WITH e AS (SELECT ts::DATE AS day, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT date_trunc('minute', ts)) AS minutes FROM events GROUP BY 1) SELECT day, events, errors, minutes, CASE WHEN events = 0 THEN 'offline' WHEN minutes < 60 THEN 'stale' WHEN errors / events > 0.25 THEN 'degraded' ELSE 'healthy' END AS health FROM e")
def t10(spark, sf_dir):
    e = scan(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct(F.date_trunc("minute", "ts")).alias("minutes"))
    return e.withColumn("health", L.health(F.col("events"), F.col("errors"), F.col("minutes") < 60))


@add("T12_recent_orders", "SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def t12(spark, sf_dir):
    top = scan(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(30)
    return top.join(scan(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "c_name")


@add("T13_cost_vs_edge", f"WITH {TRADES} SELECT symbol, {sql_rounded({'edge_bps': 'avg(ret) * 1e4 + 20', 'cost_share': '20 / nullif(avg(ret) * 1e4 + 20, 0)'}, 4)}, count(*) AS trades FROM trades GROUP BY 1")
def t13(spark, sf_dir):
    edge = F.avg("ret") * 1e4 + 20
    return vector_trades(spark, sf_dir).groupBy("symbol").agg(*rounded({"edge_bps": edge, "cost_share": 20 / F.nullif(edge, F.lit(0.0))}, 4), F.count("*").alias("trades"))


# SP: supporting operators
@add("SP1_depth_imbalance", f"WITH x AS (SELECT event_id, [value, value / 2, value / 4] AS b, [user_id::DOUBLE, 3.0, 2.0] AS a FROM events) SELECT event_id, {sql_rounded({'imbalance': 'coalesce((list_sum(b[1:2]) - list_sum(a[1:2])) / nullif(list_sum(b[1:2]) + list_sum(a[1:2]), 0), 0)'})} FROM x")
def sp1(spark, sf_dir):
    """Bid against ask sizes of the first levels of a JSON book; 0 for an empty one."""
    v, u = F.col("value"), F.col("user_id").cast("double")
    price_qty = lambda qs: F.to_json(F.array(*[F.array(F.lit("1"), q.cast("string")) for q in qs]))
    x = scan(spark, sf_dir, "events").select("event_id", price_qty([v, v / 2, v / 4]).alias("bids"), price_qty([u, F.lit(3.0), F.lit(2.0)]).alias("asks"))
    top = lambda c: F.aggregate(F.slice(F.from_json(c, "array<array<string>>"), 1, 2), F.lit(0.0), lambda acc, p: acc + p[1].cast("double"))
    b, a = top("bids"), top("asks")
    return x.select("event_id", *rounded({"imbalance": F.coalesce((b - a) / F.nullif(b + a, F.lit(0.0)), F.lit(0.0))}))


@add("SP2_epoch_ms", "SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts FROM events")
def sp2(spark, sf_dir):
    ms = F.floor(F.unix_micros(col.ts.cast("timestamp")) / 1000).cast("long")
    return scan(spark, sf_dir, "events").select("event_id", F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"))


@add("SP3_hour_of_week", "SELECT event_id, ((isodow(ts) - 1) * 24 + hour(ts))::INT AS how FROM events")
def sp3(spark, sf_dir):
    return scan(spark, sf_dir, "events").select("event_id", (F.weekday("ts") * 24 + F.hour("ts")).alias("how"))


@add("SP4_monotonic_guard", f"WITH {DAILY} SELECT symbol, count(*) FILTER (ts <= p) AS bad FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) GROUP BY 1")
def sp4(spark, sf_dir):
    x = daily_bars(spark, sf_dir).withColumn("p", F.lag("ts").over(I.series()))
    return x.groupBy("symbol").agg(F.count_if(col.ts <= F.col("p")).alias("bad"))


@add("SP5_cost_sensitivity", "SELECT p_brand, m AS multiple, (p_n * 20::DOUBLE * m) AS round_trip FROM (SELECT p_brand, count(*) AS p_n FROM part GROUP BY 1), (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) v(m)")
def sp5(spark, sf_dir):
    n = scan(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    times = F.explode(F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0))).alias("multiple")
    return n.select("p_brand", "n", times).select("p_brand", "multiple", (F.col("n") * 20.0 * F.col("multiple")).alias("round_trip"))


@add("SP8_deployment_gate", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2)")
def sp8(spark, sf_dir):
    """Verdict passed, not for research only, venue feasible."""
    venues = scan(spark, sf_dir, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return scan(spark, sf_dir, "customer").where("c_acctbal > 0 AND c_mktsegment <> 'BUILDING'").join(venues, "c_nationkey", "left_semi").select("c_custkey")


@add("SP9_conditional_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus = 'O' THEN 'CLOSED' ELSE o_orderstatus END AS status FROM orders")
def sp9(spark, sf_dir):
    close = (F.col("o_orderkey") % 10 == 0) & (F.col("o_orderstatus") == "O")
    return scan(spark, sf_dir, "orders").select("o_orderkey", F.when(close, "CLOSED").otherwise(F.col("o_orderstatus")).alias("status"))


@add("SP23_last_n_candles", f"WITH {DAILY} SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50")
def sp23(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(col.ts.desc()))
    return daily_bars(spark, sf_dir).select("symbol", "ts", "close", k.alias("k")).where("k <= 50").drop("k")


@add("SP24_portfolio_state", "SELECT o_custkey, count(*) AS open_n, max(o_orderdate) AS last_ts FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def sp24(spark, sf_dir):
    return scan(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count("*").alias("open_n"), F.max("o_orderdate").alias("last_ts"))


@add("SP27_metric_extraction", "SELECT event_type, avg(json_extract_string(props, '$.k')::DOUBLE)::DECIMAL(18,6)::DOUBLE AS k FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def sp27(spark, sf_dir):
    e = scan(spark, sf_dir, "events")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).where(col.ts >= F.col("now") - F.expr("INTERVAL 7 DAYS"))
    return e.groupBy("event_type").agg(F.avg(F.get_json_object("props", "$.k").cast("double")).cast("decimal(18,6)").cast("double").alias("k"))


@add("SP29_failure_streak", "WITH x AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, max(n)::BIGINT AS streak FROM (SELECT user_id, k, count(*) AS n FROM x WHERE bad GROUP BY 1, 2) GROUP BY 1")
def sp29(spark, sf_dir):
    bad = F.col("event_type") == "error"
    x = scan(spark, sf_dir, "events").withColumn("bad", bad)
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("ts", "event_id"))
    return x.withColumn("k", k).where("bad").groupBy("user_id", "k").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("streak"))


@add("SP30_template_levels", f"WITH {DAILY} SELECT symbol, ts, CASE WHEN high - low > 0 AND close - 2 * (high - low) > 0 THEN close - 2 * (high - low) END AS stop, close + 2 * (close - (close - 2 * (high - low))) AS target FROM bars")
def sp30(spark, sf_dir):
    c, r = F.col("close"), F.col("high") - F.col("low")
    stop = c - 2 * r
    return daily_bars(spark, sf_dir).select("symbol", "ts", F.when((r > 0) & (stop > 0), stop).alias("stop"), (c + 2 * (c - stop)).alias("target"))


@add("SP31_last_decision", "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS decision, 'order ' || max(o_orderkey) AS note FROM orders GROUP BY 1")
def sp31(spark, sf_dir):
    return scan(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("decision"), F.format_string("order %d", F.max("o_orderkey")).alias("note"))


@add("SP32_decision_listing", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def sp32(spark, sf_dir):
    return scan(spark, sf_dir, "events").orderBy(col.ts.desc(), F.col("event_id").desc()).limit(40).select("event_id", "event_type")


@add("SP33_flag_update", "SELECT n_nationkey, n_nationkey % 4 <> 0 OR n_nationkey = 8 AS enabled FROM nation")
def sp33(spark, sf_dir):
    n = scan(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 4 != 0).alias("enabled"))
    return n.withColumn("enabled", F.when(F.col("n_nationkey") == 8, True).otherwise(F.col("enabled")))


@add("SP34_recent_errors", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 15")
def sp34(spark, sf_dir):
    return scan(spark, sf_dir, "events").where("event_type = 'error'").orderBy(col.ts.desc(), F.col("event_id").desc()).limit(15).select("event_id", "user_id")
