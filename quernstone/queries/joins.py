"""Joins. The ledger's tables are played by orders (orders), lineitem (fills), customer (signals) and nation (versions)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import indicators as I
from quernstone.operators import chunked
from quernstone.operators import joins as J
from quernstone.queries.registry import add, col, rounded, sql_rounded
from quernstone.queries.windows import BOOK, PAIRS, W, book, legs, pairs, sd, sma
from quernstone.sources.bars import DAILY, HOURLY, ORDERS, daily_bars, event_bars, events_sql, order_bars, resample, scan
from quernstone.sources.store import absent



@add(
    "J1_timeframe_align",
    f"""WITH {HOURLY}, {events_sql(14400, 'h4')}, r AS (SELECT symbol, ts + INTERVAL 4 HOUR AS done, {sma('close', 3)} AS mean FROM h4)
SELECT b.symbol, b.ts, {sql_rounded({'mean': 'r.mean'})} FROM bars b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.ts >= r.done""",
)
def timeframe_align(spark, sf_dir):
    """A longer bar's value is seen only once that bar has closed."""
    hourly = event_bars(spark, sf_dir)
    slow = resample(hourly, 14400).select("symbol", (col.ts + F.expr("INTERVAL 4 HOURS")).alias("done"), I.sma(col.close, 3).alias("mean"))
    return J.asof(hourly.select("symbol", "ts"), slow, ["symbol"], "ts", "done", ["mean"]).select("symbol", "ts", *rounded({"mean": F.col("mean")}))


FUNDING = f"funding AS (SELECT symbol, ts, (close - ({sma('close', 10)})) / nullif({sd('close', 10)}, 0) AS z FROM bars WHERE isodow(ts) IN (1, 3, 5))"


@add("J2_funding_asof", f"WITH {ORDERS}, {FUNDING} SELECT b.symbol, b.ts, {sql_rounded({'z': 'f.z'})} FROM bars b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.ts >= f.ts")
def funding_asof(spark, sf_dir):
    bars = order_bars(spark, sf_dir)
    funding = bars.where(F.weekday("ts").isin(0, 2, 4)).select("symbol", "ts", I.zscore(col.close, 10).alias("z"))
    return J.asof(bars.select("symbol", "ts"), funding, ["symbol"], "ts", "ts", ["z"]).select("symbol", "ts", *rounded({"z": F.col("z")}))


@add("W26_funding_z", f"WITH {ORDERS}, {FUNDING} SELECT symbol, ts, {sql_rounded({'z': 'z'})} FROM funding")
def funding_z(spark, sf_dir):
    return order_bars(spark, sf_dir).where(F.weekday("ts").isin(0, 2, 4)).select("symbol", "ts", *rounded({"z": I.zscore(col.close, 10)}))


@add("J3_grid_intersection", f"WITH {DAILY}, {PAIRS} SELECT pair, ts, a, b FROM legs")
def grid_intersection(spark, sf_dir):
    """Both legs of each pair where both have a bar."""
    bars = daily_bars(spark, sf_dir)
    return legs(bars, pairs(bars))


@add("J4_left_reindex", f"WITH {DAILY}, o AS ({'WITH ' + ORDERS + ' SELECT * FROM bars'}) SELECT b.symbol, b.ts, b.close, o.close AS mark FROM bars b LEFT JOIN o ON o.ts = b.ts AND o.symbol = '1-URGENT'")
def left_reindex(spark, sf_dir):
    mark = order_bars(spark, sf_dir).where(F.col("symbol") == "1-URGENT").select("ts", col.close.alias("mark"))
    return daily_bars(spark, sf_dir).select("symbol", "ts", "close").join(mark, "ts", "left")


FOLDS = "folds AS (SELECT i AS fold, TIMESTAMP '1996-01-01' + INTERVAL (i * 90) DAY AS start, TIMESTAMP '1996-01-01' + INTERVAL (i * 90 + 180) DAY AS \"end\" FROM range(12) t(i))"


def folds(spark):
    day = lambda n: F.expr(f"timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval({n})")
    return spark.range(12).select(F.col("id").alias("fold"), day("cast(id * 90 as int)").alias("start"), day("cast(id * 90 + 180 as int)").alias("end"))


@add("J5_bars_in_folds", f"WITH {DAILY}, {FOLDS} SELECT fold, symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars JOIN folds ON ts >= start AND ts < \"end\" GROUP BY ALL")
def bars_in_folds(spark, sf_dir):
    held = J.in_windows(daily_bars(spark, sf_dir), folds(spark), "ts", "start", "end")
    return held.groupBy("fold", "symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


MEMBERS = "members AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS month, sum(close * volume) > 100000 AS member FROM bars GROUP BY 1, 2)"


@add("J6_universe_membership", f"WITH {DAILY}, {MEMBERS} SELECT b.symbol, b.ts, m.member FROM bars b ASOF LEFT JOIN members m ON b.symbol = m.symbol AND b.ts >= m.month")
def universe_membership(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    month = F.date_trunc("month", "ts").cast("timestamp_ntz")
    members = bars.groupBy("symbol", month.alias("month")).agg((F.sum(col.close * F.col("volume")) > 100_000).alias("member"))
    return J.asof(bars.select("symbol", "ts"), members, ["symbol"], "ts", "month", ["member"])


@add("J7_strict_past_asof", f"WITH {DAILY}, r AS (SELECT symbol, ts, close > ({sma('close', 20)}) AS up FROM bars) SELECT b.symbol, b.ts, r.up FROM bars b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.ts > r.ts")
def strict_past_asof(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    state = bars.select("symbol", "ts", (col.close > I.sma(col.close, 20)).alias("up"))
    return J.asof(bars.select("symbol", "ts"), state, ["symbol"], "ts", "ts", ["up"], strict=True)


@add("J8_hour_of_week", f"WITH {HOURLY}, m AS (SELECT (isodow(ts) - 1) * 24 + hour(ts) AS how, median(volume) AS typical FROM bars GROUP BY 1) SELECT symbol, ts, how::INT AS how, typical FROM bars JOIN m ON how = (isodow(ts) - 1) * 24 + hour(ts)")
def hour_of_week(spark, sf_dir):
    bars = event_bars(spark, sf_dir).withColumn("how", F.weekday("ts") * 24 + F.hour("ts"))
    typical = bars.groupBy("how").agg(F.median("volume").alias("typical"))  # 168 rows at most
    return bars.join(F.broadcast(typical), "how").select("symbol", "ts", "how", "typical")


@add("J9_book_at_trade", f"WITH {BOOK}, q AS (SELECT symbol, ts, last(bid ORDER BY event_id) AS bid, last(ask ORDER BY event_id) AS ask FROM book GROUP BY 1, 2) SELECT t.event_id AS trade_id, q.bid, q.ask FROM book t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts > q.ts")
def book_at_trade(spark, sf_dir):
    """The book just before each trade; updates of one instant count as the last of them."""
    b = book(spark, sf_dir)
    quotes = b.groupBy("symbol", "ts").agg(F.max_by("bid", "event_id").alias("bid"), F.max_by("ask", "event_id").alias("ask"))
    trades = b.select(F.col("event_id").alias("trade_id"), "symbol", "ts")
    return chunked.asof(trades, quotes, ["symbol"], "ts", "ts", ["bid", "ask"], J.day_of("_t"), strict=True).select("trade_id", "bid", "ask")


@add("J10_trade_through", f"WITH {BOOK} SELECT l.event_id, min(r.ts) AS hit_ts FROM book l LEFT JOIN book r ON l.symbol = r.symbol AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 3600 SECOND AND r.ask <= l.bid GROUP BY l.event_id")
def trade_through(spark, sf_dir):
    b = book(spark, sf_dir)
    orders = b.select("event_id", "symbol", F.col("ts").alias("placed"), F.col("bid").alias("limit_px"))
    quotes = b.select("symbol", "ts", "ask")
    return J.within(orders, quotes, ["symbol"], "placed", "ts", 3600, "ask", "limit_px", "through", "event_id").select("event_id", F.col("through").alias("hit_ts"))


LEDGER = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"


def ledger(spark, sf_dir):
    """Fills with their orders, signals and versions; the versions are 25 rows."""
    l, o = scan(spark, sf_dir, "lineitem"), scan(spark, sf_dir, "orders")
    cu, n = scan(spark, sf_dir, "customer"), scan(spark, sf_dir, "nation")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(cu, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


@add("J11_position_chain", f"SELECT n.n_name, l.l_returnflag, count(*) AS positions, {sql_rounded({'notional': 'sum(l.l_extendedprice)'}, 2)} FROM {LEDGER} GROUP BY 1, 2")
def position_chain(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("n_name", "l_returnflag").agg(F.count("*").alias("positions"), *rounded({"notional": F.sum("l_extendedprice")}, 2))


@add("J12_pending_orders", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def pending_orders(spark, sf_dir):
    o = scan(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    cu, n = scan(spark, sf_dir, "customer"), scan(spark, sf_dir, "nation")
    return o.join(cu, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


CASH = "CASE WHEN l_linestatus = 'O' THEN -(l_extendedprice * (1 + l_tax)) ELSE l_extendedprice * (1 - l_tax) END"


@add("J13_net_cash", f"SELECT o_orderpriority, {sql_rounded({'net': f'sum({CASH})'}, 2)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def net_cash(spark, sf_dir):
    """Buys take cash with their fee, sells bring it without."""
    px, tax = F.col("l_extendedprice"), F.col("l_tax")
    cash = F.when(F.col("l_linestatus") == "O", -(px * (1 + tax))).otherwise(px * (1 - tax))
    joined = scan(spark, sf_dir, "lineitem").join(scan(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(*rounded({"net": F.sum(cash)}, 2))


@add("J14_latest_drift", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true")
def latest_drift(spark, sf_dir):
    newest = J.latest(scan(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return scan(spark, sf_dir, "customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@add("J15_paged_listing", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_listing(spark, sf_dir):
    o, cu, n = (scan(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    page = o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(100).limit(50)  # each order has one customer, so the page can be cut first
    return page.join(cu, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@add("J16_versions", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def versions(spark, sf_dir):
    return scan(spark, sf_dir, "nation").join(F.broadcast(scan(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@add("J17_insert_if_absent", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def insert_if_absent(spark, sf_dir):
    """Of several new rows of a key the first one is kept, whatever the layout."""
    new = scan(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderdate"])
    there = scan(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return absent(new, there, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@add("J18_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists(spark, sf_dir):
    o = scan(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return scan(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


POS = "pos AS (SELECT symbol || '-' || strftime(ts, '%Y%m%d') AS id, symbol, ts AS entry_ts, close * 0.9::DOUBLE AS stop, close FROM bars WHERE day(ts) = 1 AND month(ts) IN (1, 7))"


def positions(bars):
    return bars.where((F.dayofmonth("ts") == 1) & F.month("ts").isin(1, 7)).select(F.concat("symbol", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("id"), "symbol", col.ts.alias("entry_ts"), (col.close * 0.9).alias("stop"), "close")


@add("J19_first_stop_breach", f"WITH {DAILY}, {POS} SELECT id, min(b.ts) AS breach_ts, {sql_rounded({'breach_low': 'arg_min(b.low, b.ts)'})} FROM pos LEFT JOIN bars b ON b.symbol = pos.symbol AND b.ts >= entry_ts AND b.low <= stop GROUP BY id")
def first_stop_breach(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return J.first_breach(positions(bars), bars, "id").select("id", "breach_ts", *rounded({"breach_low": F.col("breach_low")}))


@add("J20_fill_candle", f"WITH {DAILY}, {POS} SELECT id, b.open AS fill_open FROM pos LEFT JOIN bars b ON b.symbol = pos.symbol AND b.ts = entry_ts + INTERVAL 1 DAY")
def fill_candle(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    p = positions(bars).withColumn("ts", F.col("entry_ts") + F.expr("INTERVAL 1 DAY"))
    return p.join(bars.select("symbol", "ts", F.col("open").alias("fill_open")), ["symbol", "ts"], "left").select("id", "fill_open")


@add("J21_latest_mark", f"WITH {DAILY}, {POS}, m AS (SELECT symbol, arg_max(close, ts) AS mark FROM bars WHERE symbol <> 'AF' GROUP BY 1) SELECT id, coalesce(mark, close) AS mark FROM pos LEFT JOIN m USING (symbol)")
def latest_mark(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    marks = bars.where("symbol <> 'AF'").groupBy("symbol").agg(F.max_by("close", "ts").alias("mark"))
    return positions(bars).join(marks, "symbol", "left").select("id", F.coalesce("mark", "close").alias("mark"))


@add("J22_symbol_intersection", "SELECT n_name, list_sort(list_intersect(['AF', 'NO', 'RF'], CASE WHEN n_regionkey % 2 = 0 THEN ['NO', 'RF', 'AO'] ELSE ['AF'] END)) AS symbols FROM nation")
def symbol_intersection(spark, sf_dir):
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    own = F.when(F.col("n_regionkey") % 2 == 0, lit(["NO", "RF", "AO"])).otherwise(lit(["AF"]))
    return scan(spark, sf_dir, "nation").select("n_name", F.array_sort(F.array_intersect(lit(["AF", "NO", "RF"]), own)).alias("symbols"))


@add("U4_symbol_set", "SELECT n_name, len(list_intersect(['AF', 'NO'], CASE WHEN n_regionkey > 1 THEN ['NO', 'RF'] ELSE ['RF'] END)) AS n FROM nation")
def symbol_set(spark, sf_dir):
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    own = F.when(F.col("n_regionkey") > 1, lit(["NO", "RF"])).otherwise(lit(["RF"]))
    return scan(spark, sf_dir, "nation").select("n_name", F.size(F.array_intersect(lit(["AF", "NO"]), own)).cast("long").alias("n"))


@add("J23_parameter_grid", "SELECT r_name, f.i AS fast, s.i AS slow, f.i * 10 + s.i AS cell FROM region, range(5, 20, 5) f(i), range(20, 60, 20) s(i) WHERE f.i < s.i")
def parameter_grid(spark, sf_dir):
    """A strategy's parameter axes: a product of a few dimension rows, not of data."""
    fast, slow = spark.range(5, 20, 5).withColumnRenamed("id", "fast"), spark.range(20, 60, 20).withColumnRenamed("id", "slow")
    grid = scan(spark, sf_dir, "region").select("r_name").crossJoin(F.broadcast(fast)).crossJoin(F.broadcast(slow))
    return grid.where("fast < slow").withColumn("cell", F.col("fast") * 10 + F.col("slow"))


CELLS = "cells AS (SELECT (p_size % 8)::BIGINT AS x, (p_partkey % 6)::BIGINT AS y, round(avg(p_retailprice), 6) AS v FROM part GROUP BY 1, 2)"


def cells(spark, sf_dir):
    p = scan(spark, sf_dir, "part", ["p_size", "p_partkey", "p_retailprice"])
    return p.groupBy((F.col("p_size") % 8).cast("long").alias("x"), (F.col("p_partkey") % 6).alias("y")).agg(F.round(F.avg("p_retailprice"), 6).alias("v"))


@add("J24_cell_neighbours", f"WITH {CELLS} SELECT a.x, a.y, {sql_rounded({'neighbour_avg': 'avg(b.v) + 1e-9'}, 4)}, count(b.v) AS neighbours FROM cells a JOIN cells b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2")
def cell_neighbours(spark, sf_dir):
    return J.neighbours(cells(spark, sf_dir), ["x", "y"], "v").select("x", "y", *rounded({"neighbour_avg": F.col("neighbour_avg") + 1e-9}, 4), "neighbours")  # so that ties go up in any summing order


@add("W21_markouts", f"WITH {BOOK}, m AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS ts, last((bid + ask) / 2 ORDER BY ts, event_id) AS mid FROM book GROUP BY 1, 2) SELECT symbol, ts, {sql_rounded({'after_1': f'lead(mid, 1) {W} - mid', 'after_3': f'lead(mid, 3) {W} - mid'})} FROM m")
def markouts(spark, sf_dir):
    """Move of the mid after 1 and 3 steps of the grid."""
    from quernstone.sources.bars import bin_start

    mid = book(spark, sf_dir).groupBy("symbol", bin_start(col.ts, 3600).alias("bar")).agg(F.max_by((F.col("bid") + F.col("ask")) / 2, F.struct("ts", "event_id")).alias("mid")).withColumnRenamed("bar", "ts")
    return mid.select("symbol", "ts", *rounded({f"after_{n}": F.lead("mid", n).over(I.series()) - F.col("mid") for n in (1, 3)}))


@add("W27_latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    return J.latest(scan(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


# U: set operations
@add("U1_union_keep_first", "SELECT key, src, price FROM (SELECT o_orderkey AS key, 0 AS src, o_totalprice AS price FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT o_orderkey, 1, -o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P')) QUALIFY row_number() OVER (PARTITION BY key ORDER BY src) = 1")
def union_keep_first(spark, sf_dir):
    o = scan(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"]).withColumnsRenamed({"o_orderkey": "key", "o_totalprice": "price"})
    first = o.where("o_orderstatus IN ('F', 'O')").select("key", "price", F.lit(0).alias("src"))
    both = first.unionByName(o.where("o_orderstatus IN ('O', 'P')").select("key", (-F.col("price")).alias("price"), F.lit(1).alias("src")))
    return both.groupBy("key").agg(F.min_by(F.struct("src", "price"), "src").alias("r")).select("key", "r.src", "r.price")


@add("U2_index_intersection", f"WITH {DAILY}, {PAIRS} SELECT a || '/' || b AS pair, ts FROM pr JOIN bars ON symbol = a INTERSECT SELECT a || '/' || b AS pair, ts FROM pr JOIN bars ON symbol = b")
def index_intersection(spark, sf_dir):
    """The times that both symbols of a pair have."""
    bars = daily_bars(spark, sf_dir)
    named = pairs(bars).withColumn("pair", F.concat("a", F.lit("/"), "b"))
    times = lambda leg: bars.join(named.select("pair", F.col(leg).alias("symbol")), "symbol").select("pair", "ts")
    return times("a").intersect(times("b"))


@add("U3_first_touch", f"WITH {DAILY}, {FOLDS} SELECT symbol, ts, min(fold) AS fold FROM bars JOIN folds ON ts >= start AND ts < \"end\" GROUP BY 1, 2")
def first_touch(spark, sf_dir):
    """Of overlapping folds the first one that holds a bar keeps it."""
    return J.in_windows(daily_bars(spark, sf_dir), folds(spark), "ts", "start", "end").groupBy("symbol", "ts").agg(F.min("fold").alias("fold"))


@add("U5_merged_log", "SELECT * FROM (SELECT ts, 'event' AS kind, event_id AS id FROM events WHERE event_type = 'error' UNION ALL SELECT o_orderdate, 'order', o_orderkey FROM orders WHERE o_orderstatus = 'P') ORDER BY ts DESC, kind, id LIMIT 20")
def merged_log(spark, sf_dir):
    e = scan(spark, sf_dir, "events").where("event_type = 'error'").select("ts", F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    o = scan(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderdate").alias("ts"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return e.unionByName(o).orderBy(F.col("ts").desc(), "kind", "id").limit(20)


@add("U6_schema_difference", """WITH k AS (SELECT event_type, unnest(json_keys(props)) AS name FROM events WHERE props IS NOT NULL), a AS (SELECT DISTINCT event_type, name FROM k), e AS (SELECT DISTINCT event_type FROM events),
w AS (SELECT event_type, unnest(['k', 'reason', 'symbol']) AS name FROM e)
SELECT coalesce(a.event_type, w.event_type) AS event_type, coalesce(a.name, w.name) AS name, CASE WHEN w.name IS NULL THEN 'not in the target' ELSE 'not in the source' END AS side FROM a FULL JOIN w ON a.event_type = w.event_type AND a.name = w.name WHERE a.name IS NULL OR w.name IS NULL""")
def schema_difference(spark, sf_dir):
    """Fields that the rows of a kind have and a target lacks, and the other way round, read off the rows themselves."""
    e = scan(spark, sf_dir, "events", ["event_type", "props"])
    there = e.where("props IS NOT NULL").select("event_type", F.explode(F.json_object_keys("props")).alias("name")).distinct()
    target = e.select("event_type").distinct().select("event_type", F.explode(F.array(*[F.lit(x) for x in ("k", "reason", "symbol")])).alias("name"))
    tell = lambda df, side: df.withColumn("side", F.lit(side))
    both = ["event_type", "name"]
    return tell(there.join(target, both, "left_anti"), "not in the target").unionByName(tell(target.join(there, both, "left_anti"), "not in the source"))


@add("U7_eligible_set", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def eligible_set(spark, sf_dir):
    return scan(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_nationkey", "c_mktsegment").distinct()
