"""Strategy documents and position simulators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import conditions as C
from quernstone.functions import indicators as I
from quernstone.operators import engines as G
from quernstone.operators import simulators as S
from quernstone.operators.indicator_scan import walked_indicators, with_indicators
from quernstone.operators.cooldown import picked
from quernstone.operators.joins import asof
from quernstone.operators.rangerank import with_matched_percentile
from quernstone.operators.sequential import ordered_scan
from quernstone.operators.speculative import long_chunks, speculative_scan
from quernstone.plans import spec as P
from quernstone.queries.aggregates import BPS, SIG, TRADES, signals, vector_run, vector_trades
from quernstone.queries.joins import book
from quernstone.queries.registry import add, col, rounded, sql_rounded
from quernstone.queries.windows import RUN, W, sma
from quernstone.sources.bars import DAILY, HOURLY, daily_bars, event_bars, scan

OHLCV = ("open", "high", "low", "close", "volume")


def ind(name, component=None, **params):
    return {"kind": "indicator", "name": name, "params": params} | ({"component": component} if component else {})


PRICE = {"kind": "price", "field": "close"}
BASE = {"schema_version": "2.0", "primary_timeframe": "1d", "position_sizing": {"mode": "fixed_percent_equity", "percent": 1.0}}
CROSS = {"type": "crossover", "series": ind("sma", period=10), "threshold": ind("sma", period=30), "direction": "above"}
UNCROSS = CROSS | {"direction": "below"}
GOLDEN = BASE | {"entry": {"condition": CROSS}, "exit": {"exits": [{"type": "condition", "condition": UNCROSS}]}}
STOPPED = BASE | {
    "entry": {"condition": {"type": "and", "conditions": [{"type": "compare", "left": PRICE, "op": ">", "right": ind("ema", period=20)}, {"type": "rsi", "period": 14, "threshold": 60, "comparison": "above"}]}},
    "exit": {"exits": [{"type": "stop_loss", "method": {"kind": "trailing_atr", "atr_period": 14, "mult": 2.0}}, {"type": "take_profit", "method": {"kind": "percent", "value": 0.3}}, {"type": "time", "max_bars_held": 15}]},
    "position_sizing": {"mode": "risk_based", "risk_percent": 0.02},
    "filters": [{"type": "weekday", "days": [1, 2, 3, 4, 5]}],
}
REGIME = BASE | {
    "entry": {"condition": {"type": "regime_state", "enter_when": CROSS, "exit_when": UNCROSS}},
    "exit": {"exits": [{"type": "condition", "condition": {"type": "not", "condition": {"type": "regime_state", "enter_when": CROSS, "exit_when": UNCROSS}}}]},
}
GATED = GOLDEN | {"entry": {"condition": {"type": "and", "conditions": [CROSS, {"type": "not", "condition": {"type": "prior_trade", "predicate": "consecutive_losses_at_least", "n": 6}}]}}}
SHADOWED = GOLDEN | {"entry": {"condition": {"type": "and", "conditions": [CROSS, {"type": "prior_signal", "predicate": "last_would_have_lost"}]}}}
SLOW = {"primary_timeframe": "1h", "filter_timeframe": "4h", "schema_version": "1.0", "entry": {"condition": {"type": "and", "conditions": [{"type": "compare", "left": PRICE, "op": ">", "right": ind("sma", period=5), "timeframe": "4h"}, {"type": "compare", "left": PRICE, "op": ">", "right": ind("sma", period=10)}]}}, "exit": {"exits": [{"type": "time", "max_bars_held": 6}]}}


def trades(name: str, spec: dict, bars=daily_bars) -> None:
    @add(name)
    def query(spark, sf_dir):
        found = P.backtest(spec, bars(spark, sf_dir))
        return found.select("symbol", "entry_ts", "fill_ts", "exit_ts", *rounded({k: F.col(k) for k in ("entry_price", "exit_price", "size", "pnl", "ret")}), "reason")


trades("B2_iterative_engine", STOPPED)
trades("B2a_sizing", STOPPED | {"position_sizing": {"mode": "fixed_quantity", "quantity": 3}})
trades("B2b_levels", GOLDEN | {"exit": {"exits": [{"type": "stop_loss", "method": {"kind": "percent", "value": 0.1}}, {"type": "take_profit", "method": {"kind": "r_multiple", "r": 2.0}}]}})
trades("B2c_phantom", SHADOWED)
trades("B18_regime_template", REGIME)
trades("P11_prior_trade", GATED)
trades("P12_prior_signal", SHADOWED)
trades("SP6_multi_timeframe", SLOW, event_bars)

# the document compiled to columns must say what its SQL says
X = f"(SELECT *, {sma('close', 10)} AS f, {sma('close', 30)} AS s FROM bars)"


@add("D9_spec_signals", f"WITH {DAILY} SELECT symbol, ts, coalesce(lag(f) {W} <= lag(s) {W} AND f > s, false) AS entry, coalesce(lag(f) {W} >= lag(s) {W} AND f < s, false) AS leave FROM {X}")
def d9(spark, sf_dir):
    return P.signals(GOLDEN, daily_bars(spark, sf_dir))[0].select("symbol", "ts", "entry", "leave")


def engine_trades(side: int = 1, fee: float = 0.001, slip: float = 0.0005) -> str:
    """The trades of GOLDEN in SQL: next-open fills, costs on both sides, what is open at the end valued at the last close."""
    ins, outs = f"(1 + {side} * {slip}::DOUBLE)", f"(1 - {side} * {slip}::DOUBLE)"
    paid, got = f"entry_price * (1 + {side} * {fee}::DOUBLE)", f"exit_price * (1 - {side} * {fee}::DOUBLE)"
    return f"""WITH {DAILY}, g AS (SELECT *, coalesce(lag(f) {W} <= lag(s) {W} AND f > s, false) AS x, coalesce(lag(f) {W} >= lag(s) {W} AND f < s, false) AS y,
  lead(open) {W} AS nopen, lead(ts) {W} AS nts FROM {X}), l AS (SELECT symbol, max(ts) AS lts, arg_max(close, ts) AS lc FROM bars GROUP BY 1),
y AS (SELECT symbol, ts, nopen, nts FROM g WHERE y AND nts IS NOT NULL),
t AS (SELECT g.symbol, g.ts AS entry_ts, g.nts AS fill_ts, min(y.ts) AS yts FROM g LEFT JOIN y ON y.symbol = g.symbol AND y.ts > g.ts WHERE g.x AND g.nts IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT t.symbol, t.entry_ts, t.fill_ts, coalesce(y.nts, lts) AS exit_ts, (SELECT any_value(nopen) FROM g WHERE g.symbol = t.symbol AND g.ts = t.entry_ts) * {ins} AS entry_price,
  coalesce(y.nopen, lc) * {outs} AS exit_price, CASE WHEN y.nts IS NULL THEN 'end_of_data' ELSE 'signal' END AS reason FROM t JOIN l USING (symbol) LEFT JOIN y ON y.symbol = t.symbol AND y.ts = t.yts)
SELECT symbol, entry_ts, fill_ts, exit_ts, reason, {sql_rounded({'ret': f'{side} * ({got} - {paid}) / ({paid})'}, 5)} FROM p"""


def golden_trades(spark, sf_dir, document, **kw):
    found = P.backtest(document, daily_bars(spark, sf_dir), **kw)
    return found.select("symbol", "entry_ts", "fill_ts", "exit_ts", "reason", *rounded({"ret": F.col("ret")}, 5))


@add("B1_signal_engine", engine_trades())
def b1(spark, sf_dir):
    """A document's signals simulated, against its trades written out in SQL."""
    return golden_trades(spark, sf_dir, GOLDEN)


@add("B1_short_document", engine_trades(side=-1))
def b1_short(spark, sf_dir):
    """The same document sold short: it gains where prices fall, and pays costs on both sides all the same.

    It sells a small quantity each time, as these prices jump and a short sale can lose far more than it brings in.
    """
    return golden_trades(spark, sf_dir, GOLDEN | {"direction": "short", "position_sizing": {"mode": "fixed_quantity", "quantity": 0.0001}})


@add("B1_stated_costs", engine_trades(fee=0.002, slip=0.001))
def b1_costs(spark, sf_dir):
    """The document traded at the costs that it states itself."""
    return golden_trades(spark, sf_dir, GOLDEN | {"costs": {"commission_pct": 0.002, "slippage_pct": 0.001}}, stated_costs=True)


@add("SP15_venue_costs", engine_trades(fee=0.0026, slip=0.0008))
def sp15(spark, sf_dir):
    """Costs resolved from the venue's table; what the document states is its author's assumption only."""
    document = GOLDEN | {"instrument": {"symbol": "BTC/USDT", "exchange": "kraken"}, "costs": {"commission_pct": 0.01}}
    return golden_trades(spark, sf_dir, document, fees={("kraken", "BTC/USDT"): (0.0026, 0.0008)})


@add("F7_entry_order", engine_trades())
def f7(spark, sf_dir):
    """A limit entry fills at the next open like a market one."""
    return golden_trades(spark, sf_dir, GOLDEN | {"entry": GOLDEN["entry"] | {"order_type": "limit", "limit_offset_pct": -0.001}})


VWAP = GOLDEN | {"entry": {"condition": {"type": "crossover", "series": PRICE, "threshold": ind("vwap", session_anchored=True), "direction": "above"}}}


@add("E3_vwap_document", f"""WITH {HOURLY}, v AS (SELECT *, sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0) AS v FROM bars WINDOW d AS (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, ts, coalesce(lag(close) {W} <= lag(v) {W} AND close > v, false) AS entry FROM v""")
def e3_vwap(spark, sf_dir):
    """The session's volume-weighted price as an indicator of a document."""
    return P.signals(VWAP | {"primary_timeframe": "1h"}, event_bars(spark, sf_dir))[0].select("symbol", "ts", "entry")


@add("F8_exit_rules", f"WITH {DAILY} SELECT symbol, ts, coalesce(lag(f) {W} >= lag(s) {W} AND f < s, false) OR isodow(ts) = 5 AS leave FROM {X}")
def f8(spark, sf_dir):
    spec = GOLDEN | {"exit": {"exits": [{"type": "condition", "condition": UNCROSS}, {"type": "condition", "condition": {"type": "day_of_week", "weekdays": [4]}}]}}
    return P.signals(spec, daily_bars(spark, sf_dir))[0].select("symbol", "ts", "leave")


def documents(spark, sf_dir):
    """A document for each part: two averages and a stop whose numbers are the part's, some beyond what is allowed."""
    k, size = F.col("p_partkey"), F.col("p_size")
    average = lambda n: F.concat(F.lit('{"kind":"indicator","name":"sma","params":{"period":'), n.cast("string"), F.lit("}}"))
    condition = lambda side: F.concat(F.lit('{"type":"crossover","series":'), average(size * 12), F.lit(',"threshold":'), average(size % 7 + 1), F.lit(f',"direction":"{side}"}}'))
    stop = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(',{"type":"stop_loss","method":{"kind":"percent","value":'), (k % 30 / 100 + 0.01).cast("decimal(4,2)").cast("string"), F.lit("}}")))
    sizing = F.when(k % 5 == 0, ',"position_sizing":{"mode":"risk_based","risk_percent":0.01}').otherwise("")
    text = F.concat(
        F.lit('{"schema_version":"'), F.when(k % 2 == 0, "2.0").otherwise("1.0"), F.lit('","primary_timeframe":"1d","direction":"'), F.when(k % 11 == 0, "sideways").otherwise("short"),
        F.lit('","entry":{"condition":{"type":"regime_state","enter_when":'), condition("above"), F.lit(',"exit_when":'), condition("below"),
        F.lit('},"order_type":"market"},"exit":{"exits":[{"type":"time","max_bars_held":5}'), stop, F.lit("]}"), sizing, F.lit("}"),
    )
    # a few MB of parts make documents a hundred times as long: dealt out before that, or a task or two would read them all
    return scan(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey").select("p_partkey", F.when(k % 17 == 0, "no document").otherwise(text).alias("document"))


@add("SP12_spec_checks", """SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 THEN 2 END AS tier, CASE WHEN p_partkey % 17 <> 0 THEN 1 + greatest(p_size * 12, p_size % 7 + 1) END AS warm_up,
CASE WHEN p_partkey % 17 = 0 THEN 'not_json' ELSE array_to_string(list_concat(list_concat(
 CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN ['risk_based_requires_stop_loss'] ELSE [] END, CASE WHEN p_partkey % 11 = 0 THEN ['direction_unknown'] ELSE [] END),
 list_concat(CASE WHEN p_partkey % 2 = 1 THEN ['stateful_requires_schema_v2'] ELSE [] END,
 [x FOR x IN ['indicator_param_out_of_bounds', 'indicator_param_out_of_bounds', 'indicator_param_out_of_bounds', 'indicator_param_out_of_bounds']][1:2 * ((p_size * 12 > 500)::INT + (p_size % 7 = 0)::INT)])), ',') END AS errors FROM part""")
def sp12(spark, sf_dir):
    """Tier, warm-up and errors of documents that are rows."""
    return P.checked(documents(spark, sf_dir), "document").select("p_partkey", "tier", "warm_up", "errors")


@add("E8_per_trade_ratchet", f"WITH {TRADES}, r AS (SELECT *, sum(entered::INT) {RUN} AS trade FROM run) SELECT symbol, ts, max(high) OVER (PARTITION BY symbol, trade ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM r WHERE held = 1")
def e8(spark, sf_dir):
    """Running extremum since the trade's entry."""
    run = vector_run(spark, sf_dir).withColumn("trade", F.sum(F.col("entered").cast("int")).over(I.running(I.series()))).where("held = 1")
    return run.select("symbol", "ts", F.max("high").over(I.running(Window.partitionBy("symbol", "trade").orderBy("ts"))).alias("top"))


@add("B4_exit_attribution", f"WITH {TRADES} SELECT symbol, entry_ts, CASE WHEN abs(exit_price / (entry_price * 0.9::DOUBLE) - 1) <= 0.005 THEN 'stop_loss' WHEN abs(exit_price / (entry_price * 1.1::DOUBLE) - 1) <= 0.005 THEN 'take_profit' WHEN exit_ts - entry_ts >= INTERVAL 30 DAY THEN 'time' ELSE 'signal' END AS reason FROM trades")
def b4(spark, sf_dir):
    """The likely reason of an exit from its price alone, within half a per cent."""
    near = lambda k: F.abs(F.col("exit_price") / (F.col("entry_price") * k) - 1) <= 0.005
    long = F.col("exit_ts") - F.col("entry_ts") >= F.expr("INTERVAL 30 DAYS")
    return vector_trades(spark, sf_dir).select("symbol", "entry_ts", F.when(near(0.9), "stop_loss").when(near(1.1), "take_profit").when(long, "time").otherwise("signal").alias("reason"))


@add("B8_funding_cashflow", f"WITH {DAILY} SELECT symbol, ts, -(volume / 10) * close * ((day(ts) % 5 - 2) / 1e4::DOUBLE) AS flow FROM bars")
def b8(spark, sf_dir):
    rate = (F.dayofmonth("ts") % 5 - 2) / F.lit(1e4)
    return daily_bars(spark, sf_dir).select("symbol", "ts", (-(F.col("volume") / 10) * col.close * rate).alias("flow"))


def perp_shown(df):
    return df.select("symbol", "entry_ts", "exit_ts", "side", *rounded({k: F.col(k) for k in ("price_pnl", "funding_pnl", "cost", "net_pnl")}), "stamps", "reason")


def funded(bars):
    """A funding rate on three days a week, and a mark at the close."""
    return bars.withColumn("mark", col.close).withColumn("funding", F.when(F.weekday("ts").isin(0, 2, 4), (F.dayofmonth("ts") % 7 - 3) / 1e4))


@add("B5_perp_pair")
def b5(spark, sf_dir):
    bars = funded(daily_bars(spark, sf_dir))
    leg = lambda s, n: bars.where(F.col("symbol") == s).select("ts", F.col("open").alias(f"{n}o"), col.close.alias(f"{n}c"), F.col("mark").alias(f"{n}m"), F.col("funding").alias(f"{n}f"))
    pair = leg("AF", "a").join(leg("NO", "b"), "ts").withColumn("symbol", F.lit("AF/NO"))
    pair = pair.withColumn("z", I.zscore(F.ln("ac") - F.ln("bc"), 20))
    return perp_shown(ordered_scan(pair, ["symbol"], ["ts"], ["ts", "ao", "ac", "am", "af", "bo", "bc", "bm", "bf", "z"], lambda k: S.PairTrader(entry=1.5), S.PERP_TRADES))


@add("B6_perp_trend")
def b6(spark, sf_dir):
    x = walked_indicators(daily_bars(spark, sf_dir), {"f": ("ema", {"n": 10, "warm": False}), "m": ("ema", {"n": 30, "warm": False}), "s": ("ema", {"n": 60, "warm": False}), "atr": ("research_atr", {"n": 14})}, carry=OHLCV)
    f, m, s = (F.col(k) for k in "fms")
    x = funded(x).withColumn("regime", F.when((f > m) & (m > s), 1).when((f < m) & (m < s), -1).otherwise(0))
    return perp_shown(ordered_scan(x, ["symbol"], ["ts"], ["ts", "open", "high", "low", "close", "mark", "funding", "regime", "atr"], lambda k: S.TrendTrader(), S.PERP_TRADES))


@add("B7_perp_carry")
def b7(spark, sf_dir):
    x = funded(walked_indicators(daily_bars(spark, sf_dir), {"atr": ("research_atr", {"n": 14})}, carry=OHLCV))
    stamps = x.where("funding IS NOT NULL").select("symbol", "ts", I.zscore(F.col("funding"), 10).alias("z"))
    x = asof(x, stamps, ["symbol"], "ts", "ts", ["z"])
    return perp_shown(ordered_scan(x, ["symbol"], ["ts"], ["ts", "open", "high", "low", "close", "mark", "funding", "z", "atr"], lambda k: S.CarryTrader(), S.PERP_TRADES))


@add("B11_decimal_engine")
def b11(spark, sf_dir):
    out = ordered_scan(signals(spark, sf_dir), ["symbol"], ["ts"], ["ts", "open", "pos"], lambda k: S.DecimalBroker(), "ts timestamp_ntz, equity double, action string")
    return out.select("symbol", "ts", *rounded({"equity": F.col("equity")}, 4), "action")


@add("B12_trend_state")
def b12(spark, sf_dir):
    x = walked_indicators(daily_bars(spark, sf_dir), {"fast": ("ema", {"n": 20}), "slow": ("ema", {"n": 50}), "atr": ("research_atr", {"n": 14})}, carry=OHLCV)
    x = x.withColumn("top", I.highest(F.col("high"), 20)).withColumn("breakout", F.lag("top").over(I.series())).withColumn("member", F.col("volume") > 20)
    return ordered_scan(x, ["symbol"], ["ts"], ["ts", "close", "fast", "slow", "breakout", "atr", "member"], lambda k: S.TrendState(), "ts timestamp_ntz, inside int")


@add("B14_edge_gate")
def b14(spark, sf_dir):
    x = walked_indicators(daily_bars(spark, sf_dir), {"rsi": ("rsi", {"n": 14}), "atr": ("research_atr", {"n": 14})}, carry=OHLCV).where("rsi IS NOT NULL")
    x = x.withColumn("p", 0.3 + F.col("rsi") / 250).withColumn("edge", (2 * F.col("p") - 1) * F.col("atr") / col.close * 1e4).withColumn("ev", F.col("edge") - 20 - 5)
    return ordered_scan(x, ["symbol"], ["ts"], ["ts", "close", "p", "edge", "ev", "atr"], lambda k: S.EdgeGate(), "ts timestamp_ntz, action string, reason string, inside int")


@add("B15_overlay")
def b15(spark, sf_dir):
    x = signals(spark, sf_dir).withColumn("ok", C.sure(F.col("volume") > I.sma(F.col("volume"), 20)))
    return ordered_scan(x, ["symbol"], ["ts"], ["ts", "pos", "ok"], lambda k: S.Overlay(), "ts timestamp_ntz, pos int, verdict string")


HOW = "(SELECT *, isodow(ts) * 24 + hour(ts) AS how FROM bars)"


MATCHED = """x AS (SELECT symbol, ts, high - low AS spread, (isodow(ts) - 1) * 24 + hour(ts) AS how FROM bars),
h AS (SELECT a.symbol, a.ts, count(*) AS n, count(*) FILTER (b.spread < a.spread) + 0.5 * count(*) FILTER (b.spread = a.spread) AS every,
  count(*) FILTER (b.how = a.how) AS m, count(*) FILTER (b.how = a.how AND b.spread < a.spread) + 0.5 * count(*) FILTER (b.how = a.how AND b.spread = a.spread) AS own
  FROM x a JOIN x b ON a.symbol = b.symbol AND b.ts BETWEEN a.ts - INTERVAL 30 DAY AND a.ts GROUP BY 1, 2)"""


@add("W23_matched_percentile", f"WITH {HOURLY}, {MATCHED} SELECT symbol, ts, {sql_rounded({'pct': 'CASE WHEN m < 8 THEN every / n ELSE own / m END'})} FROM h")
def w23(spark, sf_dir):
    """Mid-rank of the newest spread among the last 30 days' of its hour of the week; all hours where these are fewer than 8."""
    x = event_bars(spark, sf_dir).select("symbol", "ts", (F.col("high") - F.col("low")).alias("spread"), (F.weekday("ts") * 24 + F.hour("ts")).alias("how"))
    out = with_matched_percentile(x, "spread", "how", 30, 8, "pct", longest=30 * 24 + 1)
    return out.select("symbol", "ts", *rounded({"pct": F.col("pct")}))


@add("W22_spread_estimate", f"WITH {DAILY}, e AS (SELECT symbol, ts, ln(close) AS c, (ln(high) + ln(low)) / 2 AS eta FROM bars), q AS (SELECT *, greatest((lag(c) {W} - lag(eta) {W}) * (lag(c) {W} - eta), 0) AS v FROM e) SELECT symbol, ts, {sql_rounded({'bps': 'CASE WHEN count(v) OVER w >= 30 THEN sqrt(4 * avg(v) OVER w) * 1e4 END'}, 4)} FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)")
def w22(spark, sf_dir):
    """Close-high-low spread, each term moved one bar back so that nothing looks ahead."""
    w = I.series()
    e = daily_bars(spark, sf_dir).select("symbol", "ts", F.ln("close").alias("c"), ((F.ln("high") + F.ln("low")) / 2).alias("eta"))
    pc, pe = F.lag("c").over(w), F.lag("eta").over(w)
    e = e.withColumn("v", F.when(pc.isNotNull(), F.greatest((pc - pe) * (pc - F.col("eta")), F.lit(0.0))).otherwise(0.0))
    n = F.count("v").over(I.rolling(w, 60))
    return e.select("symbol", "ts", *rounded({"bps": F.when(n >= 30, F.sqrt(4 * F.avg("v").over(I.rolling(w, 60))) * 1e4)}, 4))


@add("B16_taker")
def b16(spark, sf_dir):
    """The strongest tenth of the events, far enough apart, each priced at the ask then and the bid an hour later."""
    b = book(spark, sf_dir).withColumn("micros", F.unix_micros(col.ts.cast("timestamp"))).withColumn("score", F.col("bq") - F.col("aq"))
    gate = b.agg(F.percentile(F.abs("score"), F.lit(0.9)).alias("q"))
    strong = b.join(F.broadcast(gate)).where(F.abs("score") >= F.col("q"))
    taken = ordered_scan(strong, ["symbol"], ["ts", "event_id"], ["micros", "event_id", "ask"], lambda k: S.Cooldown(600, 20), "micros long, event_id long, entry double")
    taken = taken.withColumn("at", F.timestamp_micros(F.col("micros") + 3_600_000_000).cast("timestamp_ntz"))
    out = asof(taken, b.select("symbol", "ts", "bid"), ["symbol"], "at", "ts", ["bid"])
    return out.select("symbol", "event_id", *rounded({"pnl_bps": (F.col("bid") / F.col("entry") - 1) * 1e4}, 4))


K4_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type, event_id, epoch_us(ts) AS micros, epoch_us(ts) // 86400000000 AS day FROM events),
p AS (SELECT event_type, min(micros) AS micros, 1::BIGINT AS n FROM e GROUP BY 1
 UNION ALL SELECT event_type, nxt, CASE WHEN nxt // 86400000000 = micros // 86400000000 THEN n + 1 ELSE 1 END FROM
 (SELECT p.*, (SELECT min(e.micros) FROM e WHERE e.event_type = p.event_type AND e.micros >= p.micros + 1800000000 AND (p.n < 30 OR e.day > p.micros // 86400000000)) AS nxt FROM p) WHERE nxt IS NOT NULL)
SELECT p.event_type, p.micros, min(e.event_id) AS event_id FROM p JOIN e ON e.event_type = p.event_type AND e.micros = p.micros GROUP BY 1, 2"""


@add("K4_cooldown", K4_SQL)
def k4(spark, sf_dir):
    """Events of a type half an hour apart, thirty a day at most, each as early as can be."""
    e = scan(spark, sf_dir, "events", ["event_type", "ts", "event_id"]).withColumn("micros", F.unix_micros(col.ts.cast("timestamp")))
    return picked(e, ["event_type"], "micros", "event_id", 1800, 30)


@add("B17_baselines", f"WITH {SIG}, m AS (SELECT *, (day(ts) = min(day(ts)) OVER (PARTITION BY symbol, date_trunc('month', ts))) AS first FROM sig) SELECT symbol, {sql_rounded({'hold': 'arg_max(close, ts) / arg_min(open, ts) - 1'})}, count(*) FILTER (first) AS rebalances FROM m GROUP BY 1")
def b17(spark, sf_dir):
    first = F.dayofmonth("ts") == F.min(F.dayofmonth("ts")).over(Window.partitionBy("symbol", F.date_trunc("month", "ts")))
    x = signals(spark, sf_dir).withColumn("first", first)
    return x.groupBy("symbol").agg(*rounded({"hold": F.max_by("close", "ts") / F.min_by("open", "ts") - 1}), F.count_if("first").alias("rebalances"))


def turtle(spark, sf_dir):
    """Daily bars with the position of a slow trend follower: averages of 50 and 200, breakouts of 55 bars, a chandelier stop of three true ranges."""
    x = with_indicators(daily_bars(spark, sf_dir), {"fast": ("ema", {"n": 50}), "slow": ("ema", {"n": 200}), "atr": ("research_atr", {"n": 14})}, carry=OHLCV)
    x = x.withColumn("breakout", I.highest(I.lag(F.col("high"), 1), 55)).withColumn("member", F.lit(True))
    columns = ["ts", "close", "fast", "slow", "breakout", "atr", "member"]
    held = speculative_scan(long_chunks(x, ("symbol",)), ["symbol"], "ts", columns, lambda key: S.TrendState(), f"ts {x.schema['ts'].dataType.simpleString()}, pos int")
    return x.select("symbol", "ts", "open").join(held, ["symbol", "ts"])


@add("B17_turtle")
def b17_turtle(spark, sf_dir):
    """What the slow trend follower would have earned: a yardstick for faster rules."""
    run = G.vector_backtest(turtle(spark, sf_dir), BPS)
    return run.groupBy("symbol").agg(F.sum("pos").alias("bars_in"), *rounded({"log_total": F.sum(F.ln(F.col("r") + 1))}, 5))


@add("X10_feature_matrix")
def x10(spark, sf_dir):
    """The research features of each bar in one table: windows over one scan."""
    x = with_indicators(event_bars(spark, sf_dir), {"ema": ("ema", {"n": 20, "warm": False}), "rsi": ("rsi", {"n": 14, "research": True}), "atr": ("research_atr", {"n": 14}), "macd": ("macd", {})}, carry=OHLCV)
    x = x.withColumn("r", I.log_return(col.close))
    cols = {f"ret_{n}": I.log_return(col.close, n) for n in (1, 3, 6, 12, 24)}
    cols |= {f"vol_{n}": I.realised_vol(F.col("r"), n) for n in (24, 72)}
    cols |= {"ema_gap": col.close / F.col("ema") - 1, "rsi": F.col("rsi"), "atr_pct": F.col("atr") / col.close, "macd": F.col("macd_histogram")}
    cols |= {"percent_b": I.percent_b(col.close, 20, 2.0), "donchian": I.donchian_position(col.close, F.col("high"), F.col("low"), 20), "volume_z": I.zscore(F.col("volume"), 20)}
    cols |= dict(zip(("hour_sin", "hour_cos"), I.cyclic(F.hour("ts"), 24))) | dict(zip(("day_sin", "day_cos"), I.cyclic(F.weekday("ts"), 7)))
    return x.select("symbol", "ts", *rounded(cols))
