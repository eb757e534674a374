"""Scalar functions, sources and sinks."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from quernstone.functions import scalars as S
from quernstone.operators import joins as J
from quernstone.plans.validation import draw
from quernstone.queries.registry import add, col, rounded, sql_rounded
from quernstone.queries.windows import PAIRS, pairs
from quernstone.sources import store
from quernstone.sources.bars import DAILY, HOURLY, ORDERS, daily_bars, event_bars, order_bars, resample, scan



@add("S_math", f"SELECT o_orderkey, {sql_rounded({'a': 'ln(o_totalprice)', 'b': 'sqrt(o_totalprice)', 'c': 'exp(-o_totalprice / 1e6)', 'd': 'sign(o_totalprice - 1e5) * abs(o_totalprice - 1e5)', 'e': 'sin(2 * pi() * (o_orderkey % 24) / 24)', 'f': 'least(greatest(o_totalprice / 111111.7, 0.5), 2)'})} FROM orders")
def s_math(spark, sf_dir):
    x = F.col("o_totalprice")
    cols = {"a": F.ln(x), "b": F.sqrt(x), "c": F.exp(-x / 1e6), "d": F.signum(x - 1e5) * F.abs(x - 1e5), "e": F.sin(2 * math.pi * (F.col("o_orderkey") % 24) / 24), "f": F.least(F.greatest(x / 111111.7, F.lit(0.5)), F.lit(2.0))}
    return scan(spark, sf_dir, "orders").select("o_orderkey", *rounded(cols))


@add("S_normal", f"SELECT c_custkey, {sql_rounded({'cdf': S.norm_cdf_sql('(c_acctbal / 5000)'), 'ppf': S.norm_ppf_sql('((c_custkey % 97 + 1) / 99.0::DOUBLE)')})} FROM customer")
def s_normal(spark, sf_dir):
    p = (F.col("c_custkey") % 97 + 1) / 99
    return scan(spark, sf_dir, "customer").select("c_custkey", *rounded({"cdf": S.norm_cdf(F.col("c_acctbal") / 5000), "ppf": S.norm_ppf(p)}))


@add("S_decimal", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice / 7 * 1e6)::BIGINT AS units, (l_quantity - l_quantity % 3) AS lots FROM lineitem")
def s_decimal(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") / 7 * 1e6).cast("long").alias("units"), S.floor_step(F.col("l_quantity"), 3.0).alias("lots"))


@add("S_cost", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * ((l_tax * 100 + 2::DOUBLE + 0.5::DOUBLE) * 1.5::DOUBLE) / 10000 AS cost, l_extendedprice * (1 + (CASE WHEN l_linestatus = 'O' THEN 5::DOUBLE ELSE -5::DOUBLE END) / 10000) AS fill FROM lineitem")
def s_cost(spark, sf_dir):
    bps = S.side_cost_bps(F.col("l_tax") * 100, F.lit(2.0), F.lit(0.5), 1.5)
    fill = S.slipped(F.col("l_extendedprice"), F.lit(5.0), F.col("l_linestatus") == "O")
    return scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * bps / 10_000).alias("cost"), fill.alias("fill"))


@add("S_tier_lookup", f"WITH v AS (SELECT o_custkey, sum(o_totalprice) AS n FROM orders GROUP BY 1), t AS (SELECT * FROM (VALUES (0.0, 10.0), (500000.0, 8.0), (2000000.0, 6.0)) x(lo, bps)) SELECT o_custkey, arg_max(bps, lo) AS bps FROM v JOIN t ON n >= lo GROUP BY 1")
def s_tier(spark, sf_dir):
    tiers = store.cost_table(spark, {"x": {"*": {"taker": [[0, 10], [500_000, 8], [2_000_000, 6]]}}})
    volume = scan(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("n"))
    return volume.join(F.broadcast(tiers), F.col("n") >= F.col("tier_min")).groupBy("o_custkey").agg(F.max_by("bps", "tier_min").alias("bps"))


@add("S_calendar", "SELECT event_id, time_bucket(INTERVAL 4 HOUR, ts)::TIMESTAMP AS open_ts, (time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR)::TIMESTAMP AS close_ts, date_trunc('week', ts)::TIMESTAMP AS week, hour(ts)::INT AS h, (isodow(ts) - 1)::INT AS wd FROM events")
def s_calendar(spark, sf_dir):
    return scan(spark, sf_dir, "events").select("event_id", S.floor_to(col.ts, "4h").alias("open_ts"), S.next_close(col.ts, "4h").alias("close_ts"), S.week_start(col.ts).alias("week"), F.hour("ts").alias("h"), F.weekday("ts").alias("wd"))


@add("S_string", f"SELECT doc_id, {sql_rounded({'n': chr(39).join(['CASE WHEN regexp_extract(text, ', '(-?[0-9]+(?:[.][0-9]+)?)', ', 1) = ', '', ' THEN NULL WHEN regexp_extract(text, ', '(-?[0-9]+(?:[.][0-9]+)?)[ ]?(%)?', ', 2) = ', '%', ' THEN regexp_extract(text, ', '(-?[0-9]+(?:[.][0-9]+)?)', ', 1)::DOUBLE / 100 ELSE regexp_extract(text, ', '(-?[0-9]+(?:[.][0-9]+)?)', ', 1)::DOUBLE END'])}, 4)}, lower(source) LIKE '%1%' AS one FROM documents")
def s_string(spark, sf_dir):
    return scan(spark, sf_dir, "documents").select("doc_id", *rounded({"n": S.claimed_number(F.col("text"))}, 4), F.lower("source").contains("1").alias("one"))


@add("S_hash", "SELECT doc_id, sha256(text) AS text_sha, md5(source) AS source_md5 FROM documents")
def s_hash(spark, sf_dir):
    return scan(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"), F.md5(F.col("source").cast("binary")).alias("source_md5"))


@add("S_array", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS joined, count(*) AS segments FROM conversations GROUP BY 1")
def s_array(spark, sf_dir):
    """Transcript segments joined in order."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return scan(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("joined"), F.count("*").alias("segments"))


@add("S_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def s_json(spark, sf_dir):
    return scan(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@add("S_classification", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal < 3000 THEN 'weak' WHEN c_acctbal < 7000 THEN 'fair' ELSE 'strong' END AS verdict FROM customer")
def s_classification(spark, sf_dir):
    return scan(spark, sf_dir, "customer").select("c_custkey", S.ladder(F.col("c_acctbal"), [(0, "rejected"), (3000, "weak"), (7000, "fair")], "strong").alias("verdict"))


@add("S_delta", f"WITH {DAILY}, x AS (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) SELECT symbol, ts, {sql_rounded({'amount': 'close - p', 'pct': '(close - p) / nullif(p, 0)'})}, CASE WHEN close - p > 0 THEN 'up' WHEN close - p < 0 THEN 'down' ELSE 'flat' END AS tone FROM x")
def s_delta(spark, sf_dir):
    from quernstone.functions.indicators import series

    d, p, tone = S.change(col.close, F.lag("close").over(series()))
    return daily_bars(spark, sf_dir).select("symbol", "ts", *rounded({"amount": d, "pct": p}), tone.alias("tone"))


# SRC: sources and sinks
@add("SRC1_cached_scan", f"WITH {DAILY} SELECT * FROM bars WHERE symbol = 'AF' AND ts >= '1997-01-01' AND ts < '1999-01-01'")
def src1(spark, sf_dir):
    """From a store partitioned by symbol: the symbol prunes folders, the span prunes row groups."""
    cache = store.written(daily_bars(spark, sf_dir), "bars", ["symbol"])
    return store.span(cache.where("symbol = 'AF'"), "1997-01-01", "1999-01-01")


MISSING = f"""WITH {HOURLY}, there AS (SELECT symbol, ts FROM bars WHERE (epoch_us(ts) // 3600000000 // 7) % 3 <> 0), wish AS (SELECT symbol, min(ts)::DATE + INTERVAL 2 DAY AS s FROM bars GROUP BY 1),
h AS (SELECT symbol, unnest(generate_series(s, s + INTERVAL 215 HOUR, INTERVAL 1 HOUR)) AS ts FROM wish), lacking AS (SELECT h.symbol, h.ts FROM h ANTI JOIN there USING (symbol, ts)),
isl AS (SELECT *, ts - INTERVAL (row_number() OVER (PARTITION BY symbol ORDER BY ts)) HOUR AS g FROM lacking),
sp AS (SELECT symbol, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end" FROM isl GROUP BY symbol, g)
SELECT sp.symbol, "start", "end", count(bars.ts) AS fetched FROM sp LEFT JOIN bars ON bars.symbol = sp.symbol AND bars.ts >= "start" AND bars.ts < "end" GROUP BY ALL"""


@add("SRC1_missing_spans", MISSING)
def src1_missing(spark, sf_dir):
    """Nine days of hourly bars are wished for and a third is not in the cache: what is fetched is that third."""
    bars = event_bars(spark, sf_dir)
    hour = F.floor(F.unix_micros(col.ts.cast("timestamp")) / 3_600_000_000)
    there = bars.where(F.floor(hour / 7) % 3 != 0)
    start = (F.date_trunc("day", F.min("ts")) + F.expr("INTERVAL 2 DAYS")).cast("timestamp_ntz")
    wished = bars.groupBy("symbol").agg(start.alias("start")).withColumn("end", F.col("start") + F.expr("INTERVAL 9 DAYS"))
    spans = store.missing_spans(wished, there, ["symbol"], 3600)
    fetched = store.fetch_missing(wished, there, bars, ["symbol"], 3600).select("symbol", "ts")
    held = spans.join(fetched, "symbol", "left").where("ts IS NULL OR (ts >= start AND ts < end)")
    counted = held.groupBy("symbol", "start", "end").agg(F.count("ts").alias("fetched"))
    return spans.join(counted, ["symbol", "start", "end"], "left").select("symbol", "start", "end", F.coalesce("fetched", F.lit(0)).cast("long").alias("fetched"))


@add("SRC2_landing_dedupe", "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS h, count(*) AS n FROM (SELECT DISTINCT event_id, event_type, ts FROM (SELECT * FROM events UNION ALL SELECT * FROM events)) GROUP BY 1, 2")
def src2(spark, sf_dir):
    e = scan(spark, sf_dir, "events")
    landed = e.unionByName(e).dropDuplicates(["event_id", "event_type", "ts"])
    return landed.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count("*").alias("n"))


@add("SRC3_folder_names", "SELECT DISTINCT o_orderpriority, regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', '_', 'g') AS folder FROM orders")
def src3(spark, sf_dir):
    return scan(spark, sf_dir, "orders").select("o_orderpriority", store.dirname(F.col("o_orderpriority")).alias("folder")).distinct()


@add("SRC4_whitelist", "SELECT p_partkey, regexp_matches(upper(p_brand), '^[A-Z0-9]{2,10}/[A-Z0-9]{2,10}$') AS symbol_ok, p_type IN ('1m', '5m', '15m', '30m', '1h', '4h', '6h', '1d') AS timeframe_ok FROM part")
def src4(spark, sf_dir):
    return scan(spark, sf_dir, "part").select("p_partkey", store.valid_symbol(F.upper("p_brand")).alias("symbol_ok"), store.valid_timeframe(F.col("p_type")).alias("timeframe_ok"))


@add("SRC5_venue_union", f"WITH {DAILY}, o AS (WITH {ORDERS} SELECT * FROM bars) SELECT 'spot' AS venue, symbol, count(*) AS n FROM bars GROUP BY 2 UNION ALL SELECT 'perp', symbol, count(*) FROM o GROUP BY 2")
def src5(spark, sf_dir):
    both = daily_bars(spark, sf_dir).withColumn("venue", F.lit("spot")).unionByName(order_bars(spark, sf_dir).withColumn("venue", F.lit("perp")))
    return both.groupBy("venue", "symbol").agg(F.count("*").alias("n"))


@add("SRC6_manifest", f"WITH {DAILY} SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1")
def src6(spark, sf_dir):
    return store.manifest(daily_bars(spark, sf_dir), ["symbol"]).drop("fingerprint")


@add("SRC7_rows_to_frame", "SELECT event_type, (epoch_us(ts) // 60000000 * 60000) AS ts_ms, make_timestamp(epoch_us(ts) // 60000000 * 60000000) AS ts, min(event_id) AS event_id FROM events GROUP BY ALL")
def src7(spark, sf_dir):
    minute = F.floor(F.unix_micros(col.ts.cast("timestamp")) / 60_000_000).cast("long") * 60_000
    raw = scan(spark, sf_dir, "events").select("event_type", minute.alias("ts_ms"), "event_id")
    return store.from_epoch_ms(raw, ["event_type"], "event_id").select("event_type", "ts_ms", "ts", "event_id")


@add("SRC8_fetch_all", f"WITH {HOURLY} SELECT symbol, count(*) AS rows, min(low) AS low, max(high) AS high FROM bars GROUP BY 1")
def src8(spark, sf_dir):
    """Bulk landing: every series written by symbol, then summed up from the store."""
    landed = store.written(event_bars(spark, sf_dir), "fetch-all", ["symbol"])
    return landed.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))


@add("SRC9_pair_loader", f"WITH {DAILY}, {PAIRS} SELECT pr.a || '/' || pr.b AS pair, x.ts, x.open AS a_open, x.close AS a_close, y.open AS b_open, y.close AS b_close FROM pr JOIN bars x ON x.symbol = pr.a JOIN bars y ON y.symbol = pr.b AND y.ts = x.ts")
def src9(spark, sf_dir):
    """Both legs of each pair of a table of pairs, on the bars that both have."""
    bars = daily_bars(spark, sf_dir)
    leg = lambda n: bars.select(F.col("symbol").alias(n), "ts", F.col("open").alias(f"{n}_open"), col.close.alias(f"{n}_close"))
    both = pairs(bars).join(leg("a"), "a").join(leg("b"), ["b", "ts"])
    return both.select(F.concat("a", F.lit("/"), "b").alias("pair"), "ts", "a_open", "a_close", "b_open", "b_close")


@add("SRC10_trend_loader", f"WITH {HOURLY}, h AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts)::TIMESTAMP AS b, arg_min(open, ts) AS open, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2) SELECT h.symbol, b AS ts, open, close, CASE WHEN hour(b) % 8 = 0 THEN open / 1000 END AS funding_rate FROM h")
def src10(spark, sf_dir):
    """Four-hour bars with the funding stamped every eight hours, null between."""
    slow = resample(event_bars(spark, sf_dir), 14_400)
    funding = slow.where(F.hour("ts") % 8 == 0).select("symbol", "ts", (F.col("open") / 1000).alias("funding_rate"))
    return slow.select("symbol", "ts", "open", "close").join(funding, ["symbol", "ts"], "left")


@add("SRC11_stamp_rounding", "SELECT event_id, date_trunc('hour', ts + INTERVAL 30 MINUTE)::TIMESTAMP AS stamp FROM events")
def src11(spark, sf_dir):
    return scan(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", col.ts + F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz").alias("stamp"))


@add("SRC12_asset_class", """WITH s AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'BTC' WHEN 3 THEN 'GBP' ELSE upper(replace(left(p_name, 4), ' ', '')) END
 || CASE p_partkey % 4 WHEN 0 THEN '/USD' WHEN 1 THEN '/USDT' WHEN 2 THEN '/JPY' ELSE '' END AS symbol FROM part)
SELECT p_partkey, symbol, CASE WHEN regexp_matches(symbol, '^(USD|EUR|GBP|JPY|CHF|AUD|CAD|NZD)/(USD|EUR|GBP|JPY|CHF|AUD|CAD|NZD)$') THEN 'forex' WHEN contains(symbol, '/') THEN 'crypto' ELSE 'equity' END AS asset FROM s""")
def src12(spark, sf_dir):
    """Which adapter a listed symbol belongs to: two currencies, a coin or token, or a share."""
    size, key = F.col("p_size") % 6, F.col("p_partkey") % 4
    base = F.when(size == 0, "EUR").when(size == 1, "USD").when(size == 2, "BTC").when(size == 3, "GBP").otherwise(F.upper(F.replace(F.left("p_name", F.lit(4)), F.lit(" "), F.lit(""))))
    quote = F.when(key == 0, "/USD").when(key == 1, "/USDT").when(key == 2, "/JPY").otherwise("")
    listed = scan(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"]).select("p_partkey", F.concat(base, quote).alias("symbol"))
    return listed.withColumn("asset", store.asset_class(F.col("symbol")))


@add("SRC14_inventory", "SELECT event_type, count(DISTINCT date_trunc('hour', ts)) AS hours, count(DISTINCT date_trunc('hour', ts)) / 24 AS days, count(DISTINCT date_trunc('hour', ts)) >= 28 * 24 AS enough FROM events GROUP BY 1")
def src14(spark, sf_dir):
    hours = scan(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct(F.date_trunc("hour", "ts")).alias("hours"))
    return hours.select("event_type", "hours", (F.col("hours") / 24).alias("days"), (F.col("hours") >= 28 * 24).alias("enough"))


SYNTHETIC = f"""WITH {HOURLY}, t AS (SELECT symbol, ts, close, unnest(range(12)) AS tick FROM bars),
d AS (SELECT symbol, ts, tick, close, ('0x' || substr(md5(symbol || '-' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '-' || tick), 1, 8))::BIGINT / 4294967296 AS u FROM t)
SELECT symbol, ts + to_seconds(300 * tick) AS ts, {sql_rounded({'bid': 'close * (1 + (u - 0.5) / 500)', 'ask': 'close * (1 + (u - 0.5) / 500) + 0.01 * (1 + tick % 3)'})}, (1 + (u * 1000)::BIGINT % 9)::INT AS bid_qty FROM d"""


@add("SRC15_synthetic_book", SYNTHETIC)
def src15(spark, sf_dir):
    """A seeded book ticker around given bars: twelve updates an hour, their noise drawn from a hash of symbol, time and number."""
    u = draw(F.col("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("tick")) / 4294967296
    ticks = event_bars(spark, sf_dir).select("symbol", "ts", "close", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tick")).withColumn("u", u)
    bid = col.close * (1 + (F.col("u") - 0.5) / 500)
    at = F.col("ts") + F.make_dt_interval(secs=300 * F.col("tick"))
    quantity = (1 + F.round(F.col("u") * 1000).cast("long") % 9).cast("int")
    return ticks.select("symbol", at.alias("ts"), *rounded({"bid": bid, "ask": bid + 0.01 * (1 + F.col("tick") % 3)}), quantity.alias("bid_qty"))


@add("SRC16_save_list", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 40")
def src16(spark, sf_dir):
    saved = store.written(scan(spark, sf_dir, "documents", ["doc_id", "source", "lang", "n_chars"]), "content", ["lang"])
    return saved.where("lang = 'en'").orderBy(F.col("n_chars").desc(), "doc_id").limit(40).select("doc_id", "source", "n_chars")


@add("SRC17_candle_upsert", f"WITH {DAILY} SELECT symbol, count(*) AS n, count(*) FILTER (ts >= '1998-01-01') AS added, {sql_rounded({'closes': 'sum(close)'}, 4)} FROM bars GROUP BY 1")
def src17(spark, sf_dir):
    """Insert what is absent; the first write of a candle wins, though it arrives three times with other prices."""
    bars = daily_bars(spark, sf_dir)
    there = store.span(bars, "1900-01-01", "1998-01-01").withColumn("added", F.lit(False))
    arrivals = bars.withColumn("arrival", F.explode(F.array(*[F.lit(i) for i in (2, 0, 1)]))).withColumn("close", F.col("close") + F.col("arrival"))
    merged = store.merge_fetched(there, arrivals.withColumn("added", F.lit(True)), ["symbol", "ts"], ["arrival"])
    return merged.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("added").alias("added"), *rounded({"closes": F.sum("close")}, 4))


@add("SRC18_position_upsert", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, count(*) AS orders FROM orders GROUP BY 1")
def src18(spark, sf_dir):
    """Upsert as union and newest by key."""
    o = scan(spark, sf_dir, "orders")
    newest = J.latest(o.unionByName(o), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return newest.select("o_custkey", F.col("o_orderkey").alias("last_order")).join(o.groupBy("o_custkey").agg(F.count("*").alias("orders")), "o_custkey")


@add("SRC19_artifact_hash", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS sha FROM nation")
def src19(spark, sf_dir):
    return scan(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct("n_name", "n_regionkey")), 256).alias("sha"))


@add("SRC20_cost_tables", """SELECT n_name AS exchange, 'S' || s_suppkey AS symbol, side, tier_min, CASE WHEN side = 'maker' THEN s_suppkey % 5 ELSE s_suppkey % 7 + 2 END::DOUBLE / (1 + (tier_min > 0)::INT) AS bps
FROM supplier JOIN nation ON s_nationkey = n_nationkey, unnest(['maker', 'taker']) AS a(side), unnest([0.0::DOUBLE, 1000000.0::DOUBLE]) AS b(tier_min) WHERE side = 'taker' OR tier_min = 0""")
def src20(spark, sf_dir):
    """Fee schedules, a nested JSON document a venue, landed as files and read back as rows."""
    venues = scan(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"]).join(scan(spark, sf_dir, "nation", ["n_nationkey", "n_name"]), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    tier = lambda least, bps: F.array(F.lit(least), bps.cast("double"))
    sides = F.create_map(F.lit("maker"), F.array(tier(0.0, key % 5)), F.lit("taker"), F.array(tier(0.0, key % 7 + 2), tier(1e6, (key % 7 + 2) / 2)))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("S"), key.cast("string")).alias("symbol"), sides.alias("sides"))))
    told = venues.groupBy("n_name").agg(F.to_json(F.map_from_entries(F.array(F.struct(F.col("n_name").alias("k"), entries.alias("v"))))).alias("value"))
    path = f"{store.shared_dir(spark)}/fees-{uuid.uuid4().hex}"
    told.select("value").write.text(path)
    return store.load_cost_table(spark, path)


@add("SRC21_article_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<header\b.*?</header>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g'), '(?is)<head\b.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def src21(spark, sf_dir):
    return scan(spark, sf_dir, "pages").select("page_id", store.main_text(F.col("html")).alias("body"))


@add("F12_text_length", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 200")
def f12(spark, sf_dir):
    return scan(spark, sf_dir, "documents", ["doc_id", "text"]).where(F.length(F.trim("text")) >= 200).select("doc_id")


@add("SRC22_row_chain", "SELECT 'lineitem' AS tbl, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")
def src22(spark, sf_dir):
    """The rows that hang on some customers, level by level."""
    cu = scan(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    o = scan(spark, sf_dir, "orders").join(cu, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    l = scan(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n")
    return count(l, "lineitem").unionByName(count(o, "orders")).unionByName(count(cu, "customer"))


@add("SRC23_daily_summary", f"SELECT o_orderdate::DATE AS day, count(*) AS orders, {sql_rounded({'total': 'sum(o_totalprice)'}, 2)} FROM orders GROUP BY 1")
def src23(spark, sf_dir):
    daily = scan(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"), *rounded({"total": F.sum("o_totalprice")}, 2))
    path = f"{store.shared_dir(spark)}/summary-{spark.sparkContext.applicationId}"
    daily.write.mode("overwrite").json(path)
    return spark.read.schema(daily.schema).json(path)
