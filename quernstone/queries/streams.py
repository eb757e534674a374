"""Streaming semantics: each query drains a stream and must give what the table gives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import conditions as C
from quernstone.functions import indicators as I
from quernstone.operators import simulators as S
from quernstone.plans import spec as P
from quernstone.queries.registry import add, rounded, sql_rounded
from quernstone.queries.simulators import GOLDEN
from quernstone.queries.windows import W, sma
from quernstone.sources.bars import DAILY, HOURLY, bin_start, daily_bars, scan
from quernstone.sources.store import written
from quernstone.streaming import engine as E
from quernstone.streaming.failures import failure_states


def ticks(spark, sf_dir, parts: int = 3):
    """Events as a stream of ticks in three batches."""
    e = scan(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    path, schema = E.staged(e, "ticks", "ts", parts)
    return E.read_stream(spark, path, schema)


def ntz(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


LATE = "(SELECT max(ts) - INTERVAL 30 SECOND FROM events)"
CLOSED = f"WITH {HOURLY} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= {LATE}"


@add("ST2_closed_bars", CLOSED)
def st2(spark, sf_dir):
    return ntz(E.drain(E.tumbling_bars(ticks(spark, sf_dir), 3600), "closed-bars"))


@add("F6_closed_candles", CLOSED.replace("symbol, ts, open, high, low, close, volume", "symbol, ts, close"))
def f6(spark, sf_dir):
    """The same gate on a table: bars whose end, with the margin, has passed."""
    from quernstone.sources.bars import event_bars

    now = scan(spark, sf_dir, "events", ["ts"]).agg((F.max("ts") - F.expr("INTERVAL 30 SECONDS")).alias("now"))
    return event_bars(spark, sf_dir).join(F.broadcast(now)).where(F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.col("now")).select("symbol", "ts", "close")


@add("F5_weekend_skip", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND isodow(ts) >= 6)")
def f5(spark, sf_dir):
    """One asset class rests on weekends."""
    return scan(spark, sf_dir, "events").where(~((F.col("event_type") == "error") & (F.weekday("ts") >= 5))).select("event_id")


@add("ST3_first_write_wins", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1")
def st3(spark, sf_dir):
    """Every tick comes twice in its batch and counts once."""
    t = ticks(spark, sf_dir)
    twice = t.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return E.drain(E.first_write_wins(twice, ["id"], "1 hour"), "first-write").groupBy("symbol").agg(F.count("*").alias("n"))


@add("ST4_gap_alerts", f"WITH x AS (SELECT event_type AS symbol, epoch_us(ts) AS micros, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events) SELECT symbol, micros, {sql_rounded({'gap_s': 'gap / 1e6'}, 3)} FROM x WHERE gap > 7200 * 1e6")
def st4(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("micros", F.unix_micros("ts"))
    out = E.drain(E.stream_scan(t, ["symbol"], ["micros", "id"], ["micros"], S.Gaps, "micros long, gap_s double"), "gaps")
    return out.select("symbol", "micros", *rounded({"gap_s": F.col("gap_s")}, 3))


@add("ST4_failure_streak", """WITH x AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
y AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM x),
z AS (SELECT *, lag(streak, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM y)
SELECT event_id, user_id, CASE WHEN bad THEN 'alert' ELSE 'recovered' END AS told FROM z WHERE (bad AND streak = 2) OR (NOT bad AND before >= 2)""")
def st4_streak(spark, sf_dir):
    """A source that fails twice in a row is told of once, however long it goes on failing, and once more when it recovers."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = scan(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("bad"))
    e = e.withColumn("run", F.sum((~F.col("bad")).cast("int")).over(I.running(w)))
    e = e.withColumn("streak", F.sum(F.col("bad").cast("int")).over(I.running(Window.partitionBy("user_id", "run").orderBy("ts", "event_id"))))
    e = e.withColumn("before", F.lag("streak", 1, 0).over(w))
    told = F.when(F.col("bad") & (F.col("streak") == 2), "alert").when(~F.col("bad") & (F.col("before") >= 2), "recovered")
    return e.withColumn("told", told).where("told IS NOT NULL").select("event_id", "user_id", "told")


def crossed(spark, sf_dir):
    c = F.col("close")
    b = daily_bars(spark, sf_dir).withColumn("f", I.sma(c, 10)).withColumn("s", I.sma(c, 30))
    return b.withColumn("enter", C.crossover(F.col("f"), F.col("s"))).withColumn("leave", C.crossover(F.col("f"), F.col("s"), False)).withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))


@add("ST4_failure_stream", """WITH x AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, lag(event_type = 'error', 1, false) OVER q AS was_bad, ts - lag(ts) OVER q AS gap FROM events WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum((NOT (bad AND was_bad AND gap <= INTERVAL 12 HOUR))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x),
z AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM y),
v AS (SELECT *, lag(streak, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM z)
SELECT event_id, user_id, CASE WHEN bad THEN 'alert' ELSE 'recovered' END AS told, (CASE WHEN bad THEN streak ELSE before END)::INT AS streak FROM v WHERE (bad AND streak = 2) OR (NOT bad AND was_bad AND gap <= INTERVAL 12 HOUR AND before >= 2)""")
def st4_stream(spark, sf_dir):
    """The same in the stream itself: typed state a source, forgotten twelve hours after its last failure."""
    e = scan(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("bad"))
    path, schema = E.staged(e, "failures", "ts", 3)
    with E.rocksdb(spark):
        return E.drain(failure_states(E.read_stream(spark, path, schema), "user_id", "event_id", threshold=2, hours=12), "failures-out")


@add("ST7_seeded_latch", f"WITH {DAILY}, x AS (SELECT *, {sma('close', 10)} AS f, {sma('close', 30)} AS s FROM bars), y AS (SELECT *, coalesce(lag(f) {W} <= lag(s) {W} AND f > s, false) AS en, coalesce(lag(f) {W} >= lag(s) {W} AND f < s, false) AS le FROM x) SELECT symbol, epoch_us(ts) AS micros, coalesce(last_value(CASE WHEN le THEN -1 WHEN en THEN 1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), -1) > 0 AS is_on, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM y")
def st7(spark, sf_dir):
    """State carried over three batches gives what one pass gives."""
    path, schema = E.staged(crossed(spark, sf_dir).select("symbol", "micros", "close", "enter", "leave"), "latch", "micros", 3)
    return E.drain(E.stream_scan(E.read_stream(spark, path, schema), ["symbol"], ["micros"], ["micros", "close", "enter", "leave"], S.Latch, "micros long, is_on boolean, top double"), "latch-out")


@add("B3_live_stepper")
def b3(spark, sf_dir):
    """The position simulator stepped through a stream from its stored state: closed trades so far."""
    table, config = P.signals(GOLDEN, daily_bars(spark, sf_dir))
    path, schema = E.staged(table.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))), "live", "micros", 3)
    out = E.stream_scan(E.read_stream(spark, path, schema), ["symbol"], ["micros"], ["ts", "open", "high", "low", "close", "entry", "leave", "atr"], lambda key: S.BarTrader(config), S.TRADES)
    return E.drain(out, "live-out").select("symbol", "entry_ts", "exit_ts", *rounded({"ret": F.col("ret")}), "reason")


@add("ST5_exactly_once", f"WITH {DAILY} SELECT symbol, count(*) AS n FROM bars GROUP BY 1")
def st5(spark, sf_dir):
    """A replayed candle is not walked again."""
    b = crossed(spark, sf_dir).select("symbol", "micros", "close", "enter", "leave")
    path, schema = E.staged(b, "once", "micros", 2)
    b.coalesce(1).write.mode("append").parquet(path)
    out = E.stream_scan(E.read_stream(spark, path, schema), ["symbol"], ["micros"], ["micros", "close", "enter", "leave"], S.Latch, "micros long, is_on boolean, top double")
    return E.drain(out, "once-out").groupBy("symbol").agg(F.count("*").alias("n"))


@add("ST6_state_recovery", f"WITH {DAILY} SELECT symbol, max(close) AS top FROM bars GROUP BY 1")
def st6(spark, sf_dir):
    """Stopped after the first files, started again from the checkpoint: the running maximum goes on."""
    import uuid

    from quernstone.sources.store import shared_dir

    b = crossed(spark, sf_dir).select("symbol", "micros", "close", "enter", "leave")
    path, schema = E.staged(b, "recovery", "micros", 1)
    base = f"{shared_dir(spark)}/recovered-{uuid.uuid4().hex}"

    def once():
        out = E.stream_scan(E.read_stream(spark, path, schema), ["symbol"], ["micros"], ["micros", "close", "enter", "leave"], S.Latch, "micros long, is_on boolean, top double")
        out.writeStream.format("parquet").option("path", f"{base}/t").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
        return out.schema

    once()
    b.withColumn("micros", F.col("micros") + 10**16).withColumn("close", F.lit(0.0)).coalesce(1).write.mode("append").parquet(path)
    kept = once()
    rows = spark.read.schema(kept).parquet(f"{base}/t")
    return rows.groupBy("symbol").agg(F.max_by("top", "micros").alias("top"))


@add("ST8_sequence_continuity")
def st8(spark, sf_dir):
    """Book updates by sequence number, with a gap now and then."""
    e = scan(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), (F.col("event_id") * 10).alias("first"), (F.col("event_id") * 10 + 9 + F.when(F.col("event_id") % 7 == 0, 500).otherwise(0)).alias("final"))
    path, schema = E.staged(e, "depth", "first", 2)
    return E.drain(E.stream_scan(E.read_stream(spark, path, schema), ["symbol"], ["first"], ["first", "final"], lambda k: S.Continuity(), "first_id long, final_id long, verdict string"), "depth-out")


@add("ST9_hourly_rotation", "SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def st9(spark, sf_dir):
    """Ticks in folders by symbol and hour; the manifest counts them."""
    t = ticks(spark, sf_dir).withColumn("hour", F.date_format("ts", "yyyy-MM-dd-HH"))
    out = E.drain(t.repartition(16, "symbol", "hour"), "rotated", ["symbol", "hour"]).drop("hour")
    return out.groupBy("symbol", bin_start(F.col("ts"), 3600).alias("hour")).agg(F.count("*").alias("n"))


@add("SRC13_recorder", "SELECT event_type AS symbol, ts::DATE AS day, count(*) AS events, count(DISTINCT date_trunc('minute', ts)) AS minutes FROM events GROUP BY 1, 2")
def src13(spark, sf_dir):
    """The recorder's integrity manifest by day."""
    out = E.drain(ticks(spark, sf_dir), "recorded")
    return out.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.count_distinct(F.date_trunc("minute", "ts")).alias("minutes"))


@add("ST10_staleness", "SELECT event_type, max(ts) AS last_ts, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 600 SECOND AS stale FROM events GROUP BY 1")
def st10(spark, sf_dir):
    e = scan(spark, sf_dir, "events", ["event_type", "ts"])
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return e.groupBy("event_type").agg(F.max("ts").alias("last_ts")).join(now).select("event_type", "last_ts", (F.col("last_ts") < F.col("now") - F.expr("INTERVAL 600 SECONDS")).alias("stale"))


@add("ST11_rate_limit", "SELECT user_id, ts::DATE AS day, count(*) AS n, count(*) > 5 AS limited FROM events GROUP BY 1, 2")
def st11(spark, sf_dir):
    """Requests in fixed windows of 24 hours against a limit."""
    e = scan(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return e.withColumn("limited", F.col("n") > 5)


@add("ST12_crash_recovery", "SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END), 2) AS cash, count(*) FILTER (o_orderstatus = 'O') AS open_n FROM orders GROUP BY 1")
def st12(spark, sf_dir):
    """Cash from an account's last snapshot plus what came after it, and open positions. Snapshots were taken at the start of each month in which it traded."""
    o = scan(spark, sf_dir, "orders")
    flow = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    monthly = o.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("taken_at")).agg(F.sum(flow).alias("moved"))
    before = Window.partitionBy("o_custkey").orderBy("taken_at").rowsBetween(Window.unboundedPreceding, -1)
    snapshots = written(monthly.select("o_custkey", "taken_at", F.coalesce(F.sum("moved").over(before), F.lit(0.0)).alias("cash")), "snapshots")
    last = snapshots.groupBy("o_custkey").agg(F.max_by(F.struct("taken_at", "cash"), "taken_at").alias("s")).select("o_custkey", "s.*")
    after = o.join(last, "o_custkey").where(F.col("o_orderdate") >= F.col("taken_at")).groupBy("o_custkey").agg((F.first("cash") + F.sum(flow)).alias("cash"))
    opened = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_n"))
    return opened.join(after, "o_custkey").select("o_custkey", F.round("cash", 2).alias("cash"), "open_n")


@add("ST1_phased_ticks", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1")
def st1(spark, sf_dir):
    """Micro-batches through phases; a phase that fails is recorded and does not stop the others."""
    import uuid

    from quernstone.sources.store import shared_dir

    base = f"{shared_dir(spark)}/phases-{uuid.uuid4().hex}"

    def phases(batch, epoch):
        for name, phase in (("ingest", lambda: batch.write.mode("append").parquet(f"{base}/ingest")), ("signal", lambda: 1 / 0)):
            try:
                phase()
            except ZeroDivisionError as why:  # the phase that is meant to fail here
                batch.sparkSession.createDataFrame([(epoch, name, str(why))], "epoch long, phase string, error string").write.mode("append").parquet(f"{base}/failures")

    ticks(spark, sf_dir).writeStream.foreachBatch(phases).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/ingest").groupBy("symbol").agg(F.count("*").alias("n"))
