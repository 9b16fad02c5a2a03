"""P, J: predicates, calendar marks and joins that are not part of another family."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import query, r, sql
from barlattice.functions.exprs import rd
from barlattice.operators import predicates as P
from barlattice.operators.execution import with_specs
from barlattice.plans.asof import asof
from barlattice.plans.ranges import extremes_between
from barlattice.sources import tables as T


@query("p1_hour_mask", sql("SELECT symbol, timeframe, ts, hour(ts) >= 2 AND hour(ts) < 15 AS day_ok, hour(ts) >= 22 OR hour(ts) < 4 AS night_ok FROM bars", "bars"))
def _(spark, d):
    return T.bars(spark, d).select("symbol", "timeframe", "ts", P.hour_mask(F.col("ts"), 2, 15).alias("day_ok"), P.hour_mask(F.col("ts"), 22, 4).alias("night_ok"))


@query("p2_session_mask", sql("""SELECT event_id, CAST(ts AS TIME) BETWEEN TIME '09:30' AND TIME '16:00' AS day_ok, CAST(ts AS TIME) >= TIME '22:15' OR CAST(ts AS TIME) <= TIME '04:45' AS night_ok,
    CAST(ts AS TIME) >= TIME '12:00' AS open_ended FROM events"""))
def _(spark, d):
    ts = F.col("ts")
    return T.load(spark, d, "events").select("event_id", P.session_mask(ts, "09:30", "16:00").alias("day_ok"),
                                             P.session_mask(ts, "22:15", "04:45").alias("night_ok"), P.session_mask(ts, "12:00", None).alias("open_ended"))


@query("p3_direction_gate", sql("""SELECT symbol, timeframe, ts, close > open AS long_both, close < open AS short_both, close > open AS long_long, false AS short_long FROM bars""", "bars"))
def _(spark, d):
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    both, only = P.gate_direction("both", up, down), P.gate_direction("LONG ", up, down)
    return T.bars(spark, d).select("symbol", "timeframe", "ts", both[0].alias("long_both"), both[1].alias("short_both"), only[0].alias("long_long"), only[1].alias("short_long"))


@query("p4_last_bar_of_day", sql("""SELECT symbol, timeframe, ts, coalesce(CAST(lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS DATE) <> CAST(ts AS DATE), true) AS is_eod FROM bars""", "bars"))
def _(spark, d):
    return P.last_of_day(T.bars(spark, d)).select("symbol", "timeframe", "ts", "is_eod")


@query("p5_first_bar_after_close", sql("""SELECT symbol, timeframe, ts, coalesce(ts = min(CASE WHEN hour(ts) * 60 + minute(ts) >= 950 THEN ts END)
    OVER (PARTITION BY symbol, CAST(ts AS DATE)), false) AS is_close_bar FROM bars5""", "bars5"))
def _(spark, d):
    return P.first_at_or_after(T.bars(spark, d, "5m"), "15:50").select("symbol", "timeframe", "ts", "is_close_bar")


@query("p6_rebalance_marks", sql("""SELECT symbol, timeframe, ts, coalesce(CAST(ts AS DATE) <> CAST(lag(ts) OVER w AS DATE), true) AS daily,
    coalesce(date_trunc('week', ts) <> date_trunc('week', lag(ts) OVER w), true) AS weekly FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", "bars"))
def _(spark, d):
    day = P.rebalance_marks(T.bars(spark, d), "daily").withColumnRenamed("rebalance", "daily")
    return P.rebalance_marks(day, "weekly").select("symbol", "timeframe", "ts", "daily", F.col("rebalance").alias("weekly"))


@query("p9_scope_to_slot", sql("""SELECT DISTINCT l_returnflag AS strategy FROM lineitem WHERE l_returnflag = 'N'"""))
def _(spark, d):
    slots = T.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("strategy"), F.lit(0).alias("slot_id")).distinct()
    return P.resolve_scope(slots, " +N  ").select("strategy")


@query("p10_replay_window", sql("""SELECT s.name, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars JOIN (
    SELECT event_type AS name, min(ts) + INTERVAL 3 DAY AS a, max(ts) - INTERVAL 4 DAY AS z FROM events GROUP BY 1) s ON ts BETWEEN a AND z GROUP BY 1""", "bars"))
def _(spark, d):
    sc = T.load(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(
        (F.min("ts") + F.expr("interval 3 day")).alias("start_ts"), (F.max("ts") - F.expr("interval 4 day")).alias("end_ts"))
    return P.replay_windows(T.bars(spark, d), sc).groupBy("name").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("p12_slot_violations", sql("""SELECT abs(sum(weight) - 1.0) > 0.01 AS weights_off, count(*) FILTER (n = 0) AS no_symbols, count(*) FILTER (weight <= 0) AS weight_not_positive,
    count(*) FILTER (NOT (dc > 0 AND dc <= 1)) AS duty_cycle_off FROM (
  SELECT l_suppkey % 50 AS slot, avg(l_discount) - 0.05 AS weight, count(DISTINCT l_linestatus) - 1 AS n, avg(l_tax) * 30 - 0.2 AS dc FROM lineitem GROUP BY 1)"""))
def _(spark, d):
    li = T.load(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("slot_id")).agg(
        (F.avg("l_discount") - 0.05).alias("weight"), F.slice(F.collect_set("l_linestatus"), 2, 1).alias("symbols"),
        (F.avg("l_tax") * 30 - 0.2).alias("expected_duty_cycle"))
    return P.slot_violations(li)


@query("j1_common_timestamps", sql("SELECT x.ts, x.close AS x, y.close AS y FROM bars x JOIN bars y ON x.ts = y.ts AND x.symbol = 'view' AND y.symbol = 'click'", "bars"))
def _(spark, d):
    b = T.bars(spark, d)
    x, y = (b.where(F.col("symbol") == s).select("ts", F.col("close").alias(n)) for s, n in (("view", "x"), ("click", "y")))
    return x.join(y, "ts")


@query("j2_asof_backward", sql("SELECT e.event_id, b.ts AS bar_ts, b.close AS bar_close FROM events e ASOF LEFT JOIN bars b ON b.symbol = e.event_type AND e.ts >= b.ts", "bars"))
def _(spark, d):
    e = T.load(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    return asof(e, T.bars(spark, d), ["symbol"], "ts", "ts", {"ts": "bar_ts", "close": "bar_close"}).select("event_id", "bar_ts", "bar_close")


@query("j3_range_extremes", sql(f"""SELECT trade_id, {r('max(high)', 4, 'max_high')}, {r('min(low)', 4, 'min_low')} FROM itrades t JOIN bars5 b
  ON b.symbol = t.symbol AND b.ts > t.entry_time AND b.ts <= t.exit_time GROUP BY 1""", "itrades", "bars5"))
def _(spark, d):
    x = extremes_between(T.intraday_trades(spark, d), T.bars(spark, d, "5m"), ["symbol"], "trade_id", "entry_time", "exit_time")
    return x.select("trade_id", rd("max_high", 4).alias("max_high"), rd("min_low", 4).alias("min_low"))


@query("j4_next_bar_strict", sql("""SELECT e.event_id, b.ts AS bar_ts, b.open AS bar_open FROM events e ASOF LEFT JOIN bars5 b ON b.symbol = e.event_type AND e.ts < b.ts""", "bars5"))
def _(spark, d):
    e = T.load(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    n = asof(e, T.bars(spark, d, "5m"), ["symbol"], "ts", "ts", {"ts": "bar_ts", "open": "bar_open"}, forward=True, strict=True)
    return n.select("event_id", "bar_ts", "bar_open")


@query("j7_tail_day_rows", sql(f"""SELECT slot_id, ts, {r('cum_pnl', 4, 'cum_pnl')} FROM slot_hist WHERE CAST(ts AS DATE) IN (
  SELECT day FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) WHERE n > (SELECT count(*) / 30 FROM events))""", "slot_hist"))
def _(spark, d):
    e = T.load(spark, d, "events")
    busy = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    limit = busy.agg((F.sum("n") / 30).alias("lim"))
    days = busy.join(F.broadcast(limit), F.col("n") > F.col("lim")).select("day")
    rows = T.slot_history(spark, d).withColumn("day", F.to_date("ts"))
    return rows.join(days, "day", "left_semi").select("slot_id", "ts", rd("cum_pnl", 4).alias("cum_pnl"))


@query("j8_absent_series", sql("""SELECT n.n_name AS name FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000)"""))
def _(spark, d):
    n, s = T.load(spark, d, "nation"), T.load(spark, d, "supplier").where(F.col("s_acctbal") > 5000)
    return n.join(s, n.n_nationkey == s.s_nationkey, "left_anti").select(F.col("n_name").alias("name"))


@query("j10_dimension_lookup", sql("""SELECT symbol, timeframe, ts, CASE symbol WHEN 'click' THEN 1.0::DOUBLE WHEN 'error' THEN 5 WHEN 'purchase' THEN 20 WHEN 'signup' THEN 50 ELSE 1 END AS multiplier FROM bars""", "bars"))
def _(spark, d):
    return with_specs(T.bars(spark, d), T.specs(spark)).select("symbol", "timeframe", "ts", "multiplier")
