"""B: bar construction and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.catalog.core import SQL, ema_cte, query, r, sql
from barlattice.functions.exprs import rd
from barlattice.operators import bars as B
from barlattice.plans.lineage import settle
from barlattice.sources import tables as T

OHLC = ["open", "high", "low", "close"]


def rounded(df, digits, *cols):
    return df.withColumns({c: rd(c, digits) for c in cols})


HA_IN = """SELECT *, coalesce(lag(hc) OVER (PARTITION BY symbol ORDER BY rn), open) AS x
  FROM (SELECT *, (open + high + low + close) / 4 AS hc FROM bars)"""


@query("b2_heikin_ashi", sql(f"""
  SELECT b.symbol, b.timeframe, b.ts, {r('e.y', 6, 'open')}, {r('greatest(high, e.y, hc)', 6, 'high')},
         {r('least(low, e.y, hc)', 6, 'low')}, {r('hc', 6, 'close')}, volume
  FROM hain b JOIN e ON b.symbol = e.symbol AND b.rn = e.rn""", "bars", hain=HA_IN,
    e=ema_cte("hain", "x", 3, keep=0.5)))
def _(spark, d):
    return rounded(B.heikin_ashi(T.bars(spark, d)), 6, *OHLC).select("symbol", "timeframe", "ts", *OHLC, "volume")


@query("b3_volume_bars", sql("""
  SELECT symbol, timeframe, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, ts) AS close, sum(volume) AS volume
  FROM (SELECT *, floor(sum(volume) OVER (PARTITION BY symbol ORDER BY ts) / 1000) AS bucket FROM bars)
  GROUP BY symbol, timeframe, bucket""", "bars"))
def _(spark, d):
    return B.volume_bars(T.bars(spark, d), 1000.0)


RANGE = sql("""
  SELECT symbol, '5m' AS timeframe, ts, eo AS open, eh AS high, el AS low, close, ev AS volume FROM (
    SELECT *, max(k) OVER (PARTITION BY symbol) AS last_k, sum(CAST(emit AS INTEGER)) OVER (PARTITION BY symbol) AS made FROM rb WHERE k > 0)
  WHERE emit OR (k = last_k AND made > 0 AND ev > 0)""", "bars5", num="""
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars5""", rb="""
  SELECT symbol, 0::BIGINT AS k, ts, open AS o, open AS h, open AS l, 0::DOUBLE AS v, false AS emit, open AS eo, open AS eh, open AS el, close, 0::DOUBLE AS ev FROM num WHERE k = 1
  UNION ALL SELECT symbol, k, ts, CASE WHEN hit THEN close ELSE o END, CASE WHEN hit THEN close ELSE h END, CASE WHEN hit THEN close ELSE l END, CASE WHEN hit THEN 0 ELSE v END,
    hit, o, h, l, close, v FROM (SELECT *, h - l >= 20000.0::DOUBLE * 0.01::DOUBLE AS hit FROM (
      SELECT n.symbol, n.k, n.ts, n.close, s.o, greatest(s.h, n.high) AS h, least(s.l, n.low) AS l, s.v + n.volume AS v FROM rb s JOIN num n ON n.symbol = s.symbol AND n.k = s.k + 1))""")


@query("b4_range_bars", RANGE.replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    return B.range_bars(T.bars(spark, d, "5m"), 20000.0, 0.01)


TYPES = {"time": None, "heikin_ashi": None, "volume": 1000.0, "range": 200.0, "unheard_of": 5.0}
COLS = ", ".join(["symbol", "timeframe", "ts", *OHLC, "volume"])


def rounded_sql(src):
    return f"SELECT symbol, timeframe, ts, {', '.join(r(c, 6, c) for c in OHLC)}, volume FROM ({src})"


# Each type through the one entry point; a type that is not known leaves the bars as they are.
@query("b1_build_dispatch", " UNION ALL ".join(f"SELECT '{t}' AS bar_type, {COLS} FROM ({rounded_sql(q)})" for t, q in {
    "time": sql("SELECT * FROM bars5", "bars5"), "heikin_ashi": SQL["b2_heikin_ashi"],
    "volume": SQL["b3_volume_bars"], "range": SQL["b4_range_bars"], "unheard_of": sql("SELECT * FROM bars", "bars")}.items()))
def _(spark, d):
    hours, minutes = settle(T.bars(spark, d)), settle(T.bars(spark, d, "5m"))
    made = [B.build(minutes if t in ("time", "range") else hours, t, size or 0.0).withColumn("bar_type", F.lit(t)) for t, size in TYPES.items()]
    every = [rounded(x.select("bar_type", "symbol", "timeframe", "ts", *OHLC, F.col("volume").cast("double").alias("volume")), 6, *OHLC) for x in made]
    return reduce(DataFrame.unionByName, every)


def contracts(spark, d):
    return T.bars(spark, d).groupBy("symbol", "contract").agg(F.to_date(F.max("ts")).alias("expiry"))


@query("b5_front_contract", sql("""
  SELECT q.symbol, q.day, coalesce(
      (SELECT arg_min(contract, expiry) FROM c WHERE c.symbol = q.symbol AND c.expiry > q.day),
      (SELECT arg_max(contract, expiry) FROM c WHERE c.symbol = q.symbol)) AS front_contract
  FROM (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM bars) q""", "bars",
    c="SELECT symbol, contract, CAST(max(ts) AS DATE) AS expiry FROM bars GROUP BY 1, 2"))
def _(spark, d):
    days = T.bars(spark, d).select("symbol", F.to_date("ts").alias("day")).distinct()
    return B.front_contract(days, contracts(spark, d)).select("symbol", "day", "front_contract")


@query("b6_quarterly_contracts", sql("""
  SELECT symbol, local_symbol, expiry FROM (SELECT *, bool_or(q) OVER (PARTITION BY symbol) AS anyq FROM (
    SELECT *, local_symbol[3] IN ('H', 'M', 'U', 'Z') AS q FROM (
      SELECT CAST(s_nationkey AS VARCHAR) AS symbol,
        'ES' || substr('FGHJKMNQUVXZ', CAST(s_suppkey % 12 + 1 AS INTEGER), 1) || CAST(s_suppkey AS VARCHAR) AS local_symbol,
        DATE '2024-01-01' + CAST(s_suppkey AS INTEGER) AS expiry FROM supplier)))
  WHERE q OR NOT anyq""", ))
def _(spark, d):
    s = T.load(spark, d, "supplier").select(
        F.col("s_nationkey").cast("string").alias("symbol"),
        F.concat(F.lit("ES"), F.substring(F.lit("FGHJKMNQUVXZ"), (F.col("s_suppkey") % 12 + 1).cast("int"), F.lit(1)),
                 F.col("s_suppkey").cast("string")).alias("local_symbol"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("expiry"))
    return B.quarterly_contracts(s)


@query("b7_back_adjust", sql(f"""
  SELECT b.symbol, b.timeframe, b.ts, b.contract, {r('open + shift', 6, 'open')}, {r('high + shift', 6, 'high')},
         {r('low + shift', 6, 'low')}, {r('close + shift', 6, 'close')}, {r('average + shift', 6, 'average')}
  FROM bars b JOIN (
    SELECT *, sum(gap) OVER (PARTITION BY symbol ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shift
    FROM (SELECT *, coalesce(lead(fo) OVER (PARTITION BY symbol ORDER BY f) - lc, 0) AS gap FROM (
      SELECT symbol, contract, min(ts) AS f, arg_min(open, ts) AS fo, arg_max(close, ts) AS lc FROM bars GROUP BY 1, 2))
  ) s ON b.symbol = s.symbol AND b.contract = s.contract""", "bars"))
def _(spark, d):
    out = rounded(B.back_adjust(T.bars(spark, d)), 6, *OHLC, "average")
    return out.select("symbol", "timeframe", "ts", "contract", *OHLC, "average")


@query("b8_slow_last", sql("""
  SELECT symbol, timeframe, slow_ts, arg_max(close, ts) AS close FROM (
    SELECT *, CASE WHEN ts = time_bucket(INTERVAL '4 hours', ts) THEN ts
              ELSE time_bucket(INTERVAL '4 hours', ts) + INTERVAL '4 hours' END AS slow_ts FROM bars)
  GROUP BY 1, 2, 3""", "bars"))
def _(spark, d):
    return B.slow_last(T.bars(spark, d), "close", 4 * 3600)


@query("b9_daily_close", sql("""
  SELECT symbol, timeframe, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2, 3""", "bars"))
def _(spark, d):
    return B.daily_close(T.bars(spark, d))


@query("b10_fill_forward", sql("""
  SELECT b.symbol, b.timeframe, b.ts, b.close, s.close AS slow_close FROM bars5 b ASOF LEFT JOIN (
    SELECT symbol, slow_ts, arg_max(close, ts) AS close FROM (
      SELECT *, CASE WHEN ts = time_bucket(INTERVAL '1 hour', ts) THEN ts
                ELSE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' END AS slow_ts FROM bars5)
    GROUP BY 1, 2) s ON b.symbol = s.symbol AND b.ts >= s.slow_ts""", "bars5"))
def _(spark, d):
    b = T.bars(spark, d, "5m")
    return B.fill_forward(b, B.slow_last(b, "close", 3600), "close", "slow_close").select(
        "symbol", "timeframe", "ts", "close", "slow_close")


@query("b11_bars_per_year", sql("""
  SELECT symbol, timeframe, count(*) AS bars, greatest(1, CAST(round_even(count(*) /
    ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE / 86400.0 / 365.25), 0) AS BIGINT)) AS bars_per_year
  FROM bars GROUP BY 1, 2""", "bars"))
def _(spark, d):
    return B.bars_per_year(T.bars(spark, d))
