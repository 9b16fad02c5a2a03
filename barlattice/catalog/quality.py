"""V: data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import query, r, sql
from barlattice.functions.exprs import rd
from barlattice.operators import quality as Q
from barlattice.sources import tables as T


def dirty(spark, d):
    """Hourly bars with broken highs and averages at fixed hours."""
    bad = (F.hour("ts") == 13) & (F.dayofmonth("ts") % 5 == 0)
    return T.bars(spark, d).withColumn("high", F.when(bad, F.col("low") - 1).otherwise(F.col("high"))
        ).withColumn("average", F.when(F.hour("ts") == 7, F.col("high") + 5).otherwise(F.col("average")))


DIRTY = """
  SELECT symbol, timeframe, ts, rn, open, low, close, volume, contract, h AS high,
         CASE WHEN hour(ts) = 7 THEN h + 5 ELSE average END AS average
  FROM (SELECT *, CASE WHEN hour(ts) = 13 AND day(ts) % 5 = 0 THEN low - 1 ELSE high END AS h FROM bars)"""

GAPS = """SELECT symbol, timeframe, p AS gap_start, ts AS gap_end FROM (
    SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars5)
  WHERE ts - p > INTERVAL '30 minutes' AND CAST(p AS DATE) = CAST(ts AS DATE)"""


@query("v1_intraday_gaps", sql("SELECT * FROM g", "bars5", g=GAPS))
def _(spark, d):
    return Q.gaps(T.bars(spark, d, "5m"))


@query("v1_first_gaps", sql("""
  SELECT symbol, timeframe, gap_start, gap_end, CAST(n AS INTEGER) AS gap_no, gap_count FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY gap_start) AS n,
           count(*) OVER (PARTITION BY symbol) AS gap_count FROM g) WHERE n <= 3""", "bars5", g=GAPS))
def _(spark, d):
    return Q.first_gaps(T.bars(spark, d, "5m"))


@query("v2_ohlc_geometry", sql("""
  SELECT symbol, timeframe, count(*) FILTER (high < low) AS high_below_low,
         count(*) FILTER (high < open OR high < close) AS high_low_body,
         count(*) FILTER (low > open OR low > close) AS low_high_body
  FROM dirty GROUP BY 1, 2""", "bars", dirty=DIRTY))
def _(spark, d):
    return Q.geometry(dirty(spark, d))


@query("v3_volume_outliers", sql(f"""
  SELECT b.symbol, b.timeframe, ts, volume FROM bars b JOIN (
    SELECT symbol, avg(volume) AS m, stddev_samp(volume) AS s FROM bars GROUP BY symbol) q
  ON b.symbol = q.symbol WHERE s > 0 AND abs((volume - m) / s) > 2.0""", "bars"))
def _(spark, d):
    return Q.volume_outliers(T.bars(spark, d), 2.0).select("symbol", "timeframe", "ts", "volume")


@query("v4_average_outside_range", sql("""
  SELECT symbol, timeframe, count(*) FILTER (average < low OR average > high) AS average_outside
  FROM dirty GROUP BY 1, 2""", "bars", dirty=DIRTY))
def _(spark, d):
    return dirty(spark, d).groupBy("symbol", "timeframe").agg(
        F.count_if(Q.is_average_outside()).alias("average_outside"))


@query("v5_roll_jumps", sql(f"""
  SELECT symbol, timeframe, ts, {r('chg', 6, 'change')} FROM (
    SELECT *, lag(contract) OVER w AS pcon, abs(close / lag(close) OVER w - 1) AS chg FROM bars
    WINDOW w AS (PARTITION BY symbol ORDER BY ts))
  WHERE pcon IS DISTINCT FROM contract AND chg > 0.08""", "bars"))
def _(spark, d):
    return Q.roll_jumps(T.bars(spark, d)).withColumn("change", rd("change", 6))


SCORED = """
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (gaps + 10 * (high_below_low + high_low_body
    + low_high_body) + volume_outliers + 25 * (average_outside + roll_jumps)) / total_bars)) AS quality_score
  FROM (SELECT symbol, timeframe, count(*) AS total_bars,
      count(*) FILTER (ts - p > INTERVAL '180 minutes' AND CAST(p AS DATE) = CAST(ts AS DATE)) AS gaps,
      count(*) FILTER (high < low) AS high_below_low,
      count(*) FILTER (high < open OR high < close) AS high_low_body,
      count(*) FILTER (low > open OR low > close) AS low_high_body,
      count(*) FILTER (s > 0 AND abs((volume - m) / s) > 2.5) AS volume_outliers,
      count(*) FILTER (average < low OR average > high) AS average_outside,
      count(*) FILTER (pcon IS DISTINCT FROM contract AND abs(close / pc - 1) > 0.08) AS roll_jumps
    FROM (SELECT *, lag(ts) OVER w AS p, lag(contract) OVER w AS pcon, lag(close) OVER w AS pc,
            avg(volume) OVER (PARTITION BY symbol) AS m, stddev_samp(volume) OVER (PARTITION BY symbol) AS s
          FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY 1, 2)"""
SCORE_OUT = f"""SELECT symbol, timeframe, total_bars, gaps, high_below_low, high_low_body, low_high_body,
  volume_outliers, average_outside, roll_jumps, {r('quality_score', 6, 'quality_score')},
  quality_score >= 0.95 AND average_outside + roll_jumps = 0 AS is_valid FROM s"""


@query("v6_quality_score", sql(SCORE_OUT, "bars", s=SCORED.format(src="bars")))
def _(spark, d):
    return Q.validate(T.bars(spark, d), 2.5).withColumn("quality_score", rd("quality_score", 6))


@query("v7_validate_lake", sql(SCORE_OUT, "bars", dirty=DIRTY, s=SCORED.format(src="dirty").replace("2.5", "5.0")))
def _(spark, d):
    return Q.validate_lake(dirty(spark, d), timeframes=["1h"]).withColumn("quality_score", rd("quality_score", 6))


@query("v8_quality_report", sql(f"""
  SELECT symbol, timeframe, CASE WHEN quality_score >= 0.95 AND average_outside + roll_jumps = 0
         THEN 'PASS' ELSE 'FAIL' END AS status, {r('quality_score', 6, 'quality_score')},
    list_filter([
      CASE WHEN gaps > 0 THEN 'steps above the gap limit: ' || gaps END,
      CASE WHEN high_below_low > 0 THEN 'high below low: ' || high_below_low END,
      CASE WHEN high_low_body > 0 THEN 'high below open or close: ' || high_low_body END,
      CASE WHEN low_high_body > 0 THEN 'low above open or close: ' || low_high_body END,
      CASE WHEN volume_outliers > 0 THEN 'volume outliers: ' || volume_outliers END,
      CASE WHEN average_outside > 0 THEN 'average outside range: ' || average_outside END,
      CASE WHEN roll_jumps > 0 THEN 'suspicious rolls: ' || roll_jumps END],
      lambda x: x IS NOT NULL)[1:5] AS issues
  FROM s""", "bars", dirty=DIRTY, s=SCORED.format(src="dirty")))
def _(spark, d):
    return Q.report(Q.validate(dirty(spark, d), 2.5)).withColumn("quality_score", rd("quality_score", 6))


@query("v8_report_totals", sql("""
  SELECT count(*) FILTER (quality_score >= 0.95 AND average_outside + roll_jumps = 0) AS passed,
         count(*) AS total FROM s""", "bars", s=SCORED.format(src="bars")))
def _(spark, d):
    return Q.report_totals(Q.validate(T.bars(spark, d), 2.5))
