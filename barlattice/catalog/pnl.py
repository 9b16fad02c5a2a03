"""L: PnL transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import CTES, query, r, sql
from barlattice.functions.exprs import rd
from barlattice.operators import pnl as L
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle

CTES["barpnl"] = (("slot_hist",), """SELECT run_id, slot_id, ts, coalesce(cum_pnl - lag(cum_pnl) OVER (PARTITION BY slot_id ORDER BY ts), 0) AS pnl
  FROM slot_hist""")
CTES["daypnl"] = (("hourly",), """SELECT stream, day, equity, coalesce(equity - lag(equity) OVER (PARTITION BY stream ORDER BY day), 0) AS pnl,
    equity / nullif(lag(equity) OVER (PARTITION BY stream ORDER BY day), 0) - 1 AS ret
  FROM (SELECT stream, CAST(ts AS DATE) AS day, arg_max(equity, ts) AS equity FROM hourly GROUP BY 1, 2)""")
CTES["longpnl"] = (("dayeq",), """SELECT stream, slot_id, day, equity, coalesce(equity - lag(equity) OVER (PARTITION BY stream ORDER BY day), 0) AS pnl,
    equity / nullif(lag(equity) OVER (PARTITION BY stream ORDER BY day), 0) - 1 AS ret FROM dayeq""")


def long_daily(spark, d):
    return L.with_daily_change(T.daily_equity(spark, d).drop("slot_id", "ts"), ["stream"])


@query("l1_bar_pnl", sql(f"SELECT run_id, slot_id, ts, {r('pnl', 4, 'pnl')} FROM barpnl", "barpnl"))
def _(spark, d):
    return L.bar_pnl(T.slot_history(spark, d)).withColumn("pnl", rd("pnl", 4))


def gappy(spark, d):
    """Day PnL per status on order days of odd-priced totals only, so days are missing."""
    return T.daily_slot_pnl(spark, d).select(F.lit("0").alias("run_id"), "slot_id", F.col("day").cast("timestamp_ntz").alias("ts"), "pnl")


for _h, _label, _seq in (
    ("1d", "day", "unnest(generate_series(a, z, INTERVAL 1 DAY))"),
    ("1w", "CAST(date_trunc('week', day) AS DATE) + 6", "unnest(generate_series(a, z, INTERVAL 7 DAY))"),
    ("1m", "last_day(day)", "last_day(unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)))"),
):
    @query(f"l2_resample_{_h}", sql(f"""
      SELECT '0' AS run_id, s.slot_id, s.period, {r('coalesce(p.pnl, 0)', 5, 'pnl')} FROM (
        SELECT slot_id, CAST({_seq} AS DATE) AS period FROM (SELECT slot_id, min({_label}) AS a, max({_label}) AS z FROM dayslot GROUP BY 1)) s
      LEFT JOIN (SELECT slot_id, {_label} AS period, sum(pnl) AS pnl FROM dayslot GROUP BY 1, 2) p ON p.slot_id = s.slot_id AND p.period = s.period""", "dayslot"))
    def _(spark, d, h=_h):
        return L.resample(gappy(spark, d), h).withColumn("pnl", rd("pnl", 5))


DIST = f"""SELECT {{k}}, {r('CASE WHEN n > 2 AND sd > 0 THEN m3 / pow(m2, 1.5) END', 4, 'skew')}, {r('CASE WHEN n > 2 AND sd > 0 THEN m4 / (m2 * m2) - 3 END', 4, 'kurtosis')},
    {r('greatest(0, -q1)', 2, 'var_95')}, {r('greatest(0, -e1)', 2, 'cvar_95')}, {r('greatest(0, -q2)', 2, 'var_99')}, {r('mu', 2, 'mean')}, {r('sd', 2, 'std')}
  FROM (SELECT {{k}}, count(*) AS n, any_value(mu) AS mu, stddev_samp(pnl) AS sd, avg((pnl - mu) ** 2) AS m2, avg((pnl - mu) ** 3) AS m3,
      avg((pnl - mu) ** 4) AS m4, any_value(q1) AS q1, any_value(q2) AS q2, avg(pnl) FILTER (pnl <= q1) AS e1
    FROM (SELECT *, avg(pnl) OVER (PARTITION BY {{k}}) AS mu, quantile_cont(pnl, 0.05) OVER (PARTITION BY {{k}}) AS q1,
        quantile_cont(pnl, 0.01) OVER (PARTITION BY {{k}}) AS q2 FROM {{src}}) GROUP BY {{k}})"""


@query("l3_pnl_distribution", sql(DIST.format(k="stream", src="longpnl"), "longpnl"))
def _(spark, d):
    return L.distribution(long_daily(spark, d))


@query("l4_slot_equity", sql(f"""SELECT s.run_id, s.slot_id, s.ts, {r('s.cum_pnl + h.v * w', 4, 'equity')} FROM slot_hist s
  JOIN (VALUES (0, 0.5::DOUBLE), (1, 0.3), (2, 0.2)) AS w(slot_id, w) ON w.slot_id = s.slot_id
  JOIN (SELECT run_id, arg_min(total_value, ts) AS v FROM hist GROUP BY 1) h ON h.run_id = s.run_id""", "slot_hist", "hist"))
def _(spark, d):
    w = spark.createDataFrame(list(T.WEIGHTS.items()), "slot_id INT, weight DOUBLE")
    sh = settle(T.slot_history(spark, d))
    return L.slot_equity(sh, T.run_totals(sh), w).withColumn("equity", rd("equity", 4))


@query("l5_daily_pnl", sql(f"SELECT stream, day, {r('equity', 4, 'equity')}, {r('pnl', 4, 'pnl')} FROM daypnl", "daypnl"))
def _(spark, d):
    return L.daily_pnl(T.hourly_equity(spark, d)).withColumns({"equity": rd("equity", 4), "pnl": rd("pnl", 4)})


CTES["snap"] = (("dayslot",), """SELECT s.slot_id, s.day, q.cum AS snapshot FROM (
    SELECT slot_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT slot_id, min(day) AS a, max(day) AS z FROM dayslot GROUP BY 1)) s
  LEFT JOIN (SELECT slot_id, day, sum(pnl) OVER (PARTITION BY slot_id ORDER BY day) AS cum FROM dayslot) q ON q.slot_id = s.slot_id AND q.day = s.day""")


def snapshots(spark, d):
    e = T.daily_equity(spark, d)
    return e.select(F.lit("0").alias("run_id"), "slot_id", "ts", (F.col("equity") - 1000000.0).alias("cum_pnl"))


@query("l6_daily_slot_export", sql(f"""SELECT '0' AS run_id, slot_id, day, {r('v - coalesce(lag(v) OVER (PARTITION BY slot_id ORDER BY day), 0)', 4, 'pnl')} FROM (
  SELECT *, coalesce(last_value(snapshot IGNORE NULLS) OVER (PARTITION BY slot_id ORDER BY day), 0) AS v FROM snap)""", "snap"))
def _(spark, d):
    return L.daily_slot_export(snapshots(spark, d)).withColumn("pnl", rd("pnl", 4))


@query("l6_daily_slot_export_zero_fill", sql(f"""SELECT '0' AS run_id, slot_id, day, {r('v - coalesce(lag(v) OVER (PARTITION BY slot_id ORDER BY day), 0)', 4, 'pnl')} FROM (
  SELECT *, coalesce(snapshot, 0) AS v FROM snap)""", "snap"))
def _(spark, d):
    return L.daily_slot_export(snapshots(spark, d), legacy_zero_fill=True).withColumn("pnl", rd("pnl", 4))


@query("l7_benchmark_pnl", sql(f"""SELECT h.run_id, h.ts, {r('(b.close / first_value(b.close) OVER (ORDER BY h.ts) - 1) * first_value(h2.v) OVER (ORDER BY h.ts)', 4, 'pnl')}
  FROM hist h JOIN bars b ON b.ts = h.ts AND b.symbol = 'view' JOIN (SELECT arg_min(total_value, ts) AS v FROM hist) h2 ON true""", "hist", "bars"))
def _(spark, d):
    b = T.bars(spark, d).where(F.col("symbol") == "view")
    return L.benchmark_pnl(T.history(spark, d), b).withColumn("pnl", rd("pnl", 4))


@query("l8_pnl_by_direction", sql(f"""SELECT run_id, direction, ts, {r('sum(p) OVER (PARTITION BY direction ORDER BY ts)', 4, 'cum_pnl')} FROM (
  SELECT h.run_id, k.direction, h.ts, coalesce(t.p, 0) AS p FROM hist h CROSS JOIN (SELECT DISTINCT direction FROM itrades) k
  LEFT JOIN (SELECT direction, exit_time, sum(pnl) AS p FROM itrades GROUP BY 1, 2) t ON t.direction = k.direction AND t.exit_time = h.ts)""", "hist", "itrades"))
def _(spark, d):
    return L.pnl_by_direction(T.intraday_trades(spark, d), T.history(spark, d)).withColumn("cum_pnl", rd("cum_pnl", 4))


@query("l9_pnl_histogram", sql(f"""
  SELECT s.stream, s.bin, {r('a + (s.bin + 0.5) * w', 4, 'center')}, coalesce(n, 0) AS value FROM (
    SELECT *, unnest(range(bins)) AS bin FROM b) s
  LEFT JOIN (SELECT l.stream, CAST(least(floor((pnl - a) / w), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM longpnl l JOIN b ON b.stream = l.stream GROUP BY 1, 2) c
    ON c.stream = s.stream AND c.bin = s.bin""", "longpnl", b="""
  SELECT stream, lo AS a, bins, (hi - lo) / bins AS w FROM (SELECT *, CAST(least(greatest(20, least(160, n)), greatest(ceil(log2(n) + 1),
      ceil((hi - lo) / (2 * iqr / cbrt(n))), least(120, greatest(30, least(40, greatest(10, floor(sqrt(n)))) * 3)))) AS BIGINT) AS bins
    FROM (SELECT stream, count(*) AS n, min(pnl) AS lo, max(pnl) AS hi, quantile_cont(pnl, 0.75) - quantile_cont(pnl, 0.25) AS iqr FROM longpnl GROUP BY 1))"""))
def _(spark, d):
    return L.histogram(long_daily(spark, d)).withColumn("center", rd("center", 4))


@query("l10_thinned_curve", sql(f"""SELECT stream, ts, {r('equity', 4, 'equity')} FROM (
  SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts) AS rn, count(*) OVER (PARTITION BY stream) AS n FROM hourly)
  WHERE n <= 200 OR (rn - 1) % greatest(1, n // 200) = 0 OR rn = n""", "hourly"))
def _(spark, d):
    return L.thin(T.hourly_equity(spark, d), ["stream"], 200).withColumn("equity", rd("equity", 4))


@query("l11_capped_log_equity", sql(f"""SELECT stream, ts, {r('ln(greatest(greatest(equity / 100000.0::DOUBLE - 1, -0.015) + 1, 0.01))', 6, 'log_equity')} FROM hourly""", "hourly"))
def _(spark, d):
    return T.hourly_equity(spark, d).select("stream", "ts", rd(L.capped_log_equity(F.col("equity"), 100000.0, -1.5, 0.01), 6).alias("log_equity"))
