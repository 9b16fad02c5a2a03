"""R: risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import CTES, query, r, sql
from barlattice.catalog.pnl import long_daily
from barlattice.functions.exprs import rd
from barlattice.operators import pnl as L
from barlattice.operators import risk as R
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle

CTES["dd"] = (("hourly",), """SELECT *, (equity - pk) / nullif(pk, 0) * 100 AS ddp FROM (
  SELECT *, max(equity) OVER (PARTITION BY stream ORDER BY ts) AS pk FROM hourly)""")
CTES["episodes"] = (("dd",), """
  SELECT stream, min(ts) FILTER (ddp < 0) AS start_ts, arg_min(ts, ddp) FILTER (ddp < 0 AND ddp = mn) AS t0, min(ts) FILTER (ddp = mn) AS trough_ts,
    coalesce(min(ts) FILTER (ddp >= 0), max(ts)) AS end_ts, min(ddp) AS depth
  FROM (SELECT *, min(ddp) OVER (PARTITION BY stream, ep) AS mn FROM (
    SELECT *, sum(up) OVER (PARTITION BY stream ORDER BY ts) - up AS ep FROM (SELECT *, CASE WHEN ddp >= 0 THEN 1 ELSE 0 END AS up FROM dd)))
  GROUP BY stream, ep HAVING count(*) FILTER (ddp < 0) > 0""")
DAYS = "(epoch_us(end_ts) - epoch_us(start_ts)) / 8.64e10::DOUBLE"


@query("r1_drawdown", sql(f"SELECT stream, ts, {r('ddp', 6, 'drawdown_pct')} FROM dd", "dd"))
def _(spark, d):
    return R.drawdown(T.hourly_equity(spark, d)).select("stream", "ts", rd("drawdown_pct", 6).alias("drawdown_pct"))


@query("r2_drawdown_episodes", sql(f"""SELECT stream, start_ts, trough_ts, end_ts, {r('depth', 6, 'depth_pct')}, {r('abs(depth)', 6, 'depth_abs_pct')},
  {r(DAYS, 6, 'duration_days')} FROM episodes""", "episodes"))
def _(spark, d):
    e = R.episodes(R.drawdown(settle(T.hourly_equity(spark, d))))
    return e.withColumns({c: rd(c, 6) for c in ("depth_pct", "depth_abs_pct", "duration_days")})


CTES["tails"] = (("longpnl",), """SELECT stream, greatest(0, -any_value(q1)) AS var_primary, greatest(0, -avg(pnl) FILTER (pnl <= q1)) AS es_primary,
    greatest(0, -any_value(q2)) AS var_tail, greatest(0, -avg(pnl) FILTER (pnl <= q2)) AS es_tail
  FROM (SELECT *, quantile_cont(pnl, 0.05) OVER (PARTITION BY stream) AS q1, quantile_cont(pnl, 0.01) OVER (PARTITION BY stream) AS q2 FROM longpnl) GROUP BY 1""")
TAILS = ["var_primary", "es_primary", "var_tail", "es_tail"]


@query("r3_var_es", sql("SELECT stream, " + ", ".join(r(c, 4, c) for c in TAILS) + " FROM tails", "tails"))
def _(spark, d):
    return R.var_es(long_daily(spark, d), 0.95, 0.99).select("stream", *[rd(c, 4).alias(c) for c in TAILS])


ROLL = "(PARTITION BY stream ORDER BY day ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


@query("r4_rolling_var_es", sql(f"""SELECT stream, day, {r('pnl', 4, 'pnl')}, {r('v1', 4, 'var_primary')}, {r('e1', 4, 'es_primary')}, {r('v2', 4, 'var_tail')}, {r('e2', 4, 'es_tail')},
    coalesce(pnl <= -v1, false) AS breach_primary, coalesce(pnl <= -v2, false) AS breach_tail
  FROM (SELECT *, CASE WHEN q1 IS NOT NULL THEN greatest(0, -q1) END AS v1, CASE WHEN q2 IS NOT NULL THEN greatest(0, -q2) END AS v2,
      greatest(0, -list_avg(list_filter(l, lambda x: x <= q1))) AS e1x, CASE WHEN q1 IS NOT NULL THEN greatest(0, -list_avg(list_filter(l, lambda x: x <= q1))) END AS e1,
      CASE WHEN q2 IS NOT NULL THEN greatest(0, -list_avg(list_filter(l, lambda x: x <= q2))) END AS e2
    FROM (SELECT *, list(pnl) OVER {ROLL} AS l, CASE WHEN count(pnl) OVER {ROLL} >= 50 THEN quantile_cont(pnl, 0.05) OVER {ROLL} END AS q1,
        CASE WHEN count(pnl) OVER {ROLL} >= 50 THEN quantile_cont(pnl, 0.01) OVER {ROLL} END AS q2 FROM longpnl))""", "longpnl"))
def _(spark, d):
    x = R.rolling_var_es(long_daily(spark, d), 100, 0.95, 0.99)
    return x.select("stream", "day", *[rd(c, 4).alias(c) for c in ("pnl", *TAILS)], "breach_primary", "breach_tail")


def vol_sql(n):
    w = f"(PARTITION BY stream ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(ret) OVER {w} >= {max(n // 2, 5)} THEN stddev_samp(ret) OVER {w} * sqrt(252) * 100 END"


@query("r5_rolling_volatility", sql(f"""SELECT stream, day, {', '.join(r(vol_sql(n), 4, f'vol_{n}d') for n in (20, 50, 100))}
  FROM (SELECT * FROM longpnl WHERE ret IS NOT NULL)""", "longpnl"))
def _(spark, d):
    return R.rolling_volatility(long_daily(spark, d)).select("stream", "day", *[rd(f"vol_{n}d", 4).alias(f"vol_{n}d") for n in (20, 50, 100)])


@query("r6_annualised_sharpe", sql(f"SELECT stream, {r('avg(ret) / stddev_samp(ret) * sqrt(252)', 6, 'sharpe')} FROM longpnl GROUP BY 1", "longpnl"))
def _(spark, d):
    return R.daily_sharpe(long_daily(spark, d)).withColumn("sharpe", rd("sharpe", 6))


W90 = "(PARTITION BY stream ORDER BY day ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"


@query("r7_rolling_sharpe", sql(f"""SELECT stream, day, {r(f'CASE WHEN count(ret) OVER {W90} >= 45 AND stddev_samp(ret) OVER {W90} > 1e-8 THEN avg(ret) OVER {W90} / stddev_samp(ret) OVER {W90} * sqrt(252) END', 5, 'rolling_sharpe')}
  FROM (SELECT * FROM longpnl WHERE ret IS NOT NULL)""", "longpnl"))
def _(spark, d):
    return R.rolling_sharpe(long_daily(spark, d), 90).select("stream", "day", rd("rolling_sharpe", 5).alias("rolling_sharpe"))


for _h, _label, _m in (("1d", "day", 252), ("1w", "CAST(date_trunc('week', day) AS DATE) + 6", 52), ("1m", "last_day(day)", 12)):
    @query(f"r8_horizon_sharpe_{_h}", sql(f"""SELECT stream, {r(f'(avg(pr) - (pow(1.02::DOUBLE, 1.0 / {_m}) - 1)) / stddev_samp(pr) * sqrt({_m})', 5, 'sharpe')} FROM (
      SELECT stream, {_label} AS period, product(1 + ret) - 1 AS pr FROM longpnl WHERE ret IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "longpnl"))
    def _(spark, d, h=_h):
        return R.horizon_sharpe(long_daily(spark, d), h, rf=0.02).withColumn("sharpe", rd("sharpe", 5))


DIGITS = {"total_pnl": 4, "sharpe": 5, "var_primary": 4, "es_primary": 4, "var_tail": 4, "es_tail": 4, "max_drawdown_pct": 5,
          "avg_drawdown_pct": 5, "median_drawdown_pct": 5, "drawdown_95_pct": 5, "max_drawdown_duration_days": 5, "latest_vol_pct": 5}
SUMMARY = f"""SELECT d.stream, {', '.join(r(c, n, c) for c, n in DIGITS.items())} FROM (
    SELECT stream, sum(pnl) AS total_pnl, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, greatest(0, -any_value(q1)) AS var_primary,
      greatest(0, -avg(pnl) FILTER (pnl <= q1)) AS es_primary, greatest(0, -any_value(q2)) AS var_tail, greatest(0, -avg(pnl) FILTER (pnl <= q2)) AS es_tail
    FROM (SELECT *, quantile_cont(pnl, 0.05) OVER (PARTITION BY stream) AS q1, quantile_cont(pnl, 0.01) OVER (PARTITION BY stream) AS q2 FROM daypnl) GROUP BY 1) d
  JOIN (SELECT stream, abs(min(ddp)) AS max_drawdown_pct FROM dd GROUP BY 1) m ON m.stream = d.stream
  LEFT JOIN (SELECT stream, avg(abs(depth)) AS avg_drawdown_pct, quantile_cont(abs(depth), 0.5) AS median_drawdown_pct, quantile_cont(abs(depth), 0.95) AS drawdown_95_pct,
      max({DAYS}) AS max_drawdown_duration_days FROM episodes GROUP BY 1) e ON e.stream = d.stream
  LEFT JOIN (SELECT stream, arg_max(v, day) AS latest_vol_pct FROM (SELECT stream, day, coalesce({vol_sql(5)}, {vol_sql(20)}) AS v FROM (SELECT * FROM daypnl WHERE ret IS NOT NULL))
      WHERE v IS NOT NULL GROUP BY 1) v ON v.stream = d.stream"""


def summary(spark, d, eq):
    return R.risk_summary(eq, windows=(5, 20)).select("stream", *[rd(c, n).alias(c) for c, n in DIGITS.items()])


@query("r9_risk_summary", sql(SUMMARY, "daypnl", "episodes"))
def _(spark, d):
    return summary(spark, d, settle(T.hourly_equity(spark, d)))


CTES["weighted"] = (("slot_hist", "hist"), """SELECT 'slot_' || CAST(s.slot_id AS VARCHAR) AS stream, s.ts, s.cum_pnl + h.v * w AS equity FROM slot_hist s
  JOIN (VALUES (0, 0.5::DOUBLE), (1, 0.3), (2, 0.2)) AS w(slot_id, w) ON w.slot_id = s.slot_id JOIN (SELECT arg_min(total_value, ts) AS v FROM hist) h ON true
  UNION ALL SELECT 'portfolio', ts, total_value FROM hist""")


@query("r10_risk_by_scope", sql(
    SUMMARY.replace("daypnl", "wday").replace("FROM dd ", "FROM wdd ").replace("FROM episodes ", "FROM wep "), "weighted",
    wday=CTES["daypnl"][1].replace("FROM hourly", "FROM weighted"), wdd=CTES["dd"][1].replace("FROM hourly", "FROM weighted"),
    wep=CTES["episodes"][1].replace("FROM dd)", "FROM wdd)")))
def _(spark, d):
    w = spark.createDataFrame(list(T.WEIGHTS.items()), "slot_id INT, weight DOUBLE")
    sh = settle(T.slot_history(spark, d))
    hi = T.run_totals(sh)
    slots = L.slot_equity(sh, hi, w).select(F.concat(F.lit("slot_"), F.col("slot_id").cast("string")).alias("stream"), "ts", "equity")
    total = hi.select(F.lit("portfolio").alias("stream"), "ts", F.col("total_value").alias("equity"))
    return summary(spark, d, settle(slots.unionByName(total)))


CTES["costs"] = (("trades",), """SELECT 'slot_' || CASE strategy WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE '2' END AS stream, CAST(exit_time AS DATE) AS day,
    sum(commission) AS commission, abs(sum(slippage)) AS slippage FROM trades GROUP BY 1, 2""")


def costs(spark, d):
    t = T.trades(spark, d).withColumn("stream", F.concat(F.lit("slot_"), F.when(F.col("strategy") == "A", "0").when(F.col("strategy") == "N", "1").otherwise("2")))
    return R.daily_costs(t, ["stream"])


@query("r11_daily_costs", sql(f"SELECT stream, day, {r('commission', 6, 'commission')}, {r('slippage', 6, 'slippage')} FROM costs", "costs"))
def _(spark, d):
    return costs(spark, d).withColumns({"commission": rd("commission", 6), "slippage": rd("slippage", 6)})


CTES["paths"] = (("longpnl", "costs"), """
  SELECT stream, day, scenario, pnl, st + sum(pnl) OVER (PARTITION BY stream, scenario ORDER BY day) AS equity FROM (
    SELECT p.stream, p.day, st, scenario, CASE scenario WHEN 'baseline' THEN b WHEN 'volatility' THEN v WHEN 'slippage' THEN b - sl WHEN 'commission' THEN b - cm ELSE v - sl - cm END AS pnl
    FROM (SELECT l.stream, l.day, CASE WHEN rn = 1 THEN 0 ELSE pnl END AS b, CASE WHEN rn = 1 THEN 0 ELSE mu + (pnl - mu) * 1.5::DOUBLE END AS v, st,
            coalesce(c.slippage, 0) * 1.0::DOUBLE AS sl, coalesce(c.commission, 0) * -0.5::DOUBLE AS cm
      FROM (SELECT *, avg(pnl) FILTER (rn > 1) OVER (PARTITION BY stream) AS mu, first_value(equity) OVER (PARTITION BY stream ORDER BY day) AS st
            FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY day) AS rn FROM longpnl)) l
      LEFT JOIN costs c ON c.stream = l.stream AND c.day = l.day) p
    CROSS JOIN (VALUES ('baseline'), ('volatility'), ('slippage'), ('commission'), ('combined')) AS s(scenario))""")
MULT = {"volatility": 1.5, "slippage": 2.0, "commission": 0.5}


@query("r12_stress_paths", sql(f"""SELECT stream, day, scenario, {r('pnl', 4, 'pnl')}, {r('equity', 3, 'equity')} FROM paths""", "paths"))
def _(spark, d):
    return R.stress_paths(long_daily(spark, d), costs(spark, d), MULT).withColumns({"pnl": rd("pnl", 4), "equity": rd("equity", 3)})


STRESS = ["final_pnl", "end_equity", "max_drawdown_pct", "sharpe", *TAILS, "pnl_delta"]


@query("r13_stress_metrics", sql(f"""
  SELECT stream, scenario, {', '.join(r(c, 3, c) for c in STRESS[:-1])}, {r("final_pnl - max(final_pnl) FILTER (scenario = 'baseline') OVER (PARTITION BY stream)", 3, 'pnl_delta')}
  FROM (SELECT stream, scenario, sum(pnl) AS final_pnl, arg_max(equity, day) AS end_equity, abs(min(ddp)) AS max_drawdown_pct, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
      greatest(0, -any_value(q1)) AS var_primary, greatest(0, -avg(pnl) FILTER (pnl <= q1)) AS es_primary, greatest(0, -any_value(q2)) AS var_tail, greatest(0, -avg(pnl) FILTER (pnl <= q2)) AS es_tail
    FROM (SELECT *, (equity - max(equity) OVER w) / nullif(max(equity) OVER w, 0) * 100 AS ddp, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret,
        quantile_cont(pnl, 0.05) OVER (PARTITION BY stream, scenario) AS q1, quantile_cont(pnl, 0.01) OVER (PARTITION BY stream, scenario) AS q2
      FROM paths WINDOW w AS (PARTITION BY stream, scenario ORDER BY day)) GROUP BY 1, 2)""", "paths"))
def _(spark, d):
    m = R.stress_metrics(R.stress_paths(long_daily(spark, d), costs(spark, d), MULT))
    return m.select("stream", "scenario", *[rd(c, 3).alias(c) for c in STRESS])
