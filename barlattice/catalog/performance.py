"""M: performance metrics."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from barlattice.catalog.core import CTES, phi, query, r, sql, t_tails
from barlattice.functions.exprs import rd
from barlattice.operators import metrics as M
from barlattice.operators.pnl import YEAR
from barlattice.operators.risk import risk_summary
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle

CTES["path"] = (("hourly",), """
  SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY stream ORDER BY ts), 0) - 1 AS ret,
    max(equity) OVER (PARTITION BY stream ORDER BY ts) AS peak FROM hourly""")
CTES["perf"] = (("path",), """
  SELECT *, CASE WHEN 1 + total_return > 0 THEN pow(1 + total_return, 1 / years) - 1 ELSE 0 END AS cagr,
    std_ret * sqrt(n_bars / years) AS volatility FROM (
    SELECT *, last_equity - first_equity AS total_pnl, last_equity / first_equity - 1 AS total_return,
      CASE WHEN days > 0 THEN days / 365.25::DOUBLE ELSE 1.0 END AS years,
      m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurt, mean_ret / std_ret AS ss FROM (
      SELECT stream, count(*) AS n_bars, count(ret) AS n_ret, avg(ret) AS mean_ret, stddev_samp(ret) AS std_ret,
        stddev_samp(ret) FILTER (ret < 0) AS std_neg, min((equity - peak) / peak) AS max_drawdown,
        arg_min(equity, ts) AS first_equity, arg_max(equity, ts) AS last_equity,
        (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS days,
        avg((ret - mu) ** 2) AS m2, avg((ret - mu) ** 3) AS m3, avg((ret - mu) ** 4) AS m4
      FROM (SELECT p.*, avg(ret) OVER (PARTITION BY stream) AS mu FROM path p) GROUP BY stream))""")


def perf(spark, d):
    return M.aggregate_path(M.equity_path(settle(T.hourly_equity(spark, d))), ["stream"])


def upto(df, last):
    for name, value in M.summary_columns().items():
        df = df.withColumn(name, value)
        if name == last:
            break
    return df


@query("m1_sample_sharpe", sql(f"SELECT stream, {r('ss', 6, 'sample_sharpe')} FROM perf", "perf"))
def _(spark, d):
    m = M.return_moments(M.equity_path(settle(T.hourly_equity(spark, d))), ["stream"])
    return m.select("stream", rd(M.sample_sharpe(F.col("mean_ret"), F.col("std_ret")), 6).alias("sample_sharpe"))


@query("m2_total_return", sql(f"SELECT stream, {r('total_pnl', 4, 'total_pnl')}, {r('total_return', 6, 'total_return')} FROM perf", "perf"))
def _(spark, d):
    return upto(perf(spark, d), "total_return").select("stream", rd("total_pnl", 4).alias("total_pnl"), rd("total_return", 6).alias("total_return"))


@query("m3_years_bars_per_year", sql(f"SELECT stream, n_bars, {r('years', 6, 'years')}, {r('n_bars / years', 4, 'bars_per_year')} FROM perf", "perf"))
def _(spark, d):
    return upto(perf(spark, d), "bars_per_year").select("stream", "n_bars", rd("years", 6).alias("years"), rd("bars_per_year", 4).alias("bars_per_year"))


@query("m4_cagr", sql(f"SELECT stream, {r('cagr', 5, 'cagr')} FROM perf", "perf"))
def _(spark, d):
    return upto(perf(spark, d), "cagr").select("stream", rd("cagr", 5).alias("cagr"))


@query("m5_annualised_volatility", sql(f"SELECT stream, {r('volatility', 6, 'volatility')} FROM perf", "perf"))
def _(spark, d):
    return upto(perf(spark, d), "volatility").select("stream", rd("volatility", 6).alias("volatility"))


@query("m6_sharpe", sql(f"SELECT stream, {r('(cagr - 0.02) / volatility', 4, 'sharpe')} FROM perf", "perf"))
def _(spark, d):
    return M.performance(settle(T.hourly_equity(spark, d)), rf=0.02).select("stream", rd("sharpe", 4).alias("sharpe"))


@query("m7_sortino", sql(f"SELECT stream, {r('cagr / (std_neg * sqrt(n_bars / years))', 4, 'sortino')} FROM perf", "perf"))
def _(spark, d):
    return upto(perf(spark, d), "sortino").select("stream", rd("sortino", 4).alias("sortino"))


@query("m8_max_drawdown", sql(f"SELECT stream, {r('max_drawdown', 6, 'max_drawdown')} FROM perf", "perf"))
def _(spark, d):
    return perf(spark, d).select("stream", rd("max_drawdown", 6).alias("max_drawdown"))


@query("m9_calmar", sql(f"SELECT stream, {r('cagr / abs(max_drawdown)', 3, 'calmar')} FROM perf", "perf"))
def _(spark, d):
    return upto(perf(spark, d), "calmar").select("stream", rd("calmar", 3).alias("calmar"))


def trial_sharpes(spark, d):
    """Every fold's trial Sharpe ratios, attached to every stream of hourly equity."""
    t = T.fold_trials(spark, d).select((F.col("sharpe") * 0.1).alias("sharpe"))
    return t.withColumn("stream", F.explode(F.array(*[F.lit(s) for s in ("portfolio", "slot_0", "slot_1", "slot_2")])))


_A, _B = NormalDist().inv_cdf(1 - 1 / 50), NormalDist().inv_cdf(1 - 1 / (50 * math.e))


@query("m10_deflated_sharpe", sql(f"""SELECT stream, {r(phi('z'), 6, 'dsr')}, {r('star', 6, 'sr_star')} FROM (
    SELECT stream, star, (ss - star) / sqrt((1 - skew * ss + (kurt - 1) / 4 * ss * ss) / (n_ret - 1)) AS z FROM perf
    CROSS JOIN (SELECT avg(s) + stddev_pop(s) * ((1 - 0.5772156649::DOUBLE) * {_A!r}::DOUBLE + 0.5772156649::DOUBLE * {_B!r}::DOUBLE) AS star FROM (SELECT sharpe * 0.1::DOUBLE AS s FROM trials)))""",
    "perf", "trials"))
def _(spark, d):
    m = M.performance(settle(T.hourly_equity(spark, d)), trials=50, trial_sharpes=trial_sharpes(spark, d))
    return m.select("stream", rd("dsr", 6).alias("dsr"), rd("sr_star", 6).alias("sr_star"))


@query("m10_return_shape", sql(f"""SELECT stream, n_ret, {r('skew', 5, 'skew_ret')}, {r('kurt', 5, 'kurt_ret')},
    {r('sqrt((1 - skew * ss + (kurt - 1) / 4 * ss * ss) / (n_ret - 1))', 6, 'sharpe_error')} FROM perf""", "perf"))
def _(spark, d):
    m = M.return_moments(M.equity_path(settle(T.hourly_equity(spark, d))), ["stream"])
    s = M.sample_sharpe(F.col("mean_ret"), F.col("std_ret"))
    err = F.sqrt((1 - F.col("skew_ret") * s + (F.col("kurt_ret") - 1) / 4 * s * s) / (F.col("n_ret") - 1))
    return m.select("stream", "n_ret", rd("skew_ret", 5).alias("skew_ret"), rd("kurt_ret", 5).alias("kurt_ret"), rd(err, 6).alias("sharpe_error"))


@query("m11_return_t_stat", sql(f"SELECT stream, {r('mean_ret / (std_ret / sqrt(n_ret))', 6, 't_stat')} FROM perf", "perf"))
def _(spark, d):
    return upto(perf(spark, d), "t_stat").select("stream", rd("t_stat", 6).alias("t_stat"))


@query("m11_return_p_value", sql(f"""SELECT stream, {r('t', 6, 't_stat')}, {r(t_tails('t', 'n_ret - 1'), 6, 'p_value')}
  FROM (SELECT *, mean_ret / (std_ret / sqrt(n_ret)) AS t FROM perf)""", "perf"))
def _(spark, d):
    return M.performance(settle(T.hourly_equity(spark, d))).select("stream", rd("t_stat", 6).alias("t_stat"), rd("p_value", 6).alias("p_value"))


@query("m12_performance", sql(f"""SELECT stream, {r('total_pnl', 4, 'total_pnl')}, {r('total_return', 6, 'total_return')}, {r('cagr', 5, 'cagr')},
    {r('volatility', 6, 'volatility')}, {r('cagr / volatility', 4, 'sharpe')}, {r('cagr / (std_neg * sqrt(n_bars / years))', 4, 'sortino')},
    {r('max_drawdown', 6, 'max_drawdown')}, {r('cagr / abs(max_drawdown)', 3, 'calmar')}, {r('mean_ret / (std_ret / sqrt(n_ret))', 6, 't_stat')}
  FROM perf""", "perf"))
def _(spark, d):
    digits = {"total_pnl": 4, "total_return": 6, "cagr": 5, "volatility": 6, "sharpe": 4, "sortino": 4, "max_drawdown": 6, "calmar": 3, "t_stat": 6}
    return M.performance(settle(T.hourly_equity(spark, d))).select("stream", *[rd(c, n).alias(c) for c, n in digits.items()])


STATS = f"""count(*) AS total_trades, {r('avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)', 6, 'win_rate')},
    {r('coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl <= 0))', 6, 'profit_factor')}, {r('avg(pnl)', 4, 'avg_trade')},
    {r('coalesce(avg(pnl) FILTER (pnl > 0), 0)', 4, 'avg_win')}, {r('coalesce(avg(pnl) FILTER (pnl <= 0), 0)', 4, 'avg_loss')}"""


def shown_stats(df, *keys):
    return df.select(*keys, "total_trades", rd("win_rate", 6).alias("win_rate"), rd("profit_factor", 6).alias("profit_factor"),
                     *[rd(c, 4).alias(c) for c in ("avg_trade", "avg_win", "avg_loss")])


@query("m13_trade_stats", sql(f"SELECT strategy, {STATS} FROM trades GROUP BY 1", "trades"))
def _(spark, d):
    return shown_stats(M.trade_stats(T.trades(spark, d), ["strategy"]), "strategy")


@query("m14_hold_times", sql(f"""SELECT strategy, {r('max(h)', 4, 'max_hold_min')}, {r('min(h)', 4, 'min_hold_min')}, {r('avg(h)', 4, 'avg_hold_min')}
  FROM (SELECT *, (epoch_us(exit_time) - epoch_us(entry_time)) / 6e7::DOUBLE AS h FROM trades) GROUP BY 1""", "trades"))
def _(spark, d):
    h = M.hold_minutes(T.trades(spark, d), ["strategy"])
    return h.select("strategy", *[rd(c, 4).alias(c) for c in ("max_hold_min", "min_hold_min", "avg_hold_min")])


@query("m15_headline_row", sql(f"""
  SELECT p.stream, {r('total_pnl', 4, 'total_pnl')}, {r('cagr', 5, 'cagr')}, {r('cagr / volatility', 4, 'sharpe')}, {r('max_drawdown', 6, 'max_drawdown')},
    t.*, {r('greatest(0, -v.q)', 4, 'var_primary')}
  FROM perf p JOIN (SELECT slot_id, {STATS}, {r('avg((epoch_us(exit_time) - epoch_us(entry_time)) / 6e7::DOUBLE)', 4, 'avg_hold_min')} FROM itrades GROUP BY 1) t
    ON p.stream = 'slot_' || CAST(t.slot_id AS VARCHAR)
  JOIN (SELECT stream, quantile_cont(pnl, 0.05) AS q FROM (SELECT stream, coalesce(e - lag(e) OVER (PARTITION BY stream ORDER BY day), 0) AS pnl FROM (
      SELECT stream, CAST(ts AS DATE) AS day, arg_max(equity, ts) AS e FROM hourly GROUP BY 1, 2)) GROUP BY 1) v ON v.stream = p.stream""", "perf", "itrades"))
def _(spark, d):
    eq, tr = settle(T.hourly_equity(spark, d)), settle(T.intraday_trades(spark, d))
    stats = shown_stats(M.trade_stats(tr, ["slot_id"]), "slot_id").join(M.hold_minutes(tr, ["slot_id"]).select("slot_id", rd("avg_hold_min", 4).alias("avg_hold_min")), "slot_id")
    stats = stats.withColumn("stream", F.concat(F.lit("slot_"), F.col("slot_id").cast("string")))
    p = M.performance(eq).select("stream", rd("total_pnl", 4).alias("total_pnl"), rd("cagr", 5).alias("cagr"), rd("sharpe", 4).alias("sharpe"), rd("max_drawdown", 6).alias("max_drawdown"))
    v = risk_summary(eq).select("stream", rd("var_primary", 4).alias("var_primary"))
    return p.join(stats, "stream").join(v, "stream")


@query("m12_daily_streams", sql(f"""
  SELECT stream, {r('(l - f) ', 3, 'total_pnl')}, {r('dd', 6, 'max_drawdown')}, {r('sd * sqrt(n / years)', 6, 'volatility')} FROM (
    SELECT stream, arg_min(equity, ts) AS f, arg_max(equity, ts) AS l, min((equity - pk) / nullif(pk, 0)) AS dd, stddev_samp(ret) AS sd, count(*) AS n,
      CAST(date_diff('day', min(day), max(day)) AS DOUBLE) / 365.25 AS years
    FROM (SELECT *, max(equity) OVER (PARTITION BY stream ORDER BY ts) AS pk, equity / nullif(lag(equity) OVER (PARTITION BY stream ORDER BY ts), 0) - 1 AS ret FROM dayeq)
    GROUP BY 1)""", "dayeq"))
def _(spark, d):
    m = M.performance(T.daily_equity(spark, d), period_seconds=YEAR)
    return m.select("stream", rd("total_pnl", 3).alias("total_pnl"), rd("max_drawdown", 6).alias("max_drawdown"), rd("volatility", 6).alias("volatility"))
