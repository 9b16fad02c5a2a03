"""C, A: correlation, attribution, strategy statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

import barlattice.catalog.exits  # noqa: F401  (defines the enriched trades in SQL)
from barlattice.catalog.core import CTES, query, r, sql, t_tails
from barlattice.functions.exprs import rd
from barlattice.operators import attribution as A
from barlattice.operators import exits as E
from barlattice.operators import execution as X
from barlattice.operators import pnl as L
from barlattice.operators.bars import daily_close
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle

SYMBOLS = ["click", "error", "purchase", "signup", "view"]
FLAGS = {0: "A", 1: "N", 2: "R"}
NAME = "CASE slot_id WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END"
MATRIX = f"""SELECT a.{{k}} AS row_label, b.{{k}} AS col_label, count(*) AS n, CASE WHEN a.{{k}} = b.{{k}} THEN 1.0::DOUBLE ELSE {r('corr(a.v, b.v)', 6)} END AS corr
  FROM m a JOIN m b ON a.period = b.period GROUP BY a.{{k}}, b.{{k}}"""

for _h, _label in (("1d", "CAST(ts AS DATE)"), ("1w", "CAST(date_trunc('week', ts) AS DATE) + 6")):
    @query(f"c1_strategy_correlation_{_h}", sql(MATRIX.format(k="strategy"), "barpnl",
           m=f"SELECT {NAME} AS strategy, {_label} AS period, sum(pnl) AS v FROM barpnl GROUP BY 1, 2"))
    def _(spark, d, h=_h):
        return A.strategy_correlation(L.bar_pnl(T.slot_history(spark, d)), T.SLOTS, h).select("row_label", "col_label", "n", rd("corr", 6).alias("corr"))


CTES["expday"] = (("expo",), """SELECT symbol, CAST(ts AS DATE) AS period, avg(abs(n)) AS v FROM (
    SELECT symbol, ts, sum(notional) AS n FROM expo GROUP BY 1, 2) GROUP BY 1, 2""")


@query("c2_exposure_correlation", sql(MATRIX.format(k="symbol"), "expday", m="SELECT * FROM expday"))
def _(spark, d):
    m, _dropped = A.exposure_correlation(T.exposure(spark, d), SYMBOLS)
    return m.select("row_label", "col_label", "n", rd("corr", 6).alias("corr"))


@query("c2_exposure_activity", sql(f"""SELECT symbol, count(v) AS n, {r('stddev_samp(v)', 4, 'std')}, count(v) >= 25 AND stddev_samp(v) > 1e-8 AS is_active
  FROM expday GROUP BY 1""", "expday"))
def _(spark, d):
    return A.exposure_activity(A.exposure_by_period(T.exposure(spark, d)), 25).select("symbol", "n", rd("std", 4).alias("std"), "is_active")


@query("c3_heatmap_cells", sql(f"""SELECT row_label, col_label, corr, CAST(dense_rank() OVER (ORDER BY row_label) - 1 AS BIGINT) AS row_idx,
    CAST(dense_rank() OVER (ORDER BY col_label) - 1 AS BIGINT) AS col_idx FROM ({MATRIX.format(k='symbol')})""", "expday", m="SELECT * FROM expday"))
def _(spark, d):
    m, _dropped = A.exposure_correlation(T.exposure(spark, d), SYMBOLS)
    return A.heatmap(m, SYMBOLS).select("row_label", "col_label", rd("corr", 6).alias("corr"), "row_idx", "col_idx")


CTES["decomp"] = (("barpnl", "trades", "expo"), """
  SELECT s.slot_id, s.strategy, k.sharpe_like, coalesce(c.closed, 0) AS closed_pnl, coalesce(c.closed, 0) / nullif(sum(abs(c.closed)) OVER (), 0) * 100 AS pnl_contrib_pct,
    b.cv / b.vr * 100 AS risk_contrib_pct, b.dd_pnl, t.tail_pnl, coalesce(c.closed, 0) + coalesce(c.cost, 0) AS signal_pnl, -coalesce(c.cost, 0) AS exec_cost, d.duty_cycle
  FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R')) AS s(slot_id, strategy)
  JOIN (SELECT p.slot_id, covar_samp(pnl, total) AS cv, var_samp(total) AS vr, sum(pnl) FILTER (p.ts BETWEEN w.a AND w.z) AS dd_pnl
    FROM barpnl p JOIN (SELECT ts, sum(pnl) AS total FROM barpnl GROUP BY 1) q ON q.ts = p.ts
    JOIN (SELECT a, arg_min(ts, cum) AS z FROM (SELECT ts, cum, a FROM (SELECT ts, sum(sum(pnl)) OVER (ORDER BY ts) AS cum FROM barpnl GROUP BY ts),
        (SELECT arg_max(ts, cum) AS a FROM (SELECT ts, sum(sum(pnl)) OVER (ORDER BY ts) AS cum FROM barpnl GROUP BY ts)) WHERE ts >= a) GROUP BY a) w ON true GROUP BY 1) b ON b.slot_id = s.slot_id
  JOIN (SELECT slot_id, avg(v) / stddev_samp(v) * sqrt(252) AS sharpe_like FROM (SELECT slot_id, CAST(ts AS DATE) AS day, sum(pnl) AS v FROM barpnl GROUP BY 1, 2) GROUP BY 1) k ON k.slot_id = s.slot_id
  LEFT JOIN (SELECT slot_id, avg(v) AS tail_pnl FROM (SELECT slot_id, CAST(ts AS DATE) AS day, sum(pnl) AS v FROM barpnl GROUP BY 1, 2)
    WHERE day IN (SELECT day FROM (SELECT *, quantile_cont(t, 0.05) OVER () AS q FROM (SELECT CAST(ts AS DATE) AS day, sum(pnl) AS t FROM barpnl GROUP BY 1)) WHERE t <= q) GROUP BY 1) t ON t.slot_id = s.slot_id
  LEFT JOIN (SELECT strategy, sum(pnl) AS closed, abs(sum(commission) + sum(slippage)) AS cost FROM trades GROUP BY 1) c ON c.strategy = s.strategy
  LEFT JOIN (SELECT slot_id, sum(x * x) / (max(x) * max(x)) / (SELECT count(DISTINCT ts) FROM expo) AS duty_cycle FROM (
      SELECT slot_id, ts, sum(abs(notional)) AS x FROM expo GROUP BY 1, 2) GROUP BY 1) d ON d.slot_id = s.slot_id""")
DECOMP = {"sharpe_like": 5, "closed_pnl": 2, "pnl_contrib_pct": 5, "risk_contrib_pct": 5, "dd_pnl": 4, "tail_pnl": 4, "signal_pnl": 2, "exec_cost": 2, "duty_cycle": 6}


def decomp(spark, d):
    return A.decomposition(T.trades(spark, d), L.bar_pnl(settle(T.slot_history(spark, d))), FLAGS, exposure=settle(T.exposure(spark, d)))


@query("a1_decomposition", sql(f"SELECT slot_id, strategy, {', '.join(r(c, n, c) for c, n in DECOMP.items())} FROM decomp", "decomp"))
def _(spark, d):
    return decomp(spark, d).select("slot_id", "strategy", *[rd(c, n).alias(c) for c, n in DECOMP.items()])


@query("a2_decomposition_table", sql(f"""SELECT slot_id, strategy, {', '.join(f'(round_even({c}, {n}) + 0.0) AS {c}' for c, n in A.DISPLAY_DIGITS.items())}, {r('exec_cost', 2, 'exec_cost')},
    row_number() OVER (ORDER BY round_even(risk_contrib_pct, 1) DESC NULLS LAST, slot_id) AS position FROM decomp""", "decomp"))
def _(spark, d):
    t = A.decomposition_table(decomp(spark, d), "risk_contrib_pct")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("risk_contrib_pct").desc_nulls_last(), "slot_id"))
    return t.select("slot_id", "strategy", *A.DISPLAY_DIGITS, rd("exec_cost", 2).alias("exec_cost"), rank.cast("long").alias("position"))


@query("a3_strategy_stats", sql(f"""
  SELECT s.strategy, coalesce(n, 0) AS total_trades, {r('coalesce(w, 0) * 100', 4, 'win_rate_pct')}, {r('coalesce(m, 0)', 4, 'avg_trade')}, {r('coalesce(lo, 0)', 4, 'max_loss')},
    {r('coalesce(t, 0)', 5, 't_stat')}, {r('CASE WHEN n > 1 THEN ' + t_tails('t', 'n - 1') + ' ELSE 1 END', 6, 'p_value')}
  FROM (VALUES ('A'), ('N'), ('R'), ('unused')) AS s(strategy) LEFT JOIN (
    SELECT strategy, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS w, avg(pnl) AS m, min(pnl) AS lo, avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))) AS t
    FROM trades GROUP BY 1) q ON q.strategy = s.strategy""", "trades"))
def _(spark, d):
    s = A.strategy_stats(T.trades(spark, d), {**FLAGS, 3: "unused"})
    return s.select("strategy", "total_trades", *[rd(c, n).alias(c) for c, n in
                    {"win_rate_pct": 4, "avg_trade": 4, "max_loss": 4, "t_stat": 5, "p_value": 6}.items()])


@query("a4_main_symbols", sql("""SELECT strategy, symbol, trades FROM (SELECT strategy, symbol, count(*) AS trades,
    row_number() OVER (PARTITION BY strategy ORDER BY count(*) DESC, symbol) AS k FROM trades GROUP BY 1, 2) WHERE k = 1""", "trades"))
def _(spark, d):
    return A.main_symbols(T.trades(spark, d))


def returns_by_symbol(spark, d):
    """Daily slot returns next to the main symbol of the slot's intraday trades."""
    w = spark.createDataFrame(list(T.WEIGHTS.items()), "slot_id INT, weight DOUBLE")
    sh = settle(T.slot_history(spark, d))
    eq = L.slot_equity(sh, T.run_totals(sh), w)
    daily = L.with_daily_change(L.daily_equity(eq, ["slot_id"]), ["slot_id"])
    named = daily.withColumn("strategy", F.element_at(F.create_map(*[F.lit(x) for kv in T.SLOTS.items() for x in kv]), F.col("slot_id")))
    return named.join(A.main_symbols(T.intraday_trades(spark, d)).select("strategy", "symbol"), "strategy").select("strategy", "symbol", "day", F.col("ret").alias("y"))


CTES["ab"] = (("slot_hist", "hist", "bars", "itrades"), f"""
  SELECT strategy, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx,
    (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS rv
  FROM (SELECT q.strategy, y, x FROM (
      SELECT {NAME} AS strategy, day, e / lag(e) OVER (PARTITION BY slot_id ORDER BY day) - 1 AS y FROM (
        SELECT s.slot_id, CAST(s.ts AS DATE) AS day, arg_max(s.cum_pnl + h.v * w, s.ts) AS e FROM slot_hist s JOIN (VALUES (0, 0.5::DOUBLE), (1, 0.3), (2, 0.2)) AS w(slot_id, w) ON w.slot_id = s.slot_id
        JOIN (SELECT arg_min(total_value, ts) AS v FROM hist) h ON true GROUP BY 1, 2)) q
    JOIN (SELECT strategy, symbol FROM (SELECT strategy, symbol, row_number() OVER (PARTITION BY strategy ORDER BY count(*) DESC, symbol) AS k FROM itrades GROUP BY 1, 2) WHERE k = 1) m ON m.strategy = q.strategy
    JOIN (SELECT symbol, day, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1, 0) AS x FROM (
      SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)) i ON i.symbol = m.symbol AND i.day = q.day WHERE y IS NOT NULL) GROUP BY 1""")


@query("a5_alpha_beta", sql(f"""SELECT strategy, n, {r('b', 8, 'beta')}, {r('a * 25200', 6, 'alpha')}, {r('tb', 5, 'beta_t')}, {r('ta', 5, 'alpha_t')},
    {r(t_tails('tb', 'n - 2'), 6, 'beta_p')}, {r(t_tails('ta', 'n - 2'), 6, 'alpha_p')}
  FROM (SELECT *, b / sqrt(rv / sxx) AS tb, a / sqrt(rv * (1.0 / n + mx * mx / sxx)) AS ta FROM ab)""", "ab"))
def _(spark, d):
    closes = daily_close(T.bars(spark, d), ["symbol"])
    ab = A.alpha_beta(returns_by_symbol(spark, d), A.instrument_returns(closes), ["strategy"])
    return ab.select("strategy", "n", *[rd(c, n).alias(c) for c, n in
                     {"beta": 8, "alpha": 6, "beta_t": 5, "alpha_t": 5, "beta_p": 6, "alpha_p": 6}.items()])


@query("a6_exit_summary", sql(f"""SELECT strategy, count(*) AS total_trades, {r('avg(CASE WHEN pnl > 0 THEN 100.0::DOUBLE ELSE 0 END)', 4, 'win_rate_pct')}, {r('avg(pnl)', 4, 'avg_trade')},
    {r('avg(pnl_decay_60m)', 4, 'pnl_decay_60m')}, {r('avg(mfe)', 4, 'avg_mfe')}, {r('avg(mae)', 4, 'avg_mae')}, CAST(floor(avg(hold_minutes)) AS BIGINT) AS avg_hold_min
  FROM enriched GROUP BY 1""", "enriched"))
def _(spark, d):
    t = E.enrich(settle(X.with_specs(T.intraday_trades(spark, d), T.specs(spark))), settle(T.bars(spark, d)), 20, 100)
    s = A.exit_summary(t)
    return s.select("strategy", "total_trades", *[rd(c, 4).alias(c) for c in ("win_rate_pct", "avg_trade", "pnl_decay_60m", "avg_mfe", "avg_mae")], "avg_hold_min")
