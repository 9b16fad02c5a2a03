"""K, J9: walk-forward, grids and batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import CTES, phi, query, r, sql
from barlattice.functions.exprs import rd
from barlattice.operators import metrics as M
from barlattice.operators import walkforward as K
from barlattice.operators.predicates import admit_params
from barlattice.operators.signals import SIGNALS, resolve_column
from barlattice.plans.blocks import running
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle


def fold_sql(anchored, gap):
    begin = "0" if anchored else f"greatest(0, f + k * s - {gap} - f)"
    return f"""SELECT symbol, timeframe, ts, CAST(k + 1 AS INTEGER) AS fold_id, CASE WHEN i >= f + k * s THEN 'test' ELSE 'train' END AS role
      FROM (SELECT *, rn - 1 AS i, n - s * 4 AS f FROM (SELECT *, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS s FROM (
          SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars))) CROSS JOIN (SELECT unnest(range(4)) AS k)
      WHERE (i >= f + k * s AND i < f + (k + 1) * s) OR (i >= {begin} AND i < f + k * s - {gap})"""


@query("k1_rolling_folds", sql(fold_sql(False, 8), "bars"))
def _(spark, d):
    return K.folds(T.bars(spark, d), 4, 0.15, purge=5, embargo=3)


@query("k1_anchored_folds", sql(fold_sql(True, 0), "bars"))
def _(spark, d):
    return K.folds(T.bars(spark, d), 4, 0.15, anchored=True)


@query("k2_parameter_grid", sql("""
  SELECT symbol, timeframe, CAST(fast AS INTEGER) AS fast, slow, side FROM (SELECT DISTINCT symbol, timeframe FROM bars)
  CROSS JOIN (SELECT unnest(range(20, 81, 10)) AS fast) CROSS JOIN (SELECT round(1.25 + unnest(range(0, 8)) * 0.25, 10)::DOUBLE AS slow)
  CROSS JOIN (SELECT unnest(['both', 'long', 'short']) AS side)""", "bars"))
def _(spark, d):
    series = T.bars(spark, d).select("symbol", "timeframe").distinct()
    return K.candidates(series, {"fast": (20, 80, 10), "slow": (1.25, 3.0, 0.25), "side": ["both", "long", "short"]})


@query("k2_sampled_grid", sql("""
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY md5(concat_ws('|', '42', fast_sma_window, slow_sma_window,
      atr_window, atr_sl_mult, rr_ratio, trade_direction)), fast_sma_window, slow_sma_window, atr_window, atr_sl_mult, rr_ratio, trade_direction) AS k
    FROM (SELECT symbol, timeframe, CAST(fast AS INTEGER) AS fast_sma_window, CAST(slow AS INTEGER) AS slow_sma_window, CAST(aw AS INTEGER) AS atr_window,
        am AS atr_sl_mult, rr AS rr_ratio, side AS trade_direction FROM (SELECT DISTINCT symbol, timeframe FROM bars)
      CROSS JOIN (SELECT unnest(range(20, 81, 10)) AS fast) CROSS JOIN (SELECT unnest(range(120, 301, 30)) AS slow)
      CROSS JOIN (SELECT unnest(range(10, 31, 5)) AS aw) CROSS JOIN (SELECT round(1.25 + unnest(range(0, 8)) * 0.25, 10)::DOUBLE AS am)
      CROSS JOIN (SELECT round(1.5 + unnest(range(0, 6)) * 0.5, 10)::DOUBLE AS rr) CROSS JOIN (SELECT unnest(['both', 'long', 'short']) AS side)))
  WHERE k <= 120""", "bars"))
def _(spark, d):
    series = T.bars(spark, d).select("symbol", "timeframe").distinct()
    return K.candidates(series, SIGNALS["sma_pullback"].space, sample=120, seed=42, keys=["symbol", "timeframe"])


CTES["scored"] = (("trials",), """
  SELECT *, CASE WHEN passed THEN CASE WHEN trades < 2 THEN -1 ELSE greatest(0, (0.7::DOUBLE * sharpe + 0.3::DOUBLE * sortino) * least(1, trades / 4.0::DOUBLE)
      * CASE WHEN abs(dd) / 100 > 0.4 THEN 0 ELSE 1 - pow(abs(dd) / 100 / 0.4::DOUBLE, 2) END) END END AS score
  FROM (SELECT *, CASE WHEN abs(max_drawdown) <= 1 THEN max_drawdown * 100 ELSE max_drawdown END AS dd,
      trades >= 2 AND abs(CASE WHEN abs(max_drawdown) <= 1 THEN max_drawdown * 100 ELSE max_drawdown END) <= 24.5 AS passed FROM trials)""")


def scored(spark, d):
    return K.scored_trials(T.fold_trials(spark, d), min_trades=2, max_dd=24.5)


@query("k3_objective_score", sql(f"SELECT fold_id, trial_id, passed, {r('score', 7, 'score')} FROM scored", "scored"))
def _(spark, d):
    return scored(spark, d).select("fold_id", "trial_id", "passed", rd("score", 7).alias("score"))


@query("k4_scaled_trade_floor", sql("""
  SELECT symbol, timeframe, fold_id, greatest(1, CAST(ceil(7.0::DOUBLE * te / tr) AS BIGINT)) AS min_trades FROM (
    SELECT symbol, timeframe, fold_id, count(*) FILTER (role = 'test') AS te, count(*) FILTER (role = 'train') AS tr FROM f GROUP BY 1, 2, 3)""",
    "bars", f=fold_sql(False, 8)))
def _(spark, d):
    f = K.folds(T.bars(spark, d), 4, 0.15, purge=5, embargo=3).groupBy("symbol", "timeframe", "fold_id").agg(
        F.count_if(F.col("role") == "test").alias("te"), F.count_if(F.col("role") == "train").alias("tr"))
    return f.select("symbol", "timeframe", "fold_id", K.scaled_min_trades(F.col("te"), F.col("tr")).alias("min_trades"))


@query("k5_drawdown_percent", sql(f"SELECT fold_id, trial_id, {r('dd', 6, 'max_drawdown')} FROM scored", "scored"))
def _(spark, d):
    return scored(spark, d).select("fold_id", "trial_id", rd("max_drawdown", 6).alias("max_drawdown"))


CTES["best"] = (("scored",), """
  SELECT q.*, n_trials, trial_std FROM (SELECT fold_id, trial_id, score AS is_score, win_rate AS is_win_rate, fast, mult, side,
      row_number() OVER (PARTITION BY fold_id ORDER BY score DESC, trial_id) AS k FROM scored WHERE passed) q
  JOIN (SELECT fold_id, count(*) AS n_trials, stddev_pop(score) FILTER (passed) AS trial_std FROM scored GROUP BY 1) s ON s.fold_id = q.fold_id WHERE k = 1""")
CTES["oosf"] = (("best",), """
  SELECT b.*, CASE WHEN is_score <= 0 THEN -1 WHEN coalesce(t.trades, 0) < 2 THEN -1 ELSE greatest(0, (0.7::DOUBLE * t.sharpe + 0.3::DOUBLE * t.sortino) * least(1, t.trades / 4.0::DOUBLE)
      * CASE WHEN abs(t.dd) / 100 > 0.4 THEN 0 ELSE 1 - pow(abs(t.dd) / 100 / 0.4::DOUBLE, 2) END) END AS oos_score,
    CASE WHEN is_score <= 0 THEN 'in-sample optimisation failed quality gates' WHEN coalesce(t.trades, 0) < 2
      THEN 'insufficient out-of-sample trades: ' || coalesce(t.trades, 0) || ' < 2' END AS rejection,
    coalesce(t.win_rate, 0) AS oos_win_rate, coalesce(t.avg_win, 0) AS aw, coalesce(t.avg_loss, 0) AS al, coalesce(t.sharpe, 0) AS oos_sharpe
  FROM best b LEFT JOIN scored t ON t.trial_id = b.trial_id AND t.fold_id = b.fold_id % 5 + 1""")


@query("k6_best_trials", sql(f"SELECT fold_id, trial_id, {r('is_score', 6, 'is_score')}, n_trials, {r('trial_std', 6, 'trial_std')} FROM best", "best"))
def _(spark, d):
    b = K.best_trials(scored(spark, d))
    return b.select("fold_id", "trial_id", rd("is_score", 6).alias("is_score"), "n_trials", rd("trial_std", 6).alias("trial_std"))


def oos(spark, d):
    """A fold's parameters are measured on the next fold's trials."""
    t = settle(scored(spark, d))
    return K.out_of_sample(K.best_trials(t), t.withColumn("fold_id", ((F.col("fold_id") + 3) % 5 + 1).cast("int")), min_trades=2)


@query("k7_out_of_sample", sql(f"SELECT fold_id, trial_id, {r('oos_score', 6, 'oos_score')}, rejection FROM oosf", "oosf"))
def _(spark, d):
    return oos(spark, d).select("fold_id", "trial_id", rd("oos_score", 6).alias("oos_score"), "rejection")


CTES["meas"] = (("oosf",), f"""
  SELECT *, 'demo' AS strategy, (oos_score - is_score) / is_score AS degradation, (oos_win_rate - is_win_rate) / is_win_rate AS wrd,
    oos_win_rate * aw - (1 - oos_win_rate) * abs(al) AS ev, {phi('z')} AS skill
  FROM (SELECT *, (is_score - trial_std * sqrt(2 * ln(n_trials))) / trial_std AS z FROM oosf)""")


@query("k8_fold_measures", sql(f"""SELECT fold_id, {r('degradation', 5, 'degradation')}, {r('skill', 6, 'skill_probability')}, {r('wrd', 5, 'win_rate_degradation')},
  {r('ev', 2, 'oos_expected_value')} FROM meas""", "meas"))
def _(spark, d):
    m = K.fold_measures(oos(spark, d))
    return m.select("fold_id", rd("degradation", 5).alias("degradation"), rd("skill_probability", 6).alias("skill_probability"),
                    rd("win_rate_degradation", 5).alias("win_rate_degradation"), rd("oos_expected_value", 2).alias("oos_expected_value"))


CTES["wfrep"] = (("meas",), """
  SELECT strategy, n AS n_folds, ms AS median_oos_score, md AS median_degradation, sk AS avg_skill, good AS profitable_folds, longest AS longest_run,
    list_filter([CASE WHEN md < -0.5 THEN 'severe overfitting' END, CASE WHEN sk < 0.5 THEN 'low significance' END,
      CASE WHEN wr < -0.2 THEN 'win rate drift: red' WHEN wr < -0.1 THEN 'win rate drift: yellow' END, CASE WHEN ws > 0.1 THEN 'unstable out-of-sample win rate' END,
      CASE WHEN neg > 0 THEN 'negative expected value in ' || neg || '/' || n || ' folds' END, CASE WHEN low > 0 THEN 'low out-of-sample size in ' || low || '/' || n || ' folds' END],
      lambda x: x IS NOT NULL) AS warnings,
    CASE WHEN good >= 3 AND longest >= 2 AND md > -0.4 AND sk > 0.6 THEN 'PASS' WHEN good >= 2 AND longest >= 1 AND md > -0.6 THEN 'WARNING' ELSE 'FAIL' END AS verdict
  FROM (SELECT strategy, count(*) AS n, quantile_cont(oos_score, 0.5) AS ms, quantile_cont(degradation, 0.5) AS md, avg(skill) AS sk, CAST(sum(g) AS BIGINT) AS good,
      quantile_cont(wrd, 0.5) AS wr, stddev_pop(oos_win_rate) AS ws, count(*) FILTER (ev < 0) AS neg, count(*) FILTER (rejection LIKE 'insufficient%') AS low,
      (SELECT CAST(max(l) AS BIGINT) FROM (SELECT sum(g) AS l FROM (SELECT g, sum(1 - g) OVER (ORDER BY fold_id) AS run FROM (
        SELECT fold_id, CASE WHEN oos_score > 0 AND oos_sharpe >= 0.3 THEN 1 ELSE 0 END AS g FROM meas)) GROUP BY run)) AS longest
    FROM (SELECT *, CASE WHEN oos_score > 0 AND oos_sharpe >= 0.3 THEN 1 ELSE 0 END AS g FROM meas) GROUP BY 1)""")


def reports(spark, d):
    return K.report(K.fold_measures(oos(spark, d)).withColumn("strategy", F.lit("demo")))


@query("k9_walk_forward_report", sql(f"""SELECT strategy, n_folds, {r('median_oos_score', 6, 'median_oos_score')}, {r('median_degradation', 5, 'median_degradation')}, {r('avg_skill', 6, 'avg_skill')},
  profitable_folds, longest_run, warnings, verdict FROM wfrep""", "wfrep"))
def _(spark, d):
    return reports(spark, d).withColumns({"median_oos_score": rd("median_oos_score", 6), "median_degradation": rd("median_degradation", 5), "avg_skill": rd("avg_skill", 6)})


@query("k10_consensus_parameters", sql(f"""
  SELECT 'fast' AS param, round_even(quantile_cont(fast, 0.5), 0) AS value, NULL AS category FROM oosf WHERE oos_score > 0 HAVING count(*) > 0
  UNION ALL SELECT 'mult', {r('quantile_cont(mult, 0.5)', 6)}, NULL FROM oosf WHERE oos_score > 0 HAVING count(*) > 0
  UNION ALL SELECT 'side', NULL, side FROM (SELECT side, count(*) AS n, min(fold_id) AS f FROM oosf WHERE oos_score > 0 GROUP BY 1 ORDER BY n DESC, f LIMIT 1)""", "oosf"))
def _(spark, d):
    params = T.fold_trials(spark, d).select("fold_id", "trial_id", F.create_map(
        F.lit("fast"), F.col("fast").cast("double"), F.lit("mult"), F.col("mult")).alias("params"), F.create_map(F.lit("side"), F.col("side")).alias("params_cat"))
    best = oos(spark, d).join(params, ["fold_id", "trial_id"]).withColumn("strategy", F.lit("demo"))
    return K.consensus(best, integers=["fast"]).select("param", rd("value", 6).alias("value"), "category")


CTES["verdicts"] = (("bars",), """
  SELECT symbol, timeframe, s AS strategy, CAST(count(*) % 97 AS DOUBLE) / 97 + 0.01 * k AS median_oos_score, CASE (count(*) + k) % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARNING' ELSE 'FAIL' END AS verdict
  FROM bars CROSS JOIN (VALUES ('ict_ob', 0), ('sma_pullback', 1)) AS q(s, k) WHERE NOT (symbol = 'view' AND k = 1) GROUP BY 1, 2, 3, k""")


def verdicts(spark, d):
    """One verdict per series and strategy, from the number of bars."""
    n = T.bars(spark, d).groupBy("symbol", "timeframe").agg(F.count("*").alias("n"))
    b = K.batch(n, ["ict_ob", "sma_pullback"]).withColumn("k", F.when(F.col("strategy") == "ict_ob", 0).otherwise(1))
    v = F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), ((F.col("n") + F.col("k")) % 3 + 1).cast("int"))
    return b.where(~((F.col("symbol") == "view") & (F.col("k") == 1))).select(
        "symbol", "timeframe", "strategy", ((F.col("n") % 97).cast("double") / 97 + 0.01 * F.col("k")).alias("median_oos_score"), v.alias("verdict"))


@query("k11_verdict_table", sql(f"SELECT symbol, timeframe, strategy, {r('median_oos_score', 6, 'median_oos_score')}, verdict FROM verdicts WHERE verdict = 'WARNING'", "verdicts"))
def _(spark, d):
    return K.verdict_table(verdicts(spark, d), "WARNING").withColumn("median_oos_score", rd("median_oos_score", 6))


TARGETS = [f"{s} 1h" for s in ("click", "error", "purchase", "signup", "view")]


@query("k11_verdict_matrix", sql("SELECT strategy, " + ", ".join(
    f"coalesce(max(verdict) FILTER (symbol || ' ' || timeframe = '{t}'), 'FAIL') AS \"{t}\"" for t in TARGETS) + " FROM verdicts GROUP BY 1", "verdicts"))
def _(spark, d):
    return K.verdict_matrix(verdicts(spark, d), TARGETS)


CTES["batchsum"] = (("bars",), """
  SELECT symbol, greatest(tr * 100, -100) AS pnl_pct, least(abs(dd) * 100, 100) AS max_drawdown_pct FROM (
    SELECT symbol, arg_max(v, ts) / arg_min(v, ts) - 1 AS tr, min((v - pk) / pk) AS dd FROM (
      SELECT *, max(v) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM (
        SELECT symbol, ts, 1000 + sum(close - open) OVER (PARTITION BY symbol ORDER BY ts) * 0.05::DOUBLE AS v FROM bars)) GROUP BY 1)
  WHERE greatest(tr * 100, -100) >= -80 AND least(abs(dd) * 100, 100) <= 80""")


def batch_perf(spark, d):
    """Equity of 0.05 units held over every bar, from 1,000."""
    b = T.bars(spark, d).withColumn("step", (F.col("close") - F.col("open")) * 0.05)
    eq = running(b, ["symbol"], "ts", sums={"cum": "step"}).select("symbol", "ts", (F.lit(1000.0) + F.col("cum")).alias("equity"))
    return M.performance(settle(eq), ["symbol"])


@query("k12_batch_summary", sql(f"SELECT symbol, {r('pnl_pct', 4, 'pnl_pct')}, {r('max_drawdown_pct', 4, 'max_drawdown_pct')} FROM batchsum ORDER BY pnl_pct DESC LIMIT 2", "batchsum"))
def _(spark, d):
    top, _more = K.top_batch(K.batch_summary(batch_perf(spark, d)), "symbol", 2)
    return top.select("symbol", rd("pnl_pct", 4).alias("pnl_pct"), rd("max_drawdown_pct", 4).alias("max_drawdown_pct"))


@query("k12_batch_omitted", sql("SELECT greatest(count(*) - 2, 0) AS omitted FROM batchsum", "batchsum"))
def _(spark, d):
    return K.top_batch(K.batch_summary(batch_perf(spark, d)), "symbol", 2)[1]


@query("k14_scenario_table", sql(f"""
  SELECT trial_id, fold_id, greatest(0, CAST(round_even(3.0::DOUBLE * mult, 0) AS INTEGER)) AS spread_ticks, {r('2.5 * mult', 6, 'commission_rate')}, {r('0.12 * mult', 6, 'target_vol')},
    {r('greatest(0, round_even(3.0::DOUBLE * mult, 0)) / 3', 6, 'slippage_multiplier')}, {r('2.5 * mult / 2.5', 6, 'commission_multiplier')} FROM trials""", "trials"))
def _(spark, d):
    m = T.fold_trials(spark, d).select("trial_id", "fold_id", F.col("mult").alias("volatility"), F.col("mult").alias("slippage"), F.col("mult").alias("commission"))
    t = K.scenario_table(m, 3, 2.5, 0.12)
    return t.select("trial_id", "fold_id", "spread_ticks", *[rd(c, 6).alias(c) for c in ("commission_rate", "target_vol", "slippage_multiplier", "commission_multiplier")])


@query("j9_batch_scenarios", sql("""SELECT symbol, timeframe, strategy FROM (SELECT DISTINCT symbol, '1h' AS timeframe FROM bars UNION SELECT DISTINCT symbol, '5m' FROM bars)
  CROSS JOIN (VALUES ('channel_breakout'), ('ict_ob'), ('sma_pullback')) AS s(strategy)""", "bars"))
def _(spark, d):
    series = T.bars(spark, d).select("symbol").distinct().withColumn("timeframe", F.explode(F.array(F.lit("1h"), F.lit("5m"))))
    return K.batch(series, ["sma_pullback", "channel_breakout", "ict_ob"])


@query("p8_resolve_strategy", sql("""SELECT trial_id, fold_id, CASE trial_id % 4 WHEN 0 THEN 'ict_ob' WHEN 1 THEN 'sma_pullback' WHEN 2 THEN 'channel_breakout' END AS strategy FROM trials""", "trials"))
def _(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("ict_order_block", " sma_pullback", "channel_breakout_long ", "nothing")]), (F.col("trial_id") % 4 + 1).cast("int"))
    return T.fold_trials(spark, d).select("trial_id", "fold_id", resolve_column(raw).alias("strategy"))


@query("p11_parameter_admission", sql("""SELECT trial_id, fold_id, CASE WHEN trial_id % 3 = 0 THEN 'money management parameter: stop_Risk_pct' WHEN trial_id % 3 = 1 THEN '7 parameters, at most 6' END AS rejection
  FROM trials""", "trials"))
def _(spark, d):
    seven = F.create_map(*[x for i in range(7) for x in (F.lit(f"p{i}"), F.col("mult"))])
    p = F.when(F.col("trial_id") % 3 == 0, F.create_map(F.lit("stop_Risk_pct"), F.col("mult"))).when(
        F.col("trial_id") % 3 == 1, seven).otherwise(F.create_map(F.lit("fast"), F.col("mult")))
    return admit_params(T.fold_trials(spark, d).withColumn("params", p)).select("trial_id", "fold_id", "rejection")
