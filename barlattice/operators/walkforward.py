"""Walk-forward folds, parameter grids, scores, fold reports and batch tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.exprs import half_even, over_zero
from barlattice.functions.probability import norm_cdf
from barlattice.plans.blocks import Series
from barlattice.plans.salt import join_small

KEYS = ["symbol", "timeframe"]

# Score weights and gates.
SHARPE_WEIGHT, SORTINO_WEIGHT = 0.7, 0.3
MIN_TRADES, MAX_DD_PCT, TARGET_TIMES = 7, 35.0, 2
MIN_FOLD_SHARPE = 0.3
SCORE_DD_LIMIT = 0.40


def folds(
    bars: DataFrame, n_folds: int = 5, test_size: float = 0.1, purge: int = 0, embargo: int = 0,
    anchored: bool = False, keys: Sequence[str] = KEYS, block_rows: int | None = None,
) -> DataFrame:
    """(keys, ts, fold_id, role): train and test rows of every fold; folds are numbered from 1.

    Test folds are consecutive and end with the series; training stops purge + embargo rows before
    the test. Series that are too short fail the job. A row finds its folds from its own number,
    so folds are not joined to rows.
    """
    keys = list(keys)
    gap = purge + embargo
    n = bars.groupBy(*keys).agg(F.count("*").alias("_n"))
    size = F.floor(F.col("_n") * F.lit(float(test_size))).cast("long")
    first = F.col("_n") - size * n_folds
    bad = F.when(size <= 0, F.raise_error(F.lit("fold size is zero"))).when(
        first <= gap, F.raise_error(F.lit("too few rows for the folds")))
    n = n.withColumn("_size", F.coalesce(bad.cast("long"), size)).withColumn(
        "_first", F.col("_n") - F.col("_size") * n_folds)
    rows = join_small(Series(bars, keys, block_rows=block_rows).frame(), n, keys)
    i = F.col("_rn") - 1

    def role(k: Column) -> Column:
        start = F.col("_first") + k * F.col("_size")
        end = start - gap
        begin = F.lit(0) if anchored else F.greatest(F.lit(0), end - F.col("_first"))
        return F.when((i >= start) & (i < start + F.col("_size")), "test").when(
            (i >= begin) & (i < end), "train")

    parts = F.transform(
        F.sequence(F.lit(0), F.lit(n_folds - 1)),
        lambda k: F.struct((k + 1).alias("fold_id"), role(k).alias("role")))
    parts = F.filter(parts, lambda x: x["role"].isNotNull())
    return rows.select(*keys, "ts", F.explode(parts).alias("_f")).select(*keys, "ts", "_f.fold_id", "_f.role")


def values_of(bounds: Any) -> list[Any]:
    """Candidate values of (start, stop, step), (start, stop) of integers, or a list."""
    if isinstance(bounds, list):
        return bounds
    if isinstance(bounds, tuple) and len(bounds) in (2, 3):
        start, stop = bounds[0], bounds[1]
        if len(bounds) == 2 and not (isinstance(start, int) and isinstance(stop, int)):
            raise ValueError(f"a real range needs a step: {bounds}")
        step = bounds[2] if len(bounds) == 3 else 1
        count = int((stop - start) / step + 1e-9) + 1
        return [start + k * step if isinstance(start, int) and isinstance(step, int)
                else round(start + k * step, 10) for k in range(count)]
    raise ValueError(f"invalid bounds: {bounds}")


def candidates(
    base: DataFrame, space: Mapping[str, Any], sample: int | None = None, seed: int = 42,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``base`` with every parameter combination of ``space`` (one column per parameter).

    With ``sample`` the combinations of each key are thinned to that many, chosen by a seeded MD5
    of the parameters (top-k by hash, so map tasks keep at most ``sample`` rows per key).
    """
    out = base
    for name, bounds in space.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values_of(bounds)])))
    if sample is None:
        return out
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in space]).cast("binary"))
    if not keys:
        return out.orderBy(h, *space).limit(sample)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(h, *space))
    return out.withColumn("_k", rank).where(F.col("_k") <= sample).drop("_k")


def batch(series: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Strategies times the given (symbol, timeframe) rows."""
    return series.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))


def drawdown_pct(dd: Column) -> Column:
    """Drawdown in percent, whether given as a fraction or already as percent."""
    return F.when(F.abs(dd) <= 1.0, dd * 100.0).otherwise(dd)


def score(
    sharpe: Column, sortino: Column, trades: Column, max_dd_pct: Column, min_trades: Column | int = 10,
    target_trades: Column | int = 50, dd_limit: float = SCORE_DD_LIMIT,
) -> Column:
    """Weighted ratios times an activity ramp and a quadratic drawdown penalty.

    -1 below the trade floor, never negative otherwise.
    """
    floor = min_trades if isinstance(min_trades, Column) else F.lit(min_trades)
    goal = target_trades if isinstance(target_trades, Column) else F.lit(target_trades)
    active = F.least(F.lit(1.0), trades / F.greatest(F.lit(1), goal))
    share = F.abs(max_dd_pct) / 100.0
    calm = F.when(share > dd_limit, 0.0).otherwise(1.0 - F.pow(share / dd_limit, F.lit(2.0)))
    base = sharpe * SHARPE_WEIGHT + sortino * SORTINO_WEIGHT
    return F.when(trades < floor, -1.0).otherwise(F.greatest(F.lit(0.0), base * active * calm))


def scaled_min_trades(target: Column, reference: Column, base: int = MIN_TRADES) -> Column:
    """Trade floor in proportion to the sample length, at least 1."""
    ok = (target > 0) & (reference > 0)
    scaled = F.ceil(F.lit(float(base)) * target / F.when(ok, reference))
    return F.when(ok, F.greatest(F.lit(1), scaled)).otherwise(F.lit(max(1, base))).cast("long")


def scored_trials(
    trials: DataFrame, min_trades: int = MIN_TRADES, max_dd: float = MAX_DD_PCT, times: int = TARGET_TIMES
) -> DataFrame:
    """Trials with drawdown in percent, gate flag and score (null when a gate fails)."""
    t = trials.withColumn("max_drawdown", drawdown_pct(F.col("max_drawdown")))
    ok = (F.col("trades") >= min_trades) & (F.abs("max_drawdown") <= max_dd)
    s = score(F.col("sharpe"), F.col("sortino"), F.col("trades"), F.col("max_drawdown"), min_trades,
              min_trades * times)
    return t.withColumn("passed", ok).withColumn("score", F.when(ok, s))


STATS = ("sharpe", "sortino", "trades", "max_drawdown", "win_rate", "avg_win", "avg_loss")


def best_trials(scored: DataFrame, keys: Sequence[str] = ("fold_id",)) -> DataFrame:
    """Best passing trial per fold (the lower id on ties), number of trials, spread of scores."""
    ok = F.col("passed")
    pick = F.max(F.when(ok, F.struct(
        "score", (-F.col("trial_id")).alias("k"), F.struct(*STATS).alias("stats"))))
    n_ok = F.count(F.when(ok, 1))
    return scored.groupBy(*keys).agg(
        pick.alias("_b"), F.count("*").alias("n_trials"),
        F.when(n_ok > 1, F.stddev_pop(F.when(ok, F.col("score")))).otherwise(0.0).alias("trial_std"),
    ).select(
        *keys, F.coalesce("_b.score", F.lit(-1.0)).alias("is_score"), (-F.col("_b.k")).alias("trial_id"),
        "n_trials", "trial_std", F.col("_b.stats").alias("is_stats"))


def out_of_sample(
    best: DataFrame, oos: DataFrame, min_trades: Column | int = MIN_TRADES, times: int = TARGET_TIMES
) -> DataFrame:
    """Score of each fold's best parameters on its test rows, and why it is rejected.

    ``oos`` holds (fold_id, trial_id, statistics) measured on test rows. Folds that failed in
    sample score -1 without looking at them; a missing measurement counts as no trades.
    """
    j = best.join(oos.select("fold_id", "trial_id", F.struct(*STATS).alias("oos_stats")),
                  ["fold_id", "trial_id"], "left")
    floor = min_trades if isinstance(min_trades, Column) else F.lit(min_trades)
    st = {c: F.coalesce(F.col(f"oos_stats.{c}"), F.lit(0)) for c in STATS}
    got = score(st["sharpe"], st["sortino"], st["trades"], drawdown_pct(st["max_drawdown"]), floor, floor * times)
    failed = F.col("is_score") <= 0
    return j.withColumns({
        "oos_score": F.when(failed, -1.0).otherwise(got),
        "rejection": F.when(failed, "in-sample optimisation failed quality gates").when(
            st["trades"] < floor,
            F.format_string("insufficient out-of-sample trades: %d < %d", st["trades"].cast("long"), floor.cast("long"))),
    })


def skill_z(sharpe: Column, trials: Column, std: Column) -> Column:
    """How far a score lies above the best of ``trials`` chance results, in spreads; null if unknown."""
    ok = (trials >= 2) & (std > 1e-6)
    s = F.when(ok, std)
    return (sharpe - s * F.sqrt(2.0 * F.log(trials.cast("double")))) / s


def fold_measures(f: DataFrame) -> DataFrame:
    """Degradation, skill probability, win-rate drift and expected value per fold."""
    failed = F.col("is_score") <= 0
    wr_in = F.coalesce(F.col("is_stats.win_rate"), F.lit(0.0))
    wr_out = F.coalesce(F.col("oos_stats.win_rate"), F.lit(0.0))
    ev = wr_out * F.coalesce("oos_stats.avg_win", F.lit(0.0)) - (1.0 - wr_out) * F.abs(
        F.coalesce("oos_stats.avg_loss", F.lit(0.0)))
    f = f.withColumns({
        "is_failed": failed, "is_win_rate": wr_in, "oos_win_rate": wr_out,
        "oos_sharpe": F.coalesce(F.col("oos_stats.sharpe"), F.lit(0.0)),
        "degradation": F.when(failed, -1.0).otherwise(
            over_zero(F.col("oos_score") - F.col("is_score"), F.col("is_score"))),
        "skill_z": skill_z(F.col("is_score"), F.col("n_trials"), F.col("trial_std")),
        "win_rate_degradation": F.when(failed | (wr_in <= 0), 0.0).otherwise(over_zero(wr_out - wr_in, wr_in)),
        "oos_expected_value": F.when(failed, 0.0).otherwise(ev),
    })
    return f.withColumn("skill_probability", F.coalesce(norm_cdf("skill_z"), F.lit(0.5)))


def report(
    m: DataFrame, keys: Sequence[str] = ("strategy",), min_sharpe: float = MIN_FOLD_SHARPE, pass_folds: int = 3,
    warn_folds: int = 2, pass_run: int = 2, warn_run: int = 1,
) -> DataFrame:
    """Medians, warnings, longest run of profitable folds and verdict, one row per search."""
    keys = list(keys)
    good = (F.col("oos_score") > 0) & (F.col("oos_sharpe") >= min_sharpe)
    # Runs of good folds: folds of a run share the number of bad folds before them.
    w = Window.partitionBy(*keys).orderBy("fold_id")
    m = m.withColumn("_good", F.when(good, 1).otherwise(0)).withColumn("_run", F.sum(1 - F.col("_good")).over(w))
    runs = m.groupBy(*keys, "_run").agg(F.sum("_good").alias("_len")).groupBy(*keys).agg(
        F.max("_len").alias("longest_run"))
    live = F.when(~F.col("is_failed") & (F.col("is_win_rate") > 0), F.col("win_rate_degradation"))
    s = m.groupBy(*keys).agg(
        F.count("*").alias("n_folds"),
        F.percentile("oos_score", F.lit(0.5)).alias("median_oos_score"),
        F.percentile("degradation", F.lit(0.5)).alias("median_degradation"),
        F.avg("skill_probability").alias("avg_skill"),
        F.sum("_good").alias("profitable_folds"),
        F.percentile(live, F.lit(0.5)).alias("_wr"),
        F.stddev_pop(F.when(~F.col("is_failed"), F.col("oos_win_rate"))).alias("_wr_std"),
        F.count(F.when(~F.col("is_failed") & (F.col("oos_expected_value") < 0), 1)).alias("_neg"),
        F.count(F.when(F.col("rejection").contains("insufficient out-of-sample"), 1)).alias("_low"),
    ).join(runs, keys)
    known = F.col("_wr").isNotNull()
    warnings = F.array_compact(F.array(
        F.when(F.col("median_degradation") < -0.50, "severe overfitting"),
        F.when(F.col("avg_skill") < 0.5, "low significance"),
        F.when(known & (F.col("_wr") < -0.20), "win rate drift: red").when(
            known & (F.col("_wr") < -0.10), "win rate drift: yellow"),
        F.when(known & (F.col("_wr_std") > 0.10), "unstable out-of-sample win rate"),
        F.when(F.col("_neg") > 0, F.format_string("negative expected value in %d/%d folds", "_neg", "n_folds")),
        F.when(F.col("_low") > 0, F.format_string("low out-of-sample size in %d/%d folds", "_low", "n_folds")),
    ))
    verdict = F.when(
        (F.col("profitable_folds") >= pass_folds) & (F.col("longest_run") >= pass_run)
        & (F.col("median_degradation") > -0.40) & (F.col("avg_skill") > 0.6), "PASS",
    ).when(
        (F.col("profitable_folds") >= warn_folds) & (F.col("longest_run") >= warn_run)
        & (F.col("median_degradation") > -0.60), "WARNING",
    ).otherwise("FAIL")
    return s.select(
        *keys, "n_folds", "median_oos_score", "median_degradation", "avg_skill", "profitable_folds",
        "longest_run", warnings.alias("warnings"), verdict.alias("verdict"))


def consensus(
    best: DataFrame, keys: Sequence[str] = ("strategy",), integers: Sequence[str] = ()
) -> DataFrame:
    """Parameters agreed on by profitable folds: (keys, param, value, category).

    ``best`` has fold_id, oos_score, ``params`` (string to double) and ``params_cat`` (string to
    string). Numbers take the median (whole, halves to even, for ``integers``), categories the
    most frequent value, the one of the earliest fold on ties.
    """
    keys = list(keys)
    good = best.where(F.col("oos_score") > 0)
    num = good.select(*keys, F.explode("params").alias("param", "v")).groupBy(*keys, "param").agg(
        F.percentile("v", F.lit(0.5)).alias("v"))
    num = num.withColumn("v", F.when(F.col("param").isin(list(integers)), half_even(F.col("v"))).otherwise(F.col("v")))
    cat = good.select(*keys, "fold_id", F.explode("params_cat").alias("param", "c")).groupBy(
        *keys, "param", "c").agg(F.count("*").alias("n"), F.min("fold_id").alias("f"))
    cat = cat.groupBy(*keys, "param").agg(
        F.min_by("c", F.struct((-F.col("n")).alias("n"), "f")).alias("c"))
    none = F.lit(None)
    return num.select(*keys, "param", F.col("v").alias("value"), none.cast("string").alias("category")).unionByName(
        cat.select(*keys, "param", none.cast("double").alias("value"), F.col("c").alias("category")))


def verdict_table(reports: DataFrame, verdict: str) -> DataFrame:
    return reports.where(F.col("verdict") == verdict).orderBy(F.desc("median_oos_score"), *KEYS, "strategy")


def verdict_matrix(reports: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row per strategy, one column per 'SYMBOL timeframe', FAIL where there is no result."""
    return (
        reports.withColumn("_t", F.concat_ws(" ", *KEYS)).groupBy("strategy")
        .pivot("_t", list(targets)).agg(F.first("verdict")).na.fill("FAIL"))


def batch_summary(
    perf: DataFrame, floor_pct: float = -100.0, min_pnl: float = -80.0, max_dd: float = 80.0
) -> DataFrame:
    """Percent return (floored), drawdown depth (limited by the floor), Sharpe; outliers left out."""
    depth = F.least(F.abs("max_drawdown") * 100.0, F.lit(abs(floor_pct)))
    return perf.withColumns({
        "pnl_pct": F.greatest(F.col("total_return") * 100.0, F.lit(floor_pct)),
        "max_drawdown_pct": F.coalesce(depth, F.lit(0.0)),
    }).where((F.col("pnl_pct") >= min_pnl) & (F.col("max_drawdown_pct") <= max_dd))


def top_batch(summary: DataFrame, key: str, rows: int = 20) -> tuple[DataFrame, DataFrame]:
    """The best rows by return, and how many more there are."""
    top = summary.orderBy(F.desc("pnl_pct"), key).limit(rows)
    return top, summary.agg(F.greatest(F.count("*") - rows, F.lit(0)).alias("omitted"))


def scenario_table(
    multipliers: DataFrame, spread_ticks: int, commission: float, target_vol: float
) -> DataFrame:
    """Rerun settings per row of (volatility, slippage, commission) multipliers."""
    base_ticks, base_comm = max(1, int(spread_ticks)), float(commission) or 1.0
    m = multipliers.withColumns({
        "spread_ticks": F.greatest(F.lit(0), half_even(F.lit(float(spread_ticks)) * F.col("slippage")).cast("int")),
        "commission_rate": F.lit(float(commission)) * F.col("commission"),
        "target_vol": F.lit(float(target_vol)) * F.col("volatility"),
    })
    return m.withColumns({
        "slippage_multiplier": F.col("spread_ticks") / F.lit(float(base_ticks)),
        "commission_multiplier": F.col("commission_rate") / F.lit(base_comm),
    })
