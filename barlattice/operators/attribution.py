"""Correlation matrices, strategy decomposition, per-strategy statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.exprs import finite, over_zero
from barlattice.functions.probability import t_two_sided
from barlattice.operators.metrics import trade_stats
from barlattice.operators.pnl import HORIZONS, period_label, resample, spine
from barlattice.plans.blocks import running
from barlattice.plans.salt import join_small
from barlattice.plans.lineage import settle

MIN_PERIODS = 5
FLAT = 1e-8
MIN_TAIL_DAYS = 20


def pair_correlations(
    rows: DataFrame, keys: Sequence[str], period: str, label: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Long correlation matrix over ``names``: (keys, row_label, col_label, n, corr).

    A period is one row with the values of its names; each pair of names in a period is one input
    of one aggregation, added up before it is shuffled. The plan is the same for any number of names.
    """
    keys, names = list(keys), list(names)
    known = F.array(*[F.lit(n) for n in names])
    per = (
        rows.withColumn("_i", F.array_position(known, F.col(label)).cast("int") - 1)
        .where((F.col("_i") >= 0) & F.col(value).isNotNull())
        .groupBy(*keys, period, "_i").agg(F.sum(value).alias("_v"))
        .groupBy(*keys, period).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_all"))
    )
    pairs = (
        per.select(*keys, "_all", F.posexplode("_all").alias("_at", "_x"))
        .select(*keys, "_x", F.explode(F.slice("_all", F.col("_at") + 1, F.size("_all"))).alias("_y"))
        .groupBy(*keys, F.col("_x._i").alias("_i"), F.col("_y._i").alias("_j"))
        .agg(F.count(F.lit(1)).alias("n"), F.corr("_x._v", "_y._v").alias("c"), F.stddev_samp("_x._v").alias("_std"))
    )
    last = len(names) - 1
    cells = (
        rows.select(*keys).distinct()
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .withColumn("_j", F.explode(F.sequence(F.col("_i"), F.lit(last))))
    )
    one = F.when(F.col("_std") > 0, F.lit(1.0))
    out = cells.join(pairs, [*keys, "_i", "_j"], "left").select(*keys, F.struct(
        F.element_at(known, F.col("_i") + 1).alias("a"), F.element_at(known, F.col("_j") + 1).alias("b"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("_i") == F.col("_j"), one).otherwise(F.col("c")).alias("c")).alias("_m"))
    both = F.array(F.struct(F.col("_m.a").alias("row_label"), F.col("_m.b").alias("col_label")),
                   F.struct(F.col("_m.b").alias("row_label"), F.col("_m.a").alias("col_label")))
    return out.withColumn("_x", F.explode(F.array_distinct(both))).select(
        *keys, "_x.*", F.col("_m.n").alias("n"), finite(F.col("_m.c")).alias("corr"))


def strategy_correlation(
    bar_pnl: DataFrame, slots: dict[int, str], horizon: str = "1d", min_periods: int = MIN_PERIODS
) -> DataFrame:
    """Correlation of incremental PnL per period; empty below two strategies or five periods."""
    if len(slots) < 2:
        return bar_pnl.sparkSession.createDataFrame(
            [], "run_id STRING, row_label STRING, col_label STRING, n BIGINT, corr DOUBLE")
    per = resample(bar_pnl, horizon)
    label = F.element_at(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]), F.col("slot_id"))
    named = per.withColumn("strategy", label)
    enough = named.groupBy("run_id").agg(F.countDistinct("period").alias("_n")).where(
        F.col("_n") >= min_periods).select("run_id")
    m = pair_correlations(named, ["run_id"], "period", "strategy", "pnl", list(slots.values()))
    return m.join(enough, "run_id", "left_semi")


def exposure_by_period(exposure: DataFrame, horizon: str = "1d") -> DataFrame:
    """Mean absolute notional per symbol and period, slots summed first."""
    h = horizon if horizon in HORIZONS else "1d"
    net = exposure.groupBy("run_id", "symbol", "ts").agg(F.sum("notional").alias("notional"))
    return net.groupBy("run_id", "symbol", period_label("ts", h).alias("period")).agg(
        F.avg(F.abs("notional")).alias("exposure"))


def exposure_activity(per: DataFrame, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Which symbols have enough periods and any variation."""
    return per.groupBy("run_id", "symbol").agg(
        F.count("exposure").alias("n"), F.stddev_samp("exposure").alias("std")
    ).withColumn("is_active", (F.col("n") >= min_periods) & F.coalesce(F.col("std") > FLAT, F.lit(False)))


def exposure_correlation(
    exposure: DataFrame, symbols: Sequence[str], horizon: str = "1d", min_periods: int = MIN_PERIODS
) -> tuple[DataFrame, DataFrame]:
    """Correlation matrix of active symbols, and the dropped symbols."""
    per = exposure_by_period(exposure, horizon)
    act = exposure_activity(per, min_periods)
    live = act.where("is_active").select("run_id", "symbol")
    m = pair_correlations(per.join(live, ["run_id", "symbol"], "left_semi"), ["run_id"], "period",
                          "symbol", "exposure", symbols)
    return m.where(F.col("n") > 0), act.where(~F.col("is_active")).select("run_id", "symbol")


def heatmap(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Matrix cells with their row and column position in ``labels``."""
    known = F.array(*[F.lit(x) for x in labels])
    return matrix.withColumns({
        "row_idx": F.array_position(known, F.col("row_label")) - 1,
        "col_idx": F.array_position(known, F.col("col_label")) - 1})


def _named(slots: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]), F.col("slot_id"))


def drawdown_window(totals: DataFrame, true_window: bool = False) -> DataFrame:
    """(run_id, dd_start, dd_end) of cumulative PnL.

    From the first global peak to the lowest point after it; ``true_window`` gives the deepest
    drawdown instead. ``totals`` are (run_id, ts, total).
    """
    cum = running(totals, ["run_id"], "ts", sums={"cum": "total"})
    if true_window:
        peaks = running(cum, ["run_id"], "ts", maxes={"_pk": "cum"})
        low = peaks.groupBy("run_id").agg(F.min(F.struct(
            (F.col("cum") - F.col("_pk")).alias("d"), F.col("ts"), F.col("_pk"))).alias("_l"))
        low = low.select("run_id", F.col("_l.ts").alias("dd_end"), F.col("_l._pk").alias("_pk"))
        at = join_small(cum, low, ["run_id"]).where((F.col("ts") <= F.col("dd_end")) & (F.col("cum") == F.col("_pk")))
        return at.groupBy("run_id").agg(F.min("ts").alias("dd_start"), F.max("dd_end").alias("dd_end"))
    first_top = F.min(F.struct((-F.col("cum")).alias("k"), "ts"))
    start = cum.groupBy("run_id").agg(first_top.alias("_f")).select(
        "run_id", F.col("_f.ts").alias("dd_start"))
    after = join_small(cum, start, ["run_id"]).where(F.col("ts") >= F.col("dd_start"))
    return after.groupBy("run_id", "dd_start").agg(
        F.min(F.struct("cum", "ts")).alias("_l")).select("run_id", "dd_start", F.col("_l.ts").alias("dd_end"))


def duty_cycles(exposure: DataFrame) -> DataFrame:
    """Mean squared use of the largest notional per slot, over all times of the run."""
    per = exposure.groupBy("run_id", "slot_id", "ts").agg(F.sum(F.abs("notional")).alias("x"))
    top = per.groupBy("run_id", "slot_id").agg(
        F.max("x").alias("_top"), F.sum(F.col("x") * F.col("x")).alias("_sq"))
    n = per.groupBy("run_id").agg(F.countDistinct("ts").alias("_n"))
    return top.join(n, "run_id").where(F.col("_top") > 1e-9).select(
        "run_id", "slot_id", (F.col("_sq") / (F.col("_top") * F.col("_top")) / F.col("_n")).alias("duty_cycle"))


def decomposition(
    trades: DataFrame, bar_pnl: DataFrame, slots: dict[int, str], tail_confidence: float = 0.95,
    exposure: DataFrame | None = None,
) -> DataFrame:
    """Attribution per strategy: closed PnL and its share, variance share, drawdown-window and
    tail-day PnL, PnL before costs, costs, daily signal-to-noise, duty cycle."""
    run, per_slot = ["run_id"], ["run_id", "slot_id"]
    ids = list(slots)
    # One row per time with a column per slot: totals and all per-slot moments come from it.
    wide = bar_pnl.groupBy("run_id", "ts").agg(*[
        F.sum(F.when(F.col("slot_id") == i, F.col("pnl"))).alias(f"p{i}") for i in ids])
    total = reduce(lambda a, c: a + c, [F.coalesce(f"p{i}", F.lit(0.0)) for i in ids])
    wide = settle(wide.withColumn("total", total))  # read by every part below
    window = drawdown_window(wide.select("run_id", "ts", "total"))
    inside = F.col("ts").between(F.col("dd_start"), F.col("dd_end"))
    bars = join_small(wide, window, run).groupBy(*run).agg(
        F.var_samp("total").alias("_var"),
        F.array(*[F.struct(
            F.lit(i).alias("slot_id"), F.covar_samp(f"p{i}", "total").alias("_cov"),
            F.sum(f"p{i}").alias("_mtm"), F.sum(F.when(inside, F.col(f"p{i}"))).alias("dd_pnl"),
        ) for i in ids]).alias("_s"),
    ).select("run_id", "_var", F.explode("_s").alias("_s")).select("run_id", "_var", "_s.*")
    days = wide.groupBy("run_id", F.to_date("ts").alias("day")).agg(
        *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in (*[f"p{i}" for i in ids], "total")])
    days = spine(days, run, "day", "1d").join(days, ["run_id", "day"], "left").na.fill(0.0)
    of_run = Window.partitionBy(*run)
    days = days.withColumns({
        "_days": F.count("*").over(of_run),
        "_q": F.percentile("total", F.lit(round(1.0 - tail_confidence, 12))).over(of_run)})
    tail = (F.col("_days") >= MIN_TAIL_DAYS) & (F.col("total") <= F.col("_q"))

    def noise(c: str) -> Column:
        std = F.stddev_samp(c)
        return F.when(std > FLAT, F.avg(c) / F.when(std > FLAT, std) * math.sqrt(252.0))

    daily = days.groupBy(*run).agg(F.array(*[F.struct(
        F.lit(i).alias("slot_id"), noise(f"p{i}").alias("sharpe_like"),
        F.avg(F.when(tail, F.col(f"p{i}"))).alias("tail_pnl")) for i in ids]).alias("_s"),
    ).select("run_id", F.explode("_s").alias("_s")).select("run_id", "_s.*")
    closed = trades.groupBy("run_id", "strategy").agg(
        F.sum("pnl").alias("_closed"),
        F.abs(F.coalesce(F.sum("commission"), F.lit(0.0)) + F.coalesce(F.sum("slippage"), F.lit(0.0))).alias("_cost"))
    all_closed = closed.groupBy(*run).agg(F.sum(F.abs("_closed")).alias("_all"))
    out = (
        bars.join(daily, per_slot)
        .withColumn("strategy", _named(slots))
        .join(closed, ["run_id", "strategy"], "left").join(all_closed, run, "left")
    )
    if exposure is not None:
        out = out.join(duty_cycles(exposure), per_slot, "left")
    else:
        out = out.withColumn("duty_cycle", F.lit(None).cast("double"))
    zero = F.lit(0.0)
    c, cost = F.coalesce("_closed", zero), F.coalesce("_cost", zero)
    by_trades = F.coalesce(F.col("_all") > 0, F.lit(False))
    all_mtm = F.sum(F.abs("_mtm")).over(Window.partitionBy(*run))
    share = F.when(by_trades, c / F.nullif("_all", zero)).otherwise(over_zero(F.col("_mtm"), all_mtm)) * 100.0
    risk = F.when(F.col("_var") > 0, F.col("_cov") / F.nullif("_var", zero) * 100.0)
    return out.select(
        *per_slot, "strategy", "sharpe_like", c.alias("closed_pnl"), share.alias("pnl_contrib_pct"),
        risk.alias("risk_contrib_pct"), "dd_pnl", "tail_pnl", (c + cost).alias("signal_pnl"),
        (-cost).alias("exec_cost"), "duty_cycle")


DISPLAY_DIGITS = {
    "sharpe_like": 2, "closed_pnl": 0, "pnl_contrib_pct": 1, "risk_contrib_pct": 1, "dd_pnl": 0,
    "tail_pnl": 0, "signal_pnl": 0, "duty_cycle": 4,
}


def decomposition_table(table: DataFrame, sort_by: str = "pnl_contrib_pct") -> DataFrame:
    """Rounded and sorted by any column: numbers descending with nulls last, text ascending."""
    if sort_by not in table.columns:
        sort_by = "pnl_contrib_pct"
    shown = table.withColumns({c: F.bround(c, n) for c, n in DISPLAY_DIGITS.items()})
    text = dict(table.dtypes)[sort_by] == "string"
    key = F.col(sort_by).asc_nulls_last() if text else F.col(sort_by).desc_nulls_last()
    return shown.orderBy(key, "slot_id")


def t_test(mean: Column, std: Column, n: Column) -> tuple[Column, Column]:
    """One-sample t statistic and two-sided p-value; 0 and 1 when not defined."""
    ok = (n > 1) & (std > 0)
    t = F.when(ok, mean / (F.when(ok, std) / F.sqrt(n))).otherwise(0.0)
    return t, ok


def strategy_stats(trades: DataFrame, slots: dict[int, str] | None) -> DataFrame:
    """Trades, win percent, average, largest loss, t and p for every slot, also without trades.

    With a single logical strategy all trades count for it.
    """
    names = list((slots or {0: "Single Asset"}).values())
    rows = trades
    if len(names) == 1:
        rows = trades.withColumn("strategy", F.lit(names[0]))
    moments = rows.groupBy("strategy").agg(
        F.min("pnl").alias("_min"), F.avg("pnl").alias("_m"), F.stddev_samp("pnl").alias("_s"),
        F.count("pnl").alias("_n"))
    stats = trade_stats(rows, ["strategy"]).join(moments, "strategy")
    base = trades.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("strategy"))
    out = base.join(stats, "strategy", "left")
    t, ok = t_test(F.col("_m"), F.col("_s"), F.col("_n"))
    zero = F.lit(0.0)
    out = out.withColumns({"t_stat": F.coalesce(t, zero), "_ok": F.coalesce(ok, F.lit(False))})
    p = t_two_sided(F.col("t_stat"), (F.col("_n") - 1).cast("double"))
    return out.select(
        "strategy", F.coalesce("total_trades", F.lit(0)).alias("total_trades"),
        (F.coalesce("win_rate", zero) * 100.0).alias("win_rate_pct"),
        F.coalesce("avg_trade", zero).alias("avg_trade"), F.coalesce("_min", zero).alias("max_loss"),
        "t_stat", F.when(F.col("_ok"), p).otherwise(1.0).alias("p_value"))


def main_symbols(trades: DataFrame) -> DataFrame:
    """Most traded symbol per strategy; the smaller name on ties."""
    n = trades.groupBy("strategy", "symbol").agg(F.count("*").alias("n"))
    return n.groupBy("strategy").agg(F.min(F.struct((-F.col("n")).alias("k"), "symbol")).alias("_s")).select(
        "strategy", F.col("_s.symbol").alias("symbol"), (-F.col("_s.k")).alias("trades"))


def instrument_returns(closes: DataFrame, legacy_zero_gaps: bool = False) -> DataFrame:
    """Daily returns of (symbol, day, close), 0 on the first day.

    Days without a close are left out; with ``legacy_zero_gaps`` they, and the day after, return 0.
    """
    w = Window.partitionBy("symbol").orderBy("day")
    if legacy_zero_gaps:
        closes = spine(closes, ["symbol"], "day", "1d").join(closes, ["symbol", "day"], "left")
    prev = F.lag("close").over(w)
    return closes.withColumn("x", F.coalesce(over_zero(F.col("close"), prev) - 1.0, F.lit(0.0))).select(
        "symbol", "day", "x")


def alpha_beta(returns: DataFrame, instrument: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Regression of daily strategy returns on the instrument's: beta, annual alpha in percent, p-values.

    ``returns`` are (keys, symbol, day, y). Fewer than three common days give 0 and p = 1.
    """
    keys = list(keys)
    j = returns.where(F.col("y").isNotNull()).join(instrument, ["symbol", "day"])
    m = j.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("mx"))
    dof = F.col("n") - 2
    ok = (dof > 0) & (F.col("sxx") > 0)
    rss = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / F.nullif(dof, F.lit(0))
    se_b = F.sqrt(rss / F.nullif("sxx", F.lit(0.0)))
    se_a = F.sqrt(rss * (1.0 / F.col("n") + F.col("mx") * F.col("mx") / F.nullif("sxx", F.lit(0.0))))
    m = m.withColumns({
        "_ok": ok, "beta_t": F.when(ok, over_zero(F.col("b"), se_b)),
        "alpha_t": F.when(ok, over_zero(F.col("a"), se_a))})
    d = dof.cast("double")
    return m.select(
        *keys, "n",
        F.when(F.col("_ok"), F.col("b")).otherwise(0.0).alias("beta"),
        F.when(F.col("_ok"), F.col("a") * 252.0 * 100.0).otherwise(0.0).alias("alpha"),
        "beta_t", "alpha_t",
        F.coalesce(t_two_sided(F.col("beta_t"), d), F.lit(1.0)).alias("beta_p"),
        F.coalesce(t_two_sided(F.col("alpha_t"), d), F.lit(1.0)).alias("alpha_p"))


def exit_summary(trades: DataFrame) -> DataFrame:
    """Counts, win percent and mean excursion, decay and hold per strategy."""
    hold = (F.unix_micros(F.col("exit_time").cast("timestamp"))
            - F.unix_micros(F.col("entry_time").cast("timestamp"))) / F.lit(6e7)
    zero = F.lit(0.0)
    return trades.groupBy("strategy").agg(
        F.count("*").alias("total_trades"),
        (F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)) * 100.0).alias("win_rate_pct"),
        F.avg("pnl").alias("avg_trade"),
        F.coalesce(F.avg("pnl_decay_60m"), zero).alias("pnl_decay_60m"),
        F.coalesce(F.avg("mfe"), zero).alias("avg_mfe"), F.coalesce(F.avg("mae"), zero).alias("avg_mae"),
        F.floor(F.avg(hold)).cast("long").alias("avg_hold_min"))
