"""Drawdown, VaR, rolling risk, stress paths and the risk profile per stream.

Rolling measures work on one row per stream and day, so their windows are bounded by the calendar;
bar-level work (running peaks) goes through per-period scans.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlattice.functions.exprs import DAY, MICROS, finite, loss, micros, over_zero
from barlattice.functions.order_stats import rolling_tail
from barlattice.operators.pnl import (
    daily_equity, period_label, spine, tail_columns, tail_stats, with_daily_change, with_tails,
)
from barlattice.plans.blocks import running

TRADING_DAYS = 252.0
FLAT = 1e-8
VOL_WINDOWS = (20, 50, 100)
HORIZON_PERIODS = {"1d": 252.0, "1w": 52.0, "1m": 12.0}


def drawdown(
    equity: DataFrame, keys: Sequence[str] = ("stream",), period_seconds: int = DAY
) -> DataFrame:
    """Percent below the running peak; null where the peak is 0."""
    rows = equity.where(F.col("equity").isNotNull())
    peaks = running(rows, list(keys), "ts", maxes={"peak": "equity"}, period_seconds=period_seconds)
    return peaks.withColumn(
        "drawdown_pct", over_zero(F.col("equity") - F.col("peak"), F.col("peak")) * 100.0)


def episodes(
    dd: DataFrame, keys: Sequence[str] = ("stream",), period_seconds: int = DAY
) -> DataFrame:
    """Drawdown episodes: start, first lowest point, recovery (or last row), depth, days.

    An episode is numbered by the recovered rows before it, so it closes with the recovered row
    of the same number; grouping on that number is an ordinary partial aggregation.
    """
    keys = list(keys)
    rows = dd.where(F.col("drawdown_pct").isNotNull()).withColumn(
        "_up", F.when(F.col("drawdown_pct") >= 0, 1).otherwise(0))
    n = running(rows, keys, "ts", sums={"_n": "_up"}, period_seconds=period_seconds)
    low = F.col("drawdown_pct") < 0
    out = (
        n.withColumn("_ep", F.col("_n") - F.col("_up"))
        .groupBy(*keys, "_ep")
        .agg(
            F.min(F.when(low, F.col("ts"))).alias("start_ts"),
            F.min(F.when(low, F.struct("drawdown_pct", "ts"))).alias("_t"),
            F.coalesce(F.min(F.when(~low, F.col("ts"))), F.max("ts")).alias("end_ts"),
        )
        .where(F.col("start_ts").isNotNull())
    )
    days = (micros("end_ts") - micros("start_ts")) / F.lit(float(DAY * MICROS))
    return out.select(
        *keys, "start_ts", F.col("_t.ts").alias("trough_ts"), "end_ts",
        F.col("_t.drawdown_pct").alias("depth_pct"), F.abs("_t.drawdown_pct").alias("depth_abs_pct"),
        days.alias("duration_days"))


def var_es(
    daily: DataFrame, primary: float, tail: float, keys: Sequence[str] = ("stream",)
) -> DataFrame:
    return tail_stats(daily, keys, {"primary": primary, "tail": tail})


def _window(keys: Sequence[str], n: int):
    return Window.partitionBy(*keys).orderBy("day").rowsBetween(-(n - 1), 0)


def _need(n: int) -> int:
    return min(n, max(n // 2, 5))


def rolling_var_es(
    daily: DataFrame, n: int, primary: float, tail: float, keys: Sequence[str] = ("stream",)
) -> DataFrame:
    """Rolling historical VaR, ES and breach flags of daily PnL.

    The days of a stream are one task, as in all daily tables; the window is asked for order statistics
    and sums, so its length does not matter.
    """
    levels = {"primary": primary, "tail": tail}
    made = T.StructType([*daily.schema.fields, *[T.StructField(f"_{x}_{k}", T.DoubleType()) for k in levels for x in ("q", "es")]])

    def tails(days: pa.Table) -> pa.Table:
        days = days.sort_by("day")
        pnl = np.asarray(days.column("pnl").cast(pa.float64()).to_numpy(), float)
        found = rolling_tail(pnl, n, _need(n), [round(1.0 - c, 12) for c in levels.values()])
        for k, pair in zip(levels, found):
            for x, values in zip(("q", "es"), pair):
                days = days.append_column(f"_{x}_{k}", pa.array(values, pa.float64(), mask=np.isnan(values)))
        return days

    out = daily.where(F.col("pnl").isNotNull()).groupBy(*keys).applyInArrow(tails, made)
    cols: dict[str, Column] = {}
    for k in levels:
        cols[f"var_{k}"] = loss(F.col(f"_q_{k}"))
        cols[f"es_{k}"] = loss(F.col(f"_es_{k}"))
        cols[f"breach_{k}"] = F.coalesce(F.col("pnl") <= -loss(F.col(f"_q_{k}")), F.lit(False))
    return out.withColumns(cols).drop(*[f"_{x}_{k}" for k in levels for x in ("q", "es")])


def _rolling_vol_columns(windows: Sequence[int], keys: Sequence[str]) -> dict[str, Column]:
    out = {}
    for n in windows:
        if n > 0:
            w = _window(keys, n)
            out[f"vol_{n}d"] = F.when(
                F.col("ret").isNotNull() & (F.count("ret").over(w) >= _need(n)),
                F.stddev_samp("ret").over(w) * math.sqrt(TRADING_DAYS) * 100.0)
    return out


def rolling_volatility(
    daily: DataFrame, windows: Sequence[int] = VOL_WINDOWS, keys: Sequence[str] = ("stream",)
) -> DataFrame:
    """Annualised percent deviation of daily returns, one column per window."""
    return daily.where(F.col("ret").isNotNull()).withColumns(_rolling_vol_columns(windows, keys))


def annualised_sharpe(mean: Column, std: Column, n: Column, rf: float = 0.0) -> Column:
    """Null below two returns or without dispersion."""
    ok = (n >= 2) & (std > FLAT)
    return F.when(ok, (mean - rf / TRADING_DAYS) / F.when(ok, std) * math.sqrt(TRADING_DAYS))


def daily_sharpe(daily: DataFrame, keys: Sequence[str] = ("stream",), rf: float = 0.0) -> DataFrame:
    return daily.groupBy(*keys).agg(
        annualised_sharpe(F.avg("ret"), F.stddev_samp("ret"), F.count("ret"), rf).alias("sharpe"))


def rolling_sharpe(
    daily: DataFrame, n: int = 90, keys: Sequence[str] = ("stream",), rf: float = 0.0
) -> DataFrame:
    """Rolling annualised Sharpe of daily returns; flat windows and short streams give null."""
    w = _window(keys, n)
    std = F.stddev_samp("ret").over(w)
    ok = (F.count("ret").over(w) >= max(n // 2, 5)) & (std > FLAT)
    value = (F.avg("ret").over(w) - rf / TRADING_DAYS) / F.when(ok, std) * math.sqrt(TRADING_DAYS)
    return daily.where(F.col("ret").isNotNull()).withColumn("rolling_sharpe", F.when(ok, value))


def horizon_sharpe(
    daily: DataFrame, horizon: str = "1d", keys: Sequence[str] = ("stream",), rf: float = 0.0
) -> DataFrame:
    """Annualised Sharpe of returns compounded per day, week or month; empty periods return 0."""
    keys = list(keys)
    h = horizon if horizon in HORIZON_PERIODS else "1d"
    rets = daily.where(F.col("ret").isNotNull())
    if h != "1d":
        per = rets.withColumn("period", period_label("day", h)).groupBy(*keys, "period").agg(
            (F.product(F.col("ret") + 1.0) - 1.0).alias("ret"))
        rets = spine(per, keys, "period", h).join(per, [*keys, "period"], "left").withColumn(
            "ret", F.coalesce("ret", F.lit(0.0)))
    m = HORIZON_PERIODS[h]
    rf_p = (1.0 + rf) ** (1.0 / m) - 1.0
    std = F.stddev_samp("ret")
    ok = (F.count("ret") >= 2) & (std > FLAT)
    return rets.groupBy(*keys).agg(
        F.when(ok, (F.avg("ret") - rf_p) / F.when(ok, std) * math.sqrt(m)).alias("sharpe"))


def _latest(windows: Sequence[int]) -> Column:
    """First non-null volatility column of the last day that has any."""
    known = F.coalesce(*[f"vol_{n}d" for n in windows if n > 0])
    return F.max_by(known, F.when(known.isNotNull(), F.col("day")))


def latest_volatility(
    daily: DataFrame, windows: Sequence[int], keys: Sequence[str] = ("stream",)
) -> DataFrame:
    return rolling_volatility(daily, windows, keys).groupBy(*keys).agg(
        _latest(windows).alias("latest_vol_pct"))


def risk_summary(
    equity: DataFrame, primary: float = 0.95, tail: float = 0.99,
    windows: Sequence[int] = VOL_WINDOWS, rf: float = 0.0, keys: Sequence[str] = ("stream",),
    period_seconds: int = DAY,
) -> DataFrame:
    """The summary row of a risk profile for every stream at once.

    Equity is read twice: once reduced to days, once for the drawdown episodes.
    """
    keys = list(keys)
    levels = {"primary": primary, "tail": tail}
    daily = with_tails(with_daily_change(daily_equity(equity, keys), keys), keys, levels)
    base = daily.withColumns(_rolling_vol_columns(windows, keys)).groupBy(*keys).agg(
        F.sum("pnl").alias("total_pnl"),
        annualised_sharpe(F.avg("ret"), F.stddev_samp("ret"), F.count("ret"), rf).alias("sharpe"),
        *tail_columns(levels), _latest(windows).alias("latest_vol_pct"))
    depth = episodes(drawdown(equity, keys, period_seconds), keys, period_seconds).groupBy(*keys).agg(
        F.max("depth_abs_pct").alias("_deepest"),
        F.avg("depth_abs_pct").alias("avg_drawdown_pct"),
        F.percentile("depth_abs_pct", F.lit(0.5)).alias("median_drawdown_pct"),
        F.percentile("depth_abs_pct", F.lit(0.95)).alias("drawdown_95_pct"),
        F.max("duration_days").alias("max_drawdown_duration_days"))
    return base.join(depth, keys, "left").withColumn(
        "max_drawdown_pct", F.coalesce("_deepest", F.lit(0.0))).drop("_deepest")


def risk_profile(
    equity: DataFrame, n_var: int, primary: float = 0.95, tail: float = 0.99,
    windows: Sequence[int] = VOL_WINDOWS, rf: float = 0.0, keys: Sequence[str] = ("stream",),
) -> dict[str, DataFrame]:
    """All tables of a profile, keyed by name; each holds every stream."""
    daily = with_daily_change(daily_equity(equity, keys), keys)
    dd = drawdown(equity, keys)
    return {
        "daily": daily, "drawdown": dd, "episodes": episodes(dd, keys),
        "rolling_var": rolling_var_es(daily, n_var, primary, tail, keys),
        "rolling_vol": rolling_volatility(daily, windows, keys),
        "summary": risk_summary(equity, primary, tail, windows, rf, keys),
    }


def daily_costs(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Commission and absolute slippage per exit day."""
    return trades.where(F.col("exit_time").isNotNull()).groupBy(
        *keys, F.to_date("exit_time").alias("day")
    ).agg(F.sum("commission").alias("commission"), F.abs(F.sum("slippage")).alias("slippage"))


SCENARIOS = ("baseline", "volatility", "slippage", "commission", "combined")


def stress_paths(
    daily: DataFrame, costs: DataFrame, multipliers: Mapping[str, float], keys: Sequence[str] = ("stream",)
) -> DataFrame:
    """Daily PnL and equity of five scenarios per stream.

    Volatility rescales the demeaned PnL after the first day, whose synthetic 0 stays the anchor.
    Cost multipliers are levels relative to the realised costs.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("day")
    d = daily.withColumn("_first", F.row_number().over(w) == 1)
    stats = d.groupBy(*keys).agg(
        F.avg(F.when(~F.col("_first"), F.col("pnl"))).alias("_mean"),
        F.min_by("equity", "day").alias("_start"))
    d = d.join(stats, keys).join(
        costs.select(*keys, "day", F.col("commission").alias("_c"), F.col("slippage").alias("_s")),
        [*keys, "day"], "left")
    base = F.when(F.col("_first"), 0.0).otherwise(F.col("pnl"))
    vol = F.when(F.col("_first"), 0.0).otherwise(
        F.col("_mean") + (F.col("pnl") - F.col("_mean")) * float(multipliers["volatility"]))
    slip = F.coalesce("_s", F.lit(0.0)) * (float(multipliers["slippage"]) - 1.0)
    comm = F.coalesce("_c", F.lit(0.0)) * (float(multipliers["commission"]) - 1.0)
    values = (base, vol, base - slip, base - comm, vol - slip - comm)
    parts = F.array(*[F.struct(F.lit(n).alias("scenario"), v.alias("pnl"))
                      for n, v in zip(SCENARIOS, values)])
    long = d.select(*keys, "day", "_start", F.explode(parts).alias("_p")).select(
        *keys, "day", "_start", "_p.scenario", "_p.pnl")
    run = Window.partitionBy(*keys, "scenario").orderBy("day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return long.withColumn("equity", F.col("_start") + F.sum("pnl").over(run)).drop("_start")


def stress_metrics(
    paths: DataFrame, primary: float = 0.95, tail: float = 0.99, rf: float = 0.0,
    keys: Sequence[str] = ("stream",),
) -> DataFrame:
    """Metrics per scenario and the PnL difference to the baseline."""
    by = [*keys, "scenario"]
    w = Window.partitionBy(*by).orderBy("day")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prev = F.lag("equity").over(w)
    p = paths.withColumns({
        "_dd": over_zero(F.col("equity") - peak, peak) * 100.0,
        "ret": finite(over_zero(F.col("equity"), prev) - 1.0)})
    levels = {"primary": primary, "tail": tail}
    m = with_tails(p, by, levels).groupBy(*by).agg(
        F.sum("pnl").alias("final_pnl"), F.max_by("equity", "day").alias("end_equity"),
        F.abs(F.min("_dd")).alias("max_drawdown_pct"),
        annualised_sharpe(F.avg("ret"), F.stddev_samp("ret"), F.count("ret"), rf).alias("sharpe"),
        *tail_columns(levels))
    of_base = F.max(F.when(F.col("scenario") == "baseline", F.col("final_pnl"))).over(
        Window.partitionBy(*keys))
    return m.withColumn("pnl_delta", F.col("final_pnl") - of_base)


