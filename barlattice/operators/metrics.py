"""Performance of equity streams and trade statistics, one row per stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.functions.exprs import DAY, MICROS, finite, micros, over_zero
from barlattice.functions.probability import norm_cdf, norm_ppf, t_two_sided
from barlattice.plans.blocks import Series, running

EULER_GAMMA = 0.5772156649
MIN_DSR_RETURNS = 30


def equity_path(
    equity: DataFrame, keys: Sequence[str] = ("stream",), period_seconds: int = DAY,
    block_rows: int | None = None,
) -> DataFrame:
    """Equity rows with ``ret`` (finite simple return, null on the first row) and running ``peak``."""
    keys = list(keys)
    peaks = running(equity.where(F.col("equity").isNotNull()), keys, "ts",
                    maxes={"peak": "equity"}, period_seconds=period_seconds)
    s = Series(peaks, keys, block_rows=block_rows, period_seconds=period_seconds)
    prev = s.lag("equity")
    s.add("ret", finite(over_zero(F.col("equity"), F.col(prev)) - 1.0), ["equity", prev])
    return s.frame().drop(prev, "_rn")


def years(first: Column, last: Column) -> Column:
    """Whole elapsed days over 365.25; less than a day counts as one year."""
    days = F.floor((micros(last) - micros(first)) / F.lit(float(DAY * MICROS)))
    return F.when(days > 0, days / F.lit(365.25)).otherwise(F.lit(1.0))


def cagr(total_return: Column, yrs: Column) -> Column:
    base = total_return + 1.0
    ok = (yrs > 0) & (base > 0)
    return F.when(ok, F.pow(F.when(ok, base), 1.0 / F.when(yrs > 0, yrs)) - 1.0).otherwise(0.0)


def ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else 0."""
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(0.0))


def return_moments(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, population skewness and raw kurtosis of finite returns."""
    return path.groupBy(*keys).agg(*_moments())


def _moments() -> list[Column]:
    neg = F.when(F.col("ret") < 0, F.col("ret"))
    return [
        F.count("ret").alias("n_ret"),
        F.avg("ret").alias("mean_ret"),
        F.stddev_samp("ret").alias("std_ret"),
        F.stddev_samp(neg).alias("std_neg"),
        F.skewness("ret").alias("skew_ret"),
        (F.kurtosis("ret") + 3.0).alias("kurt_ret"),
    ]


def sample_sharpe(mean: Column, std: Column, rf: float = 0.0) -> Column:
    """Not annualised; 0 without dispersion."""
    return F.coalesce(ratio(mean - rf, std), F.lit(0.0))


def summary_columns(rf: float = 0.0) -> dict[str, Column]:
    """Metric columns over the aggregate of :func:`performance`, in dependency order."""
    c = F.col
    return {
        "total_pnl": c("last_equity") - c("first_equity"),
        "total_return": over_zero(c("last_equity"), c("first_equity")) - 1.0,
        "years": years(c("first_ts"), c("last_ts")),
        "bars_per_year": c("n_bars") / c("years"),
        "cagr": cagr(c("total_return"), c("years")),
        "volatility": F.coalesce(c("std_ret") * F.sqrt("bars_per_year"), F.lit(0.0)),
        "sharpe": ratio(c("cagr") - rf, c("volatility")),
        "sortino": F.coalesce(
            ratio(c("cagr") - rf, c("std_neg") * F.sqrt("bars_per_year")), F.lit(0.0)),
        "calmar": F.when(c("max_drawdown") != 0, over_zero(c("cagr"), F.abs("max_drawdown"))).otherwise(0.0),
        "sample_sharpe": sample_sharpe(c("mean_ret"), c("std_ret")),
        "t_stat": F.when((c("n_ret") < 2) | (c("std_ret") == 0), 0.0).otherwise(
            over_zero(c("mean_ret"), c("std_ret") / F.sqrt("n_ret"))),
    }


def aggregate_path(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    dd = over_zero(F.col("equity") - F.col("peak"), F.col("peak"))
    return path.groupBy(*keys).agg(
        F.count("*").alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("equity", "ts").alias("first_equity"), F.max_by("equity", "ts").alias("last_equity"),
        F.min(dd).alias("max_drawdown"), *_moments(),
    )


def performance(
    equity: DataFrame, keys: Sequence[str] = ("stream",), rf: float = 0.0, trials: int = 1,
    trial_sharpes: DataFrame | None = None, period_seconds: int = DAY,
) -> DataFrame:
    """All equity metrics, one row per stream.

    ``trial_sharpes`` (keys, sharpe) raises the bar of the deflated Sharpe when trials > 1.
    """
    keys = list(keys)
    out = aggregate_path(equity_path(equity, keys, period_seconds), keys)
    for name, value in summary_columns(rf).items():
        out = out.withColumn(name, value)
    out = out.withColumn("p_value", F.when(
        (F.col("n_ret") < 2) | (F.col("std_ret") == 0), 1.0
    ).otherwise(t_two_sided(F.col("t_stat"), (F.col("n_ret") - 1).cast("double"))))
    return deflated_sharpe(out, keys, trials, trial_sharpes)


def expected_max_sharpe(trials: Column, mean: Column, std: Column) -> Column:
    """Largest of ``trials`` independent Sharpe ratios to expect by chance."""
    a = norm_ppf(1.0 - 1.0 / trials)
    b = norm_ppf(1.0 - 1.0 / (trials * F.e()))
    return mean + std * ((1.0 - EULER_GAMMA) * a + EULER_GAMMA * b)


def deflated_sharpe(
    summary: DataFrame, keys: Sequence[str], trials: int = 1, trial_sharpes: DataFrame | None = None
) -> DataFrame:
    """Adds ``dsr`` to rows that carry return moments and the sample Sharpe ratio."""
    s = F.col("sample_sharpe")
    var = (1.0 - F.col("skew_ret") * s + (F.col("kurt_ret") - 1.0) / 4.0 * s * s) / F.nullif(
        F.col("n_ret") - 1, F.lit(0))
    sigma = F.when(var > 0, F.sqrt(var))
    if trials > 1 and trial_sharpes is not None:
        t = trial_sharpes.groupBy(*keys).agg(
            F.avg("sharpe").alias("_m"), F.stddev_pop("sharpe").alias("_s"))
        summary = summary.join(t, list(keys), "left").withColumn(
            "sr_star",
            F.coalesce(expected_max_sharpe(F.lit(float(trials)), F.col("_m"), F.col("_s")), F.lit(0.0)),
        ).drop("_m", "_s")
    else:
        summary = summary.withColumn("sr_star", F.lit(0.0))
    z = (s - F.col("sr_star")) / sigma
    enough = (F.col("n_ret") >= MIN_DSR_RETURNS) & (s != 0) & sigma.isNotNull()
    return summary.withColumn("_z", F.when(enough, z)).withColumn(
        "dsr", F.coalesce(norm_cdf("_z"), F.lit(0.0))).drop("_z")


def trade_stats(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, win rate, profit factor and averages of closed trades.

    Winners have pnl > 0. The profit factor is infinite without losses and 0 without wins.
    Without ``keys`` an empty table gives one row of zeros.
    """
    p = F.col("pnl")
    win, lose = F.when(p > 0, p), F.when(p <= 0, p)
    zero = F.lit(0.0)
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"),
        F.count(win).alias("_wins"),
        F.coalesce(F.sum(win), zero).alias("_profit"),
        F.abs(F.coalesce(F.sum(lose), zero)).alias("_loss"),
        F.coalesce(F.avg(p), zero).alias("avg_trade"),
        F.coalesce(F.avg(win), zero).alias("avg_win"),
        F.coalesce(F.avg(lose), zero).alias("avg_loss"),
    )
    return out.select(
        *keys, "total_trades",
        F.coalesce(over_zero(F.col("_wins").cast("double"), F.col("total_trades").cast("double")), zero)
        .alias("win_rate"),
        F.when(F.col("_loss") > 0, F.col("_profit") / F.nullif("_loss", zero))
        .when(F.col("_profit") > 0, F.lit(float("inf"))).otherwise(zero).alias("profit_factor"),
        "avg_trade", "avg_win", "avg_loss",
    )


def hold_minutes(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    m = (micros("exit_time") - micros("entry_time")) / F.lit(60.0 * MICROS)
    return trades.groupBy(*keys).agg(
        F.max(m).alias("max_hold_min"), F.min(m).alias("min_hold_min"), F.avg(m).alias("avg_hold_min"))
