"""PnL series: increments, calendar resampling, distribution, equity curves, histogram, thinning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.exprs import DAY, finite, loss, over_zero
from barlattice.plans.blocks import Series, running
from barlattice.plans.salt import join_small

SLOT = ["run_id", "slot_id"]
YEAR = DAY * 366  # period for daily tables: at most 366 rows per stream and period
HORIZONS = ("1d", "1w", "1m")


def bar_pnl(slot_history: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Increment of the cumulative PnL per slot and time; 0 on the first row and after a null."""
    s = Series(slot_history, SLOT, block_rows=block_rows)
    prev = s.lag("cum_pnl")
    return s.frame().select(
        *SLOT, "ts", F.coalesce(F.col("cum_pnl") - F.col(prev), F.lit(0.0)).alias("pnl"))


def period_label(ts: str, horizon: str) -> Column:
    """Last day of the period: the day, the week's Sunday, the month's end."""
    if horizon == "1w":
        return F.date_add(F.date_trunc("week", ts).cast("date"), 6)
    if horizon == "1m":
        return F.last_day(ts)
    return F.to_date(ts)


def spine(rows: DataFrame, keys: Sequence[str], label: str, horizon: str) -> DataFrame:
    """All periods of each stream from its first to its last one."""
    ends = rows.groupBy(*keys).agg(F.min(label).alias("_a"), F.max(label).alias("_z"))
    if horizon == "1w":
        seq = F.sequence("_a", "_z", F.expr("interval 7 days"))
    elif horizon == "1m":
        months = F.sequence(F.trunc("_a", "month"), F.trunc("_z", "month"), F.expr("interval 1 month"))
        seq = F.transform(months, lambda m: F.last_day(m))
    else:
        seq = F.sequence("_a", "_z")
    return ends.select(*keys, F.explode(seq).alias(label))


def resample(pnl: DataFrame, horizon: str = "1d", keys: Sequence[str] = SLOT) -> DataFrame:
    """PnL per period; periods without rows count 0. Unknown horizons fall back to days."""
    keys = list(keys)
    h = horizon if horizon in HORIZONS else "1d"
    sums = pnl.groupBy(*keys, period_label("ts", h).alias("period")).agg(F.sum("pnl").alias("pnl"))
    return spine(sums, keys, "period", h).join(sums, [*keys, "period"], "left").withColumn(
        "pnl", F.coalesce("pnl", F.lit(0.0)))


def with_tails(
    daily: DataFrame, keys: Sequence[str], levels: dict[str, float], value: str = "pnl"
) -> DataFrame:
    """Daily rows with the exact interpolated quantile ``_q_x`` of each named confidence level.

    The window covers one stream's days, so it is bounded by the calendar, and a following
    aggregation per stream needs no further shuffle.
    """
    w = Window.partitionBy(*keys)
    return daily.withColumns({
        f"_q_{n}": F.percentile(value, F.lit(round(1.0 - c, 12))).over(w) for n, c in levels.items()})


def tail_columns(levels: dict[str, float], value: str = "pnl") -> list[Column]:
    """Aggregates ``var_x`` and ``es_x`` over :func:`with_tails`: positive losses floored at 0.

    The tail is every value at or below the quantile.
    """
    v = F.col(value)
    return [x for n in levels for x in (
        loss(F.max(f"_q_{n}")).alias(f"var_{n}"),
        loss(F.avg(F.when(v <= F.col(f"_q_{n}"), v))).alias(f"es_{n}"))]


def tail_stats(
    daily: DataFrame, keys: Sequence[str], levels: dict[str, float], value: str = "pnl"
) -> DataFrame:
    return with_tails(daily, keys, levels, value).groupBy(*keys).agg(*tail_columns(levels, value))


def distribution(
    daily: DataFrame, keys: Sequence[str] = ("stream",), var_level: float = 0.95, tail_level: float = 0.99
) -> DataFrame:
    """Skewness, excess kurtosis, VaR, CVaR, mean and deviation of daily PnL, rounded."""
    keys = list(keys)
    levels = {"a": var_level, "b": tail_level}
    clean = daily.withColumn("pnl", finite("pnl")).where(F.col("pnl").isNotNull())
    shape = with_tails(clean, keys, levels).groupBy(*keys).agg(
        F.count("pnl").alias("_n"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("std"),
        F.skewness("pnl").alias("_sk"), F.kurtosis("pnl").alias("_ku"), *tail_columns(levels))
    ok = (F.col("_n") > 2) & (F.col("std") > 0)
    return shape.select(
        *keys, F.round(F.when(ok, F.col("_sk")), 4).alias("skew"),
        F.round(F.when(ok, F.col("_ku")), 4).alias("kurtosis"),
        F.round("var_a", 2).alias("var_95"), F.round("es_a", 2).alias("cvar_95"),
        F.round("var_b", 2).alias("var_99"), F.round("mean", 2).alias("mean"),
        F.round("std", 2).alias("std"))


def slot_equity(
    slot_history: DataFrame, history: DataFrame, weights: DataFrame | None = None,
    slot_count: int | None = None,
) -> DataFrame:
    """Standalone equity per slot: its share of the run's first total value plus its PnL.

    ``weights`` (slot_id, weight) give the share; without one, an equal split; else all of it.
    """
    start = history.where(F.col("total_value").isNotNull()).groupBy("run_id").agg(
        F.min_by("total_value", "ts").alias("_start"))
    rows = join_small(slot_history, start, ["run_id"])
    even = F.lit(1.0 / slot_count) if slot_count else F.lit(1.0)
    if weights is not None:
        rows = rows.join(weights.select("slot_id", F.col("weight").alias("_w")), "slot_id", "left")
        share = F.coalesce("_w", even)
    else:
        share = even
    rows = rows.withColumn("_base", F.col("_start") * share)
    filled = running(rows, SLOT, "ts", lasts={"_pnl": "cum_pnl"})
    return filled.select(*SLOT, "ts", (F.coalesce("_pnl", F.lit(0.0)) + F.col("_base")).alias("equity"))


def daily_equity(equity: DataFrame, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """End-of-day equity of days that have rows."""
    return equity.where(F.col("equity").isNotNull()).groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.max_by("equity", "ts").alias("equity"))


def daily_pnl(equity: DataFrame, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Day-over-day change of end-of-day equity, 0 on the first day (one row per stream and day)."""
    return with_daily_change(daily_equity(equity, keys), keys).select(*keys, "day", "equity", "pnl")


def with_daily_change(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily rows with ``pnl`` and simple return ``ret`` (null on the first day)."""
    w = Window.partitionBy(*keys).orderBy("day")
    prev = F.lag("equity").over(w)
    return daily.withColumns({
        "pnl": F.coalesce(F.col("equity") - prev, F.lit(0.0)),
        "ret": finite(over_zero(F.col("equity"), prev) - 1.0)})


def daily_slot_export(slot_history: DataFrame, legacy_zero_fill: bool = False) -> DataFrame:
    """Daily PnL per slot from end-of-day snapshots on all calendar days; the first keeps its snapshot.

    Days without rows repeat the last snapshot, or count as 0 with ``legacy_zero_fill``.
    """
    snap = slot_history.groupBy(*SLOT, F.to_date("ts").alias("day")).agg(
        F.max_by("cum_pnl", "ts").alias("snapshot"))
    days = spine(snap, SLOT, "day", "1d").join(snap, [*SLOT, "day"], "left")
    w = Window.partitionBy(*SLOT).orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce("snapshot", F.lit(0.0)) if legacy_zero_fill else F.coalesce(
        F.last("snapshot", ignorenulls=True).over(upto), F.lit(0.0))
    days = days.withColumn("snapshot", filled)
    return days.select(
        *SLOT, "day", (F.col("snapshot") - F.coalesce(F.lag("snapshot").over(w), F.lit(0.0))).alias("pnl"))


def benchmark_pnl(history: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark change from the first common time, in money of the run's first total value."""
    start = history.groupBy("run_id").agg(F.min_by("total_value", "ts").alias("_capital"))
    common = history.select("run_id", "ts").join(benchmark.select("ts", "close"), "ts")
    first = common.groupBy("run_id").agg(
        F.min_by("close", "ts").alias("_first"), F.count("*").alias("_n"))
    return join_small(common, first.join(start, "run_id"), ["run_id"]).where(F.col("_n") > 1).select(
        "run_id", "ts", ((over_zero(F.col("close"), F.col("_first")) - 1.0) * F.col("_capital")).alias("pnl"))


def pnl_by_direction(trades: DataFrame, history: DataFrame) -> DataFrame:
    """Cumulative PnL of longs and of shorts at every history time.

    Trades whose exit is not a history time are left out, as in the chart this table feeds.
    """
    by_exit = trades.groupBy("run_id", "direction", F.col("exit_time").alias("ts")).agg(
        F.sum("pnl").alias("_p"))
    present = trades.select("run_id", "direction").distinct()
    axis = join_small(history.select("run_id", "ts"), present, ["run_id"])
    rows = axis.join(by_exit, ["run_id", "direction", "ts"], "left").withColumn(
        "_p", F.coalesce("_p", F.lit(0.0)))
    return running(rows, ["run_id", "direction"], "ts", sums={"cum_pnl": "_p"}).drop("_p")


# Bounds of the histogram's bin count.
BASE_FLOOR, BASE_CAP = 10, 40
DETAIL_FLOOR, DETAIL_CAP, DETAIL_TIMES = 30, 120, 3
SAMPLE_FLOOR, SAMPLE_CAP = 20, 160
FD_FACTOR = 2.0


def bin_count(n: Column, iqr: Column, span: Column) -> Column:
    """Bins by sample size, Sturges and Freedman-Diaconis, capped by the sample."""
    base = F.least(F.lit(BASE_CAP), F.greatest(F.lit(BASE_FLOOR), F.floor(F.sqrt(n))))
    detail = F.least(F.lit(DETAIL_CAP), F.greatest(F.lit(DETAIL_FLOOR), base * DETAIL_TIMES))
    sturges = F.ceil(F.log2(n.cast("double")) + 1)
    width = F.lit(FD_FACTOR) * iqr / F.cbrt(n)
    fd = F.when((iqr > 0) & (span > 0), F.ceil(span / F.when(iqr > 0, width))).otherwise(0)
    cap = F.greatest(F.lit(SAMPLE_FLOOR), F.least(F.lit(SAMPLE_CAP), n))
    return F.least(cap, F.greatest(sturges, fd, detail)).cast("long")


def histogram(daily: DataFrame, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Equal-width counts of daily PnL; every bin is present."""
    keys = list(keys)
    s = daily.groupBy(*keys).agg(
        F.count("pnl").alias("_n"), F.min("pnl").alias("_lo"), F.max("pnl").alias("_hi"),
        (F.percentile("pnl", F.lit(0.75)) - F.percentile("pnl", F.lit(0.25))).alias("_iqr"))
    flat = F.col("_lo") == F.col("_hi")
    s = s.withColumn("_bins", bin_count(F.col("_n"), F.col("_iqr"), F.col("_hi") - F.col("_lo"))).withColumns({
        "_a": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "_w": F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / F.col("_bins")})
    hit = F.least(F.floor((F.col("pnl") - F.col("_a")) / F.col("_w")), F.col("_bins") - 1)
    counts = daily.join(s, keys).groupBy(*keys, hit.alias("bin")).agg(F.count("*").alias("n"))
    bins = s.select(*keys, "_a", "_w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bins") - 1)).alias("bin"))
    return bins.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_a") + (F.col("bin") + 0.5) * F.col("_w")).alias("center"),
        F.coalesce("n", F.lit(0)).alias("value"))


def thin(
    rows: DataFrame, keys: Sequence[str], max_points: int, ts: str = "ts", block_rows: int | None = None
) -> DataFrame:
    """About ``max_points`` evenly spaced rows per stream, the last one included; all if fewer."""
    keys = list(keys)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_total"))
    f = join_small(Series(rows, keys, ts, block_rows=block_rows).frame(), n, keys, [ts])
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / max_points))
    keep = (F.col("_total") <= max_points) | ((F.col("_rn") - 1) % step == 0) | (F.col("_rn") == F.col("_total"))
    return f.where(keep).drop("_rn", "_total")


def capped_log_equity(value: Column, initial: float, floor_pct: float, ruin_ratio: float) -> Column:
    """Log of equity over initial capital, the loss floored and the ratio kept above ``ruin_ratio``."""
    if initial <= 0 or ruin_ratio <= 0:
        raise ValueError("initial capital and ruin ratio must be positive")
    capped = F.greatest(value / F.lit(float(initial)) - 1.0, F.lit(floor_pct / 100.0))
    return F.log(F.greatest(capped + 1.0, F.lit(float(ruin_ratio))))
