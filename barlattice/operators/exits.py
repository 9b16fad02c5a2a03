"""Exit analysis: excursions, what-if PnL after fixed times, views of enriched trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.exprs import DAY, add_seconds, micros
from barlattice.operators.indicators import vol_percentile
from barlattice.plans.asof import asof
from barlattice.plans.blocks import Series
from barlattice.plans.ranges import extremes_between
from barlattice.plans.salt import join_small

# Minutes after entry at which a trade is valued.
HORIZONS = [5, 15, 30, 60, 120, 240, 480, 720, 1440]


def _sign() -> Column:
    return F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)


def _size() -> Column:
    return F.abs("quantity") * F.col("multiplier")


def _usable() -> Column:
    return (F.col("entry_time").isNotNull() & F.col("exit_time").isNotNull()
            & F.col("entry_price").isNotNull())


def with_source(trades: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``source``: the trade's own (slot, symbol) bars where there are some, else the symbol's.

    ``bars`` may carry a nullable ``slot_id``.
    """
    if "slot_id" not in bars.columns:
        key = F.concat(F.lit("*|"), F.col("symbol"))
        return trades.withColumn("source", key), bars.withColumn("source", key)
    slot = F.coalesce(F.col("slot_id").cast("string"), F.lit("*"))
    b = bars.withColumn("source", F.concat_ws("|", slot, "symbol")).drop("slot_id")
    have = b.select(F.col("source").alias("_own")).distinct()
    t = trades.withColumn("_own", F.concat_ws("|", F.col("slot_id").cast("string"), "symbol"))
    t = t.join(have.withColumn("_hit", F.lit(True)), "_own", "left")
    return t.withColumn("source", F.when(F.col("_hit"), F.col("_own")).otherwise(
        F.concat(F.lit("*|"), F.col("symbol")))).drop("_own", "_hit"), b


def excursions(trades: DataFrame, bars: DataFrame, on: Sequence[str] = ("symbol",)) -> DataFrame:
    """(trade_id, mfe, mae): best and worst open PnL over bars after entry up to exit."""
    t = trades.where(_usable())
    x = extremes_between(t, bars, on, "trade_id", "entry_time", "exit_time")
    j = t.select("trade_id", "direction", "entry_price", "quantity", "multiplier").join(x, "trade_id")
    up, down = F.col("max_high") - F.col("entry_price"), F.col("min_low") - F.col("entry_price")
    long = F.col("direction") == "LONG"
    best = F.when(long, up).otherwise(-down) * _size()
    worst = F.when(long, down).otherwise(-up) * _size()
    zero = F.lit(0.0)
    return j.select("trade_id", F.greatest(best, zero).alias("mfe"), F.least(worst, zero).alias("mae"))


def forward_pnl(
    trades: DataFrame, bars: DataFrame, horizons: Sequence[int] = HORIZONS,
    on: Sequence[str] = ("symbol",), period_seconds: int = DAY,
) -> DataFrame:
    """One column per horizon: net PnL at the last close at or before entry plus the horizon."""
    costs = F.coalesce("commission", F.lit(0.0)) + F.coalesce("slippage", F.lit(0.0))
    probes = trades.where(_usable()).select(
        "trade_id", *on, "direction", "entry_price", "quantity", "multiplier", "entry_time",
        costs.alias("_cost"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("_h"),
    ).withColumn("_at", add_seconds("entry_time", F.col("_h") * 60))
    p = asof(probes, bars, on, "_at", "ts", {"close": "_px"}, period_seconds=period_seconds)
    value = _sign() * (F.col("_px") - F.col("entry_price")) * _size() - F.col("_cost")
    return p.groupBy("trade_id").agg(*[
        F.max(F.when(F.col("_h") == h, value)).alias(f"pnl_decay_{h}m") for h in horizons])


def entry_volatility(
    trades: DataFrame, bars: DataFrame, regime: int = 50, history: int = 500,
    on: Sequence[str] = ("symbol",), block_rows: int | None = None,
) -> DataFrame:
    """(trade_id, entry_volatility): volatility percentile of the entry bar itself (not shifted)."""
    s = Series(bars, list(on), block_rows=block_rows)
    pct = vol_percentile(s, regime, history)
    ranked = s.frame().select(*on, "ts", F.col(pct).alias("_pct"))
    t = trades.where(_usable()).select("trade_id", *on, "entry_time")
    return asof(t, ranked, on, "entry_time", "ts", {"_pct": "entry_volatility"}).select(
        "trade_id", "entry_volatility")


def enrich(
    trades: DataFrame, bars: DataFrame, regime: int = 50, history: int = 500,
    min_pct: float = 0.20, max_pct: float = 0.80, horizons: Sequence[int] = HORIZONS,
    block_rows: int | None = None,
) -> DataFrame:
    """Trades with hold time, excursions, what-if PnL and entry volatility; null where not defined."""
    t, b = with_source(trades, bars)
    on = ["source"]
    hold = F.when(_usable(), (micros("exit_time") - micros("entry_time")) / F.lit(6e7))
    return (
        t.withColumns({"hold_minutes": hold, "vol_min_pct": F.lit(min_pct), "vol_max_pct": F.lit(max_pct)})
        .join(excursions(t, b, on), "trade_id", "left")
        .join(forward_pnl(t, b, horizons, on), "trade_id", "left")
        .join(entry_volatility(t, b, regime, history, on, block_rows), "trade_id", "left")
        .drop("source")
    )


def scatter(trades: DataFrame) -> DataFrame:
    """Complete (mae, mfe, pnl) points split into winners and losers."""
    return trades.dropna(subset=["mfe", "mae", "pnl"]).select(
        "trade_id", F.when(F.col("pnl") >= 0, "Winners").otherwise("Losers").alias("series"),
        "mae", "mfe", "pnl")


def scatter_diagonal(points: DataFrame) -> DataFrame:
    return points.agg(F.min("mae").alias("x2"), F.abs(F.min("mae")).alias("y2"))


def _hold() -> Column:
    return (micros("exit_time") - micros("entry_time")) / F.lit(6e7)


def decay_curve(
    trades: DataFrame, keys: Sequence[str] = ("run_id",), horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Average what-if PnL per horizon from 0 at entry, up to the first horizon >= the longest hold."""
    keys = list(keys)
    hs = F.array(*[F.lit(h) for h in horizons])
    top = F.max(_hold())
    agg = trades.groupBy(*keys).agg(
        F.when(top > 0, top).alias("_top"),
        F.array(F.struct(F.lit(0).alias("horizon_min"), F.lit(0.0).alias("avg_pnl")), *[
            F.struct(F.lit(h).alias("horizon_min"), F.avg(f"pnl_decay_{h}m").alias("avg_pnl"))
            for h in horizons]).alias("_c"))
    stop = F.array_min(F.filter(hs, lambda h: h >= F.col("_top")))
    return agg.withColumn("_stop", F.coalesce(stop, F.lit(max(horizons)))).select(
        *keys, "_stop", F.explode("_c").alias("_p")).select(*keys, "_stop", "_p.*").where(
        F.col("horizon_min") <= F.col("_stop")).drop("_stop")


def decay_marks(
    trades: DataFrame, keys: Sequence[str] = ("run_id",), horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Actual average PnL, and the shown horizon nearest to the mean hold of time-stopped trades."""
    keys = list(keys)
    timed = F.col("exit_reason").contains("TIME_STOP") & (_hold() >= 0)
    top = F.max(_hold())
    a = trades.groupBy(*keys).agg(
        F.avg("pnl").alias("actual_avg"), F.avg(F.when(timed, _hold())).alias("time_stop_hold"),
        F.when(top > 0, top).alias("_top"), F.countDistinct(F.when(timed, _hold())).alias("distinct_holds"))
    hs = F.array(*[F.lit(h) for h in horizons])
    stop = F.coalesce(F.array_min(F.filter(hs, lambda h: h >= F.col("_top"))), F.lit(max(horizons)))
    shown = F.filter(hs, lambda h: h <= F.col("_stop"))
    near = F.array_min(F.transform(shown, lambda h: F.struct(
        F.abs(h - F.col("time_stop_hold")).alias("d"), h.alias("h"))))
    return a.withColumn("_stop", stop).select(
        *keys, "actual_avg", "time_stop_hold", "distinct_holds",
        F.when(F.col("time_stop_hold").isNotNull(), near["h"]).alias("marker_horizon"))


def hold_buckets(trades: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Average PnL in five hold-time buckets whose width follows the longest hold; empty is 0."""
    keys = list(keys)
    top = F.coalesce(F.when(F.max(_hold()) > 0, F.max(_hold())), F.lit(60.0))
    width = trades.groupBy(*keys).agg(top.alias("_top")).withColumn(
        "step_min", F.when(F.col("_top") <= 60, 15).when(F.col("_top") <= 240, 60)
        .when(F.col("_top") <= 1440, 360).otherwise(1440))
    b = F.least(F.floor(_hold() / F.col("step_min")), F.lit(4)).cast("int")
    got = join_small(trades, width, keys, ["entry_time", "exit_time"]).where(_hold() >= 0).groupBy(*keys, b.alias("bucket")).agg(
        F.avg("pnl").alias("a"), F.count("pnl").alias("n"))
    grid = width.select(*keys, "step_min", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("bucket"))
    return grid.join(got, [*keys, "bucket"], "left").select(
        *keys, "step_min", "bucket", F.coalesce("a", F.lit(0.0)).alias("avg_pnl"),
        F.coalesce("n", F.lit(0)).alias("trades"))


def volatility_buckets(
    trades: DataFrame, low: float = 0.20, high: float = 0.80, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Average PnL of trades entered in compressed, normal and panic volatility; empty is 0."""
    keys = list(keys)
    lo = max(0.00001, min(low, 0.99998))
    hi = max(lo + 0.00001, min(high, 0.99999))
    v = F.col("entry_volatility")
    b = F.when(v <= lo, "Compression").when(v <= hi, "Normal").when(v <= 1.0, "Panic")
    got = trades.where((v >= 0) & (v <= 1)).groupBy(*keys, b.alias("bucket")).agg(F.avg("pnl").alias("a"))
    grid = trades.select(*keys).distinct().withColumn(
        "bucket", F.explode(F.array(F.lit("Compression"), F.lit("Normal"), F.lit("Panic"))))
    return grid.join(got, [*keys, "bucket"], "left").select(
        *keys, "bucket", F.coalesce("a", F.lit(0.0)).alias("avg_pnl"))


def pnl_by_reason(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(F.sum("pnl").alias("total_pnl")).orderBy(
        F.desc("total_pnl"), "exit_reason")


def reason_breakdown(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, win rate (pnl >= 0 wins here), average and total per exit reason."""
    return trades.groupBy(*keys, "exit_reason").agg(
        F.count("pnl").alias("trades"),
        F.avg(F.when(F.col("pnl") >= 0, 1.0).when(F.col("pnl") < 0, 0.0)).alias("win_rate"),
        F.avg("pnl").alias("avg_pnl"), F.sum("pnl").alias("total_pnl"),
    ).orderBy(F.desc("total_pnl"), "exit_reason")


LOG_COLUMNS = ["strategy", "symbol", "direction", "entry_time", "exit_time", "pnl", "mfe", "mae",
               "pnl_decay_60m", "exit_reason"]


def trade_log(trades: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page of the log in entry order, with the number of rows in ``total_rows``.

    The page is clamped to the range. Nothing runs while the page is built: trades are counted per
    day of entry, the days that the page touches follow from running counts (one row per day), and
    only trades of those days are ranked.
    """
    day = F.to_date("entry_time")
    days = trades.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy(F.col("_day").asc_nulls_first())
    days = days.withColumns({"_upto": F.sum("_n").over(upto), "total_rows": F.sum("_n").over(Window.partitionBy())})
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_rows") / page_size))
    days = days.withColumn("_from", (F.greatest(F.lit(1), F.least(F.lit(page), pages)) - 1) * page_size)
    days = days.withColumn("_before", F.col("_upto") - F.col("_n")).where(
        (F.col("_upto") > F.col("_from")) & (F.col("_before") < F.col("_from") + page_size))
    cols = [c for c in LOG_COLUMNS if c in trades.columns]
    days = days.withColumnRenamed("_day", "_on")
    found = trades.withColumn("_day", day).join(days, F.col("_day").eqNullSafe(F.col("_on")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_day").orderBy("entry_time", "trade_id"))
    return found.withColumn("_place", place).where(
        (F.col("_place") > F.col("_from")) & (F.col("_place") <= F.col("_from") + page_size)
    ).select("trade_id", *cols, "total_rows").orderBy("entry_time", "trade_id")
