"""Checks of bar series: gaps, OHLC geometry, volume outliers, price continuity, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.exprs import falsy, seconds_between
from barlattice.plans.blocks import Series
from barlattice.plans.salt import join_small

KEYS = ["symbol", "timeframe"]

# Largest tolerated step in minutes and largest roll jump per timeframe.
GAP_MINUTES = {"1m": 30, "5m": 30, "30m": 180, "1h": 180}
ROLL_JUMP = {"1m": 0.05, "5m": 0.05, "30m": 0.08, "1h": 0.08}
DEFAULT_GAP_MINUTES, DEFAULT_ROLL_JUMP = 30, 0.08
VALID_SCORE = 0.95


def _by_timeframe(table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for tf, v in table.items():
        out = F.when(F.col("timeframe") == tf, F.lit(v)).otherwise(out)
    return out


def with_previous(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    s = Series(bars, block_rows=block_rows)
    for c in ("ts", "close", *(["contract"] if "contract" in bars.columns else [])):
        s.lag(c)
    return s.frame()


def is_gap() -> Column:
    """Step above the threshold inside one calendar date."""
    limit = _by_timeframe(GAP_MINUTES, DEFAULT_GAP_MINUTES) * 60
    step = seconds_between("_ts_lag1", "ts")
    return falsy((step > limit) & (F.to_date("_ts_lag1") == F.to_date("ts")))


def gaps(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row per suspicious step."""
    return (
        with_previous(bars, block_rows)
        .where(is_gap())
        .select(*KEYS, F.col("_ts_lag1").alias("gap_start"), F.col("ts").alias("gap_end"))
    )


def first_gaps(bars: DataFrame, k: int = 3) -> DataFrame:
    """Gap count per series next to its first k gaps (row_number keeps k rows per map task)."""
    g = gaps(bars)
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("gap_start"))
    first = g.withColumn("gap_no", rank).where(F.col("gap_no") <= k)
    return first.join(g.groupBy(*KEYS).agg(F.count("*").alias("gap_count")), KEYS)


def geometry(bars: DataFrame) -> DataFrame:
    """High/low rule violations per series; one bar can break several rules."""

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    return bars.groupBy(*KEYS).agg(
        n(F.col("high") < F.col("low")).alias("high_below_low"),
        n((F.col("high") < F.col("open")) | (F.col("high") < F.col("close"))).alias("high_low_body"),
        n((F.col("low") > F.col("open")) | (F.col("low") > F.col("close"))).alias("low_high_body"),
    )


def volume_outliers(bars: DataFrame, z: float = 5.0) -> DataFrame:
    """Bars whose volume is more than z sample deviations from the series mean."""
    stats = bars.groupBy(*KEYS).agg(F.avg("volume").alias("_m"), F.stddev_samp("volume").alias("_s"))
    return (
        join_small(bars, stats, KEYS)
        .where((F.col("_s") > 0) & (F.abs((F.col("volume") - F.col("_m")) / F.col("_s")) > z))
        .drop("_m", "_s")
    )


def is_average_outside() -> Column:
    return falsy((F.col("average") < F.col("low")) | (F.col("average") > F.col("high")))


def roll_change() -> Column:
    return F.abs(F.col("close") / F.col("_close_lag1") - 1)


def is_roll_jump() -> Column:
    """Contract label changes and the close moves by more than the timeframe allows."""
    return falsy(
        ~F.col("contract").eqNullSafe(F.col("_contract_lag1"))
        & (roll_change() > _by_timeframe(ROLL_JUMP, DEFAULT_ROLL_JUMP))
    )


def roll_jumps(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    return (
        with_previous(bars, block_rows)
        .where(is_roll_jump())
        .select(*KEYS, "ts", roll_change().alias("change"))
    )


def validate(bars: DataFrame, z: float = 5.0, block_rows: int | None = None) -> DataFrame:
    """All counts, the quality score and the validity flag, one row per series."""
    stats = bars.groupBy(*KEYS).agg(F.avg("volume").alias("_m"), F.stddev_samp("volume").alias("_s"))
    f = join_small(with_previous(bars, block_rows), stats, KEYS)

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    outlier = falsy((F.col("_s") > 0) & (F.abs((F.col("volume") - F.col("_m")) / F.col("_s")) > z))
    counts = f.groupBy(*KEYS).agg(
        F.count("*").alias("total_bars"),
        n(is_gap()).alias("gaps"),
        n(F.col("high") < F.col("low")).alias("high_below_low"),
        n((F.col("high") < F.col("open")) | (F.col("high") < F.col("close"))).alias("high_low_body"),
        n((F.col("low") > F.col("open")) | (F.col("low") > F.col("close"))).alias("low_high_body"),
        n(outlier).alias("volume_outliers"),
        (n(is_average_outside()) if "average" in bars.columns else F.lit(0)).alias("average_outside"),
        (n(is_roll_jump()) if "contract" in bars.columns else F.lit(0)).alias("roll_jumps"),
    )
    return score(counts)


def score(counts: DataFrame) -> DataFrame:
    ohlc = F.col("high_below_low") + F.col("high_low_body") + F.col("low_high_body")
    price = F.col("average_outside") + F.col("roll_jumps")
    penalty = (F.col("gaps") + ohlc * 10 + F.col("volume_outliers") + price * 25) / F.greatest(
        F.col("total_bars"), F.lit(1)
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty))
    q = F.when(F.col("total_bars") == 0, 0.0).otherwise(clipped)
    return counts.withColumn("quality_score", q).withColumn(
        "is_valid", (F.col("quality_score") >= VALID_SCORE) & (price == 0)
    )


def validate_lake(
    bars: DataFrame, symbol: str | None = None, timeframes: list[str] | None = None
) -> DataFrame:
    """``validate`` over a whole lake, filtered and ordered by series."""
    for tf in timeframes or []:
        if tf not in GAP_MINUTES:
            raise ValueError(f"unsupported timeframe: {tf}")
    if symbol:
        bars = bars.where(F.col("symbol") == symbol.upper())
    if timeframes:
        bars = bars.where(F.col("timeframe").isin(list(timeframes)))
    return validate(bars).orderBy(*KEYS)


def report(results: DataFrame, limit: int = 5) -> DataFrame:
    """Status and the first issues per series."""

    def issue(text: str, c: str) -> Column:
        return F.when(F.col(c) > 0, F.format_string(f"{text}: %d", F.col(c)))

    issues = F.array_compact(
        F.array(
            issue("steps above the gap limit", "gaps"),
            issue("high below low", "high_below_low"),
            issue("high below open or close", "high_low_body"),
            issue("low above open or close", "low_high_body"),
            issue("volume outliers", "volume_outliers"),
            issue("average outside range", "average_outside"),
            issue("suspicious rolls", "roll_jumps"),
        )
    )
    return results.select(
        *KEYS,
        F.when(F.col("is_valid"), "PASS").otherwise("FAIL").alias("status"),
        "quality_score",
        F.slice(issues, 1, limit).alias("issues"),
    )


def report_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.coalesce(F.count_if("is_valid"), F.lit(0)).alias("passed"), F.count("*").alias("total")
    )
