"""Masks, gates, calendar marks and admission checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.plans.blocks import Series

KEYS = ["symbol", "timeframe"]


def hour_mask(ts: Column, start_h: int, end_h: int, enabled: bool = True) -> Column:
    """Hour in [start, end); wraps midnight when start > end."""
    if not enabled:
        return F.lit(True)
    h = F.hour(ts)
    if start_h <= end_h:
        return (h >= start_h) & (h < end_h)
    return (h >= start_h) | (h < end_h)


def parse_hhmm(text: str | None, field: str = "time") -> dt.time | None:
    """HH:MM to a time of day; empty means no bound, anything else raises."""
    if text is None or not str(text).strip():
        return None
    try:
        return dt.datetime.strptime(str(text).strip(), "%H:%M").time()
    except ValueError as exc:
        raise ValueError(f"{field} must be HH:MM, got {text!r}") from exc


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def session_mask(
    ts: Column, start: str | None, end: str | None, enabled: bool = True
) -> Column:
    """Inclusive session bounds, open-ended or overnight."""
    a, z = parse_hhmm(start, "start"), parse_hhmm(end, "end")
    if not enabled or (a is None and z is None):
        return F.lit(True)
    # Whole seconds decide, except that the end bound itself admits no fraction beyond it.
    now = second_of_day(ts) + (F.unix_micros(ts.cast("timestamp")) % 1_000_000) / F.lit(1e6)
    lo = None if a is None else now >= a.hour * 3600 + a.minute * 60
    hi = None if z is None else now <= z.hour * 3600 + z.minute * 60
    if lo is None:
        return hi
    if hi is None:
        return lo
    return lo & hi if a <= z else lo | hi


def gate_direction(direction: str | None, long_ok: Column, short_ok: Column) -> tuple[Column, Column]:
    d = (direction or "both").strip().lower()
    return (
        F.lit(False) if d == "short" else long_ok,
        F.lit(False) if d == "long" else short_ok,
    )


def last_of_day(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Flag bars followed by another date or by nothing."""
    s = Series(bars, block_rows=block_rows)
    s.lead("ts")
    end = F.coalesce(F.to_date("_ts_lead1") != F.to_date("ts"), F.lit(True))
    return s.frame().withColumn("is_eod", end).drop("_ts_lead1", "_rn")


def first_at_or_after(bars: DataFrame, close_time: str) -> DataFrame:
    """Flag the first bar of each day at or after ``close_time`` (a window of one series-day)."""
    t = parse_hhmm(close_time, "close_time")
    ok = second_of_day(F.col("ts")) >= t.hour * 3600 + t.minute * 60
    w = Window.partitionBy(*KEYS, F.to_date("ts"))
    first = F.min(F.when(ok, F.col("ts"))).over(w)
    return bars.withColumn("is_close_bar", F.coalesce(F.col("ts") == first, F.lit(False)))


def rebalance_marks(bars: DataFrame, frequency: str, block_rows: int | None = None) -> DataFrame:
    """Flag bars that rebalance: every bar, first of a day, or first of an ISO week."""
    if frequency == "intrabar":
        return bars.withColumn("rebalance", F.lit(True))
    if frequency not in ("daily", "weekly"):
        raise ValueError(f"unknown rebalance frequency: {frequency}")

    def key(c: str) -> Column:
        if frequency == "daily":
            return F.to_date(c)
        return F.date_trunc("week", c)

    s = Series(bars, block_rows=block_rows)
    s.lag("ts")
    mark = F.coalesce(key("_ts_lag1") != key("ts"), F.lit(True))
    return s.frame().withColumn("rebalance", mark).drop("_ts_lag1", "_rn")


def trades_of_strategy(trades: DataFrame, strategy: str, n_strategies: int) -> DataFrame:
    """Rows of one strategy; all rows when there is only one logical strategy."""
    if n_strategies == 1 or strategy in ("", "__all__"):
        return trades
    if "strategy" not in trades.columns:
        return trades.where(F.lit(False))
    return trades.where(F.col("strategy") == strategy)


def slot_of_scope(scope: Column) -> Column:
    """Scope label with '+' and repeated blanks reduced to single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(scope, r"\+", " "), r"\s+", " "))


def resolve_scope(slots: DataFrame, scope: str) -> DataFrame:
    """Slots whose strategy label equals the scope text."""
    wanted = slot_of_scope(F.lit(scope))
    return slots.where(
        (slot_of_scope(F.col("strategy")) == wanted) | (F.col("slot_id").cast("string") == wanted)
    )


def replay_windows(bars: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Bars inside each scenario's inclusive [start, end]; scenarios with start > end raise."""
    ok = F.when(
        F.col("start_ts") > F.col("end_ts"), F.raise_error(F.lit("start after end")).cast("timestamp_ntz")
    ).otherwise(F.col("start_ts"))
    sc = scenarios.withColumn("start_ts", ok).withColumn(
        "_d", F.explode(F.sequence(F.to_date("start_ts"), F.to_date("end_ts")))
    )
    return (
        bars.withColumn("_d", F.to_date("ts"))
        .join(sc, "_d")
        .where(F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
        .drop("_d")
    )


# Words that mark money management, and the largest number of searched parameters.
MONEY_WORDS = ["risk", "lot", "size", "leverage", "capital", "money"]
MAX_PARAMS = 6


def admit_params(sets: DataFrame, max_params: int = MAX_PARAMS) -> DataFrame:
    """Reason why a parameter map may not be searched, null when it may."""
    word = "|".join(MONEY_WORDS)
    bad = F.filter(F.map_keys("params"), lambda k: F.lower(k).rlike(word))
    return sets.withColumn(
        "rejection",
        F.when(
            F.size(F.map_keys("params")) > max_params,
            F.format_string(f"%d parameters, at most {max_params}", F.size(F.map_keys("params"))),
        ).when(F.size(bad) > 0, F.concat(F.lit("money management parameter: "), F.get(bad, F.lit(0)))),
    )


def slot_violations(slots: DataFrame) -> DataFrame:
    """Violated rules of a portfolio's slots: one row, a count per rule."""

    def n(cond: Column) -> Column:
        return F.coalesce(F.count_if(cond), F.lit(0))

    return slots.agg(
        (F.abs(F.coalesce(F.sum("weight"), F.lit(0.0)) - 1.0) > 1e-2).alias("weights_off"),
        n(F.size("symbols") <= 0).alias("no_symbols"),
        n(F.col("weight") <= 0).alias("weight_not_positive"),
        n(~((F.col("expected_duty_cycle") > 0) & (F.col("expected_duty_cycle") <= 1))).alias(
            "duty_cycle_off"
        ),
    )


def check_portfolio(target_vol: float, lookback: int, expansion: float, cap: int | None) -> None:
    """Scalar limits of a portfolio configuration; raises on the first one broken."""
    if not 0.0 < target_vol <= 1.0:
        raise ValueError(f"target volatility must be in (0, 1], got {target_vol}")
    if lookback < 2:
        raise ValueError("volatility lookback must be at least 2")
    if expansion < 1.0:
        raise ValueError(f"weight expansion must be at least 1, got {expansion}")
    if cap is not None and cap < 1:
        raise ValueError("contract cap must be at least 1")
