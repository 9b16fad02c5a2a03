"""Building and resampling bars: Heikin-Ashi, volume, range, back-adjusted, slower clocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.exprs import MICROS, from_micros, half_even, micros, seconds_between
from barlattice.plans.asof import asof
from barlattice.plans.blocks import Series, running
from barlattice.plans.prefix import prefix_scan
from barlattice.plans.salt import join_small

KEYS = ["symbol", "timeframe"]
PRICES = ["open", "high", "low", "close"]


def build(bars: DataFrame, bar_type: str, size: float = 0.0, tick_size: float = 1.0) -> DataFrame:
    """Bars of the wanted type; time bars, unknown types and sizes <= 0 leave the input as it is."""
    kind = bar_type.lower()
    if kind == "heikin_ashi":
        return heikin_ashi(bars)
    if kind == "volume" and size > 0:
        return volume_bars(bars, size)
    if kind == "range" and size > 0:
        return range_bars(bars, size, tick_size)
    return bars


def heikin_ashi(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    s = Series(bars, block_rows=block_rows)
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    s.add("_ha_close", mean, PRICES)
    s.lag("_ha_close")
    s.add("_ha_in", F.coalesce(F.col("__ha_close_lag1"), F.col("open")), ["__ha_close_lag1", "open"])
    s.recurrence("_ha_open", "_ha_in", keep=0.5)
    rest = [c for c in bars.columns if c not in (*KEYS, "ts", *PRICES)]
    return s.select(
        F.col("_ha_open").alias("open"),
        F.greatest("high", "_ha_open", "_ha_close").alias("high"),
        F.least("low", "_ha_open", "_ha_close").alias("low"),
        F.col("_ha_close").alias("close"),
        *rest,
    )


def _ohlcv(order: str) -> list[Column]:
    return [
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def volume_bars(bars: DataFrame, threshold: float) -> DataFrame:
    """One bar per ``threshold`` of cumulative volume; the bar crossing it opens the next bucket."""
    cum = running(bars, KEYS, "ts", sums={"_cum": "volume"})
    return (
        cum.groupBy(*KEYS, F.floor(F.col("_cum") / threshold).alias("_bucket"))
        .agg(F.max("ts").alias("last_ts"), *_ohlcv("ts"))
        .withColumnRenamed("last_ts", "ts")
        .drop("_bucket")
    )


def range_bars(
    bars: DataFrame, ticks: float, tick_size: float = 1.0, block_rows: int | None = None
) -> DataFrame:
    """Bars closed when high - low reaches ``ticks * tick_size``; restart from the closing price.

    A bar left open at the end is kept when it has volume and the series closed at least one bar.
    """
    size = ticks * tick_size

    def closes(h, lo, c, begin: int, top: float, low: float):
        """First row from ``begin`` on at which the bar closes (None if none), and its extremes there."""
        width = 64
        while True:
            end = min(begin + width, len(c))
            hh = np.maximum(top, np.maximum.accumulate(h[begin:end]))
            ll = np.minimum(low, np.minimum.accumulate(lo[begin:end]))
            hit = np.flatnonzero(hh - ll >= size)
            if len(hit):
                return begin + int(hit[0]), hh[hit[0]], ll[hit[0]]
            if end == len(c):
                return None, hh[-1] if len(hh) else top, ll[-1] if len(ll) else low
            width *= 4

    def summarise(rows: pd.DataFrame) -> dict:
        """What the block does to the bar it is entered with.

        That bar can only close where the block makes a new high or low, and does so before the block
        alone spans the size. For each of these rows: the extremes up to it, and the bar that is open
        at the end of the block if the first close is there. Bars that meet at a close stay together,
        so each close is followed up once.
        """
        h, lo = rows["high"].to_numpy(), rows["low"].to_numpy()
        c, v = rows["close"].to_numpy(), rows["volume"].to_numpy()
        top, low = np.maximum.accumulate(h), np.minimum.accumulate(lo)
        new = np.append(True, (np.diff(top) > 0) | (np.diff(low) < 0))
        wide = np.flatnonzero(top - low >= size)
        at = np.flatnonzero(new[:int(wide[0]) + 1] if len(wide) else new)
        ends: dict[int, tuple] = {}
        for first in at.tolist():
            path, i = [], first
            while i not in ends:
                path.append(i)
                nxt, hh, ll = closes(h, lo, c, i + 1, c[i], c[i])
                if nxt is None:
                    ends[i] = (c[i], hh, ll, float(v[i + 1:].sum()))
                    break
                i = nxt
            for p in path:
                ends[p] = ends[i]
        left = np.array([ends[i] for i in at.tolist()])
        return {"first": rows["open"].iloc[0], "top": top[-1], "low": low[-1], "volume": float(v.sum()),
                "tops": top[at], "lows": low[at], **{f"end_{n}": left[:, j] for j, n in enumerate("ohlv")}}

    def begin(first: pd.Series) -> dict:
        return {"o": first["first"], "h": first["first"], "l": first["first"], "v": 0.0, "any": False}

    def advance(held: dict, block: pd.Series) -> dict:
        hit = np.flatnonzero(np.maximum(held["h"], block["tops"]) - np.minimum(held["l"], block["lows"]) >= size)
        if len(hit):
            return {n: block[f"end_{n}"][hit[0]] for n in "ohlv"} | {"any": True}
        return {**held, "h": max(held["h"], block["top"]), "l": min(held["l"], block["low"]), "v": held["v"] + block["volume"]}

    def run(rows: pd.DataFrame, state: dict, last: bool) -> pd.DataFrame:
        h, lo = rows["high"].to_numpy(), rows["low"].to_numpy()
        c, v, ts = rows["close"].to_numpy(), rows["volume"].to_numpy(), rows["ts"].to_numpy()
        first, top, low, vol, any_bar = (state[k] for k in ("o", "h", "l", "v", "any"))
        start, out = 0, []
        while start < len(c):
            at, hh, ll = closes(h, lo, c, start, top, low)
            if at is None:
                top, low, vol = hh, ll, vol + float(v[start:].sum())
                break
            out.append((ts[at], first, hh, ll, c[at], vol + float(v[start:at + 1].sum())))
            first = top = low = c[at]
            vol, any_bar, start = 0.0, True, at + 1
        if last and vol > 0 and any_bar and not (out and out[-1][0] == ts[-1]):
            out.append((ts[-1], first, top, low, c[-1], vol))
        made = pd.DataFrame(out, columns=["ts", "open", "high", "low", "close", "volume"])
        for k in reversed(KEYS):
            made.insert(0, k, rows[k].iloc[0])
        return made

    cols = [*KEYS, "ts", "open", "high", "low", "close", "volume"]
    arrays = ", ".join(f"{n} array<double>" for n in ("tops", "lows", "end_o", "end_h", "end_l", "end_v"))
    return prefix_scan(
        bars.select(*cols), KEYS, "ts", summarise, f"first double, top double, low double, volume double, {arrays}",
        begin, advance, "o double, h double, l double, v double, any boolean", run,
        "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, "
        "close double, volume double",
        block_rows,
    )


def expiry_date(code: Column) -> Column:
    """yyyyMMdd or yyyyMM (read as day 15) to a date."""
    return F.to_date(F.when(F.length(code) == 6, F.concat(code, F.lit("15"))).otherwise(code), "yyyyMMdd")


def front_contract(targets: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contract whose expiry is the first after each (symbol, day); the last contract after that."""
    c = contracts.withColumn("expiry_ts", F.col("expiry").cast("timestamp_ntz"))
    t = targets.withColumn("_at", F.col("day").cast("timestamp_ntz"))
    found = asof(
        t, c, ["symbol"], "_at", "expiry_ts", {"contract": "_front"},
        forward=True, strict=True, period_seconds=86400 * 32,
    )
    last = contracts.groupBy("symbol").agg(F.max_by("contract", "expiry").alias("_last"))
    return (
        found.join(last, "symbol", "left")
        .withColumn("front_contract", F.coalesce("_front", "_last"))
        .drop("_at", "_front", "_last")
    )


# Month letters of the quarterly cycle.
QUARTER_LETTERS = ["H", "M", "U", "Z"]


def quarterly_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts of the quarterly cycle; all contracts of a symbol that has none."""
    flagged = contracts.withColumn("_q", F.substring("local_symbol", 3, 1).isin(QUARTER_LETTERS))
    some = flagged.groupBy("symbol").agg(F.max("_q").alias("_any"))
    return (
        flagged.join(some, "symbol")
        .where(F.col("_q") | ~F.col("_any"))
        .drop("_q", "_any")
        .orderBy("symbol", "expiry")
    )


def back_adjust(bars: DataFrame) -> DataFrame:
    """Shift older contracts by the sum of later roll gaps (next first open - own last close)."""
    legs = bars.groupBy(*KEYS, "contract").agg(
        F.min("ts").alias("_from"),
        F.min_by("open", "ts").alias("_first"),
        F.max_by("close", "ts").alias("_final"),
    )
    w = Window.partitionBy(*KEYS).orderBy("_from")
    gap = F.coalesce(F.lead("_first").over(w) - F.col("_final"), F.lit(0.0))
    shift = legs.withColumn("_gap", gap).withColumn(
        "_shift", F.sum("_gap").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    out = join_small(bars, shift.select(*KEYS, "contract", "_shift"), [*KEYS, "contract"])
    moved = [c for c in (*PRICES, "average") if c in bars.columns]
    return out.withColumns({c: F.col(c) + F.col("_shift") for c in moved}).drop("_shift")


def slow_last(rows: DataFrame, value: str, seconds: int, keys: list[str] = KEYS) -> DataFrame:
    """Last value per slower period, labelled and closed on the right."""
    step = seconds * MICROS
    label = from_micros(F.ceil(micros("ts") / F.lit(float(step))) * F.lit(step))
    return rows.groupBy(*keys, label.alias("slow_ts")).agg(F.max_by(value, "ts").alias(value))


def daily_close(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return (
        bars.where(F.col("close").isNotNull())
        .groupBy(*keys, F.to_date("ts").alias("day"))
        .agg(F.max_by("close", "ts").alias("close"))
    )


def fill_forward(bars: DataFrame, slow: DataFrame, value: str, name: str) -> DataFrame:
    """Latest slow value at or before each bar."""
    return asof(bars, slow, KEYS, "ts", "slow_ts", {value: name})


def bars_per_year(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Whole number of bars per year from count and span, at least 1."""
    years = F.col("_sec") / 86400.0 / 365.25
    return (
        bars.groupBy(*keys)
        .agg(F.count("*").alias("bars"), F.min("ts").alias("_a"), F.max("ts").alias("_z"))
        .withColumn("_sec", seconds_between("_a", "_z"))
        .select(
            *keys,
            "bars",
            F.when(F.col("_sec") > 0, F.greatest(F.lit(1.0), half_even(F.col("bars") / years)))
            .cast("long").alias("bars_per_year"),
        )
    )
