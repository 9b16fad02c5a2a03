"""Outcome of stop and target levels set on signals, exits by moving levels, parameter sweeps."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.functions.exprs import falsy, micros
from barlattice.operators.execution import fill_price, resting_fills
from barlattice.operators.indicators import range_levels
from barlattice.operators.metrics import trade_stats
from barlattice.operators.predicates import first_at_or_after
from barlattice.operators.signals import DEFAULT_TICK, SIGNALS, resolve, signals_with_orders
from barlattice.plans.asof import asof
from barlattice.plans.blocks import Series
from barlattice.plans.lineage import settle
from barlattice.plans.touch import first_touch

KEYS = ["symbol", "timeframe"]


def with_next(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Bars with the previous time and the next time and open of their series."""
    s = Series(bars, block_rows=block_rows)
    s.lag("ts")
    s.lead("ts")
    s.lead("open")
    return s.frame().withColumnsRenamed(
        {"_ts_lag1": "prev_ts", "_ts_lead1": "next_ts", "_open_lead1": "next_open"}
    ).drop("_rn")


def _levels() -> tuple[Column, Column]:
    long = F.col("side") == 1
    return (F.when(long, F.col("target")).otherwise(F.col("stop")),
            F.when(long, F.col("stop")).otherwise(F.col("target")))


def gap_fill(side: Column, level: Column, open_: Column, is_stop: Column) -> Column:
    """Price at which a resting exit at ``level`` fills: the open when the bar opens beyond it.

    A long's stop and a short's target sit below, a long's target and a short's stop above.
    """
    below = (side == 1) == is_stop
    return F.when(below, F.least(open_, level)).otherwise(F.greatest(open_, level))


def outcomes(
    sig: DataFrame, bars: DataFrame, fill: str = "next_open", eod_time: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """First later bar touching stop or target per signal; the stop wins when one bar touches both.

    ``sig`` needs a unique ``signal_id``, the series keys, ``ts``, ``side``, ``stop``, ``target``.
    ``fill``: ``next_open`` leaves at the following open, ``resting`` at the level. With
    ``eod_time`` a position still open at that bar of a day leaves at its close.
    """
    if fill not in ("next_open", "resting"):
        raise ValueError(f"unknown exit fill: {fill}")
    up, down = _levels()
    b = with_next(bars, block_rows)
    cols = ["open", "high", "low", "close", "prev_ts", "next_ts", "next_open"]
    hit = first_touch(
        sig.withColumns({"_up": up, "_down": down}), b, KEYS, "signal_id", "ts", "_up", "_down", cols,
        path=bars,
    ).drop("_up", "_down")
    long = F.col("side") == 1
    stop_hit = F.when(long, F.col("hit_low") <= F.col("stop")).otherwise(F.col("hit_high") >= F.col("stop"))
    goal_hit = F.when(long, F.col("hit_high") >= F.col("target")).otherwise(F.col("hit_low") <= F.col("target"))
    out = hit.withColumns({
        "stop_touched": falsy(stop_hit), "target_touched": falsy(goal_hit),
    }).withColumn(
        "outcome",
        F.when(F.col("stop_touched"), "STOP").when(F.col("target_touched"), "TARGET"),
    )
    is_stop = F.col("outcome") == "STOP"
    level = F.when(is_stop, F.col("stop")).otherwise(F.col("target"))
    if fill == "next_open":
        ts, px = F.col("hit_next_ts"), F.col("hit_next_open")
    else:
        ts, px = F.col("hit_ts"), gap_fill(F.col("side"), level, F.col("hit_open"), is_stop)
    out = out.withColumns({
        "exit_ts": F.when(F.col("outcome").isNotNull(), ts),
        "exit_price": F.when(F.col("outcome").isNotNull(), px),
    })
    if eod_time:
        eod = first_at_or_after(bars, eod_time).where("is_close_bar").select(
            *KEYS, F.col("ts").alias("eod_ts"), F.col("close").alias("eod_close"))
        out = asof(out, eod, KEYS, "ts", "eod_ts", {"eod_ts": "_eod_ts", "eod_close": "_eod_close"},
                   forward=True, strict=True)
        cut = falsy(F.col("_eod_ts").isNotNull()
                    & (F.col("hit_ts").isNull() | (F.col("_eod_ts") < F.col("hit_ts"))))
        out = out.withColumns({
            "outcome": F.when(cut, "EOD").otherwise(F.col("outcome")),
            "exit_ts": F.when(cut, F.col("_eod_ts")).otherwise(F.col("exit_ts")),
            "exit_price": F.when(cut, F.col("_eod_close")).otherwise(F.col("exit_price")),
        }).drop("_eod_ts", "_eod_close")
    return out


def resolve_ties(
    out: DataFrame, fine: DataFrame, fine_seconds: int, coarse_timeframe: str | None = None
) -> DataFrame:
    """Decide bars that touch both levels by finer bars when those cover them completely.

    Only tie rows are joined. Fine bars in (previous coarse time, coarse time] must be exactly the
    regular grid; otherwise, or when the first deciding fine bar ties again, the stop stays.
    """
    tie = out.where(F.col("stop_touched") & F.col("target_touched") & F.col("hit_prev_ts").isNotNull())
    span = F.sequence(F.to_date("hit_prev_ts"), F.to_date("hit_ts"))
    want = ((micros("hit_ts") - micros("hit_prev_ts")) / F.lit(fine_seconds * 1_000_000)).cast("long")
    cand = tie.select(
        "signal_id", "symbol", "side", "stop", "target", "hit_prev_ts", "hit_ts", want.alias("_want"),
        F.explode(span).alias("_d"))
    f = fine.select("symbol", F.to_date("ts").alias("_d"), F.col("ts").alias("_t"),
                    F.col("high").alias("_h"), F.col("low").alias("_l"))
    step = F.lit(fine_seconds * 1_000_000)
    j = cand.join(f, ["symbol", "_d"]).where(
        (F.col("_t") > F.col("hit_prev_ts")) & (F.col("_t") <= F.col("hit_ts")))
    long = F.col("side") == 1
    s = F.when(long, F.col("_l") <= F.col("stop")).otherwise(F.col("_h") >= F.col("stop"))
    g = F.when(long, F.col("_h") >= F.col("target")).otherwise(F.col("_l") <= F.col("target"))
    on_grid = (micros("_t") - micros("hit_prev_ts")) % step == 0
    won = (
        j.groupBy("signal_id")
        .agg(
            F.count("*").alias("_n"), F.max("_want").alias("_want"),
            F.min(on_grid.cast("int")).alias("_grid"),
            F.min_by(F.when(s, "STOP").otherwise("TARGET"), F.when(s | g, F.col("_t"))).alias("_won"),
        )
        .where((F.col("_n") == F.col("_want")) & (F.col("_grid") == 1))
        .select("signal_id", "_won")
    )
    r = out.join(won, "signal_id", "left").withColumn(
        "resolved_outcome", F.coalesce("_won", "outcome"))
    return r.drop("_won")


def trailing_exits(
    entries: DataFrame, bars: DataFrame, length: int, buffer: float, block_rows: int | None = None
) -> DataFrame:
    """Exit of each entry at the first later bar that trades through the previous bar's channel stop."""
    out = trailing_exits_of(entries.withColumn("params_id", F.lit(0)), bars, [(length, F.lit(buffer))], block_rows)
    return out.drop("params_id")


def trailing_exits_of(
    entries: DataFrame, bars: DataFrame, sets: Sequence[tuple[int, Column]], block_rows: int | None = None
) -> DataFrame:
    """The same for several (length, buffer); ``params_id`` of an entry is the position in ``sets``.

    Whether a bar goes through depends on the bar alone, so the search is an as-of join to the
    flagged bars of the entry's set and side. All sets are declared on one Series.
    """
    s = Series(bars, block_rows=block_rows)
    made = []
    for i, (length, buffer) in enumerate(sets):
        lv = range_levels(s, length)
        long_stop, short_stop = F.col(s.lag(lv["support"])) - buffer, F.col(s.lag(lv["resistance"])) + buffer
        made += [
            F.when(falsy(F.col("low") <= long_stop), F.struct(
                F.lit(i).alias("params_id"), F.lit(1).alias("side"), F.least("open", long_stop).alias("price"))),
            F.when(falsy(F.col("high") >= short_stop), F.struct(
                F.lit(i).alias("params_id"), F.lit(-1).alias("side"), F.greatest("open", short_stop).alias("price")))]
    hits = s.frame().select(*KEYS, "ts", F.explode(F.array_compact(F.array(*made))).alias("_x")).select(*KEYS, "ts", "_x.*")
    return asof(entries, hits, [*KEYS, "params_id", "side"], "entry_ts", "ts",
                {"ts": "exit_ts", "price": "exit_price"}, forward=True, strict=True)


def end_of_day_exits(entries: DataFrame, bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Flat at the open after the last bar of the entry day."""
    b = with_next(bars, block_rows)
    last = b.where(F.coalesce(F.to_date("next_ts") != F.to_date("ts"), F.lit(True)))
    return asof(entries, last, KEYS, "entry_ts", "ts",
                {"ts": "eod_ts", "next_ts": "exit_ts", "next_open": "exit_price"}, forward=True)


def with_id(sig: DataFrame) -> DataFrame:
    return sig.withColumn("signal_id", F.concat_ws(
        "|", "symbol", "timeframe", micros("ts").cast("string"), F.col("params_id").cast("string")))


def rests(kind: tuple[str, str]) -> bool:
    """Whether an order of this type and time in force may wait beyond the next bar."""
    return kind[0] != "MARKET" and kind[1] != "IOC"


def entered(sig: DataFrame, bars: DataFrame, kinds: Collection[tuple[str, str]] | None = None) -> DataFrame:
    """Signals with entry_ts and entry_price, null where the entry order never fills.

    Market and IOC orders are decided by the next bar that the signal carries; DAY orders rest
    until the end of their day. ``kinds`` names the (order type, time in force) pairs that occur, so
    that nothing is planned for others.
    """
    up = F.col("side") == 1
    limit = F.when(F.col("entry_type") == "LIMIT", F.col("entry_level"))
    stop = F.when(F.col("entry_type") == "STOP", F.col("entry_level"))
    side = F.when(up, "BUY").otherwise("SELL")
    price, _ = fill_price(F.col("entry_type"), side, limit, stop, F.col("next_open"), F.col("next_high"), F.col("next_low"))
    at_once = (F.col("entry_type") == "MARKET") | (F.col("tif") == "IOC")
    now = sig.where(at_once).withColumn("entry_price", price).withColumn(
        "entry_ts", F.when(F.col("entry_price").isNotNull(), F.col("next_ts")))
    if kinds is not None and not any(map(rests, kinds)):
        return now
    later = sig.where(~at_once)
    orders = later.select(
        F.col("signal_id").alias("order_id"), *KEYS, F.col("ts").alias("placed_at"), side.alias("side"),
        F.col("entry_type").alias("order_type"), limit.alias("limit_price"), stop.alias("stop_price"),
        F.col("tif").alias("time_in_force"), F.lit(1.0).alias("quantity"))
    met = resting_fills(orders, bars, None if kinds is None else {k for k in kinds if rests(k)}).select(
        F.col("order_id").alias("signal_id"), F.col("bar_ts").alias("entry_ts"), F.col("raw_price").alias("entry_price"))
    filled = later.join(met, "signal_id")
    return filled.select(*now.columns) if kinds is not None and all(map(rests, kinds)) else now.unionByName(filled)


def sweep(
    bars: DataFrame, name: str, params: Sequence[Mapping[str, Any]], block_rows: int | None = None
) -> DataFrame:
    """Every signal of every parameter set with its entry and exit.

    The rule's own orders are followed: the entry by its order type and time in force, the exit at
    its bracket (``next_open``, ``resting``), by its trailing channel stop or at the end of the day.
    ``state`` is UNFILLED, OPEN or CLOSED; ``pnl`` is set for closed trades. Each signal stands
    alone: no shared capital and no limit of one position at a time.
    """
    signal = SIGNALS[resolve(name)]
    fill = signal.exit_fill
    sets = [{**signal.defaults, **p} for p in (params or [{}])]
    found, kinds = signals_with_orders(bars, name, params, block_rows)
    # every branch below reads the signals, so they are found once
    rows = entered(settle(with_id(found)), bars, kinds)
    if any(map(rests, kinds)):
        rows = settle(rows)
    kept = [*rows.columns]
    filled = rows.where(F.col("entry_ts").isNotNull())
    if fill in ("next_open", "resting"):
        # a bracket rests from the signal where the entry is at market, else from the fill on
        start = F.when(F.col("entry_type") == "MARKET", F.col("ts")).otherwise(F.col("entry_ts"))
        out = outcomes(filled.withColumn("_made", F.col("ts")).withColumn("ts", start), bars, fill, block_rows=block_rows)
        out = out.withColumn("ts", F.col("_made")).select(*kept, "outcome", "exit_ts", "exit_price")
    elif fill == "trailing":
        tick = F.coalesce(F.col("tick_size"), F.lit(DEFAULT_TICK)) if "tick_size" in bars.columns else F.lit(DEFAULT_TICK)
        stops = [(max(1, int(p["length"])), tick * max(1, int(p["entry_buffer_ticks"]))) for p in sets]
        out = trailing_exits_of(filled, bars, stops, block_rows).withColumn(
            "outcome", F.when(F.col("exit_ts").isNotNull(), "TRAIL"))
    elif fill == "end_of_day":
        out = end_of_day_exits(filled, bars, block_rows).drop("eod_ts").withColumn(
            "outcome", F.when(F.col("exit_ts").isNotNull(), "EOD"))
    else:
        raise ValueError(f"unknown exit: {fill}")
    waiting = rows.where(F.col("entry_ts").isNull())
    all_rows = out.unionByName(waiting, allowMissingColumns=True)
    closed = F.col("exit_price").isNotNull()
    return all_rows.withColumns({
        "state": F.when(F.col("entry_ts").isNull(), "UNFILLED").when(closed, "CLOSED").otherwise("OPEN"),
        "pnl": F.when(closed, F.col("side") * (F.col("exit_price") - F.col("entry_price")))})


def sweep_kpis(trades: DataFrame) -> DataFrame:
    """Statistics of the closed trades per series and parameter set."""
    return trade_stats(trades.where("state = 'CLOSED'"), [*KEYS, "params_id"])


