"""Order costs, fills against the next bar, resting orders, sizing and target deltas."""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.functions.exprs import falsy, half_even, over_zero
from barlattice.operators.indicators import log_return
from barlattice.plans.asof import asof
from barlattice.plans.blocks import Series
from barlattice.plans.touch import first_touch, matching_bars
from barlattice.plans.salt import join_small

KEYS = ["symbol", "timeframe"]

# Supported order types, spread multipliers and instrument defaults.
ORDER_TYPES = ["MARKET", "LIMIT", "STOP", "STOP_LIMIT"]
SPREAD_MULTIPLIER = {"MARKET": 1.0, "STOP": 1.0, "LIMIT": 0.0, "STOP_LIMIT": 0.0}
DEFAULT_SPEC = {"tick_size": 0.01, "multiplier": 1.0, "margin_ratio": 0.10}


def normalize_order_type(order_type: str) -> str:
    t = str(order_type).upper()
    if t not in ORDER_TYPES:
        raise ValueError(f"unsupported order type {order_type!r}; expected one of {ORDER_TYPES}")
    return t


def order_type_column(c: str | Column) -> Column:
    """Upper-cased order type; unknown types fail the job."""
    t = F.upper(c)
    return F.when(t.isin(ORDER_TYPES), t).otherwise(
        F.raise_error(F.concat(F.lit("unsupported order type: "), F.coalesce(t, F.lit("null")))))


def with_specs(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Instrument columns with defaults for unknown symbols (one row per symbol)."""
    have = [c for c in DEFAULT_SPEC if c in specs.columns]
    spread = [c for c in rows.columns if c not in DEFAULT_SPEC and c != "symbol"]
    out = join_small(rows, specs.select("symbol", *have), ["symbol"], spread or ["symbol"], "left")
    return out.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in DEFAULT_SPEC.items()
    })


def cost_profile(
    commission_rate: float = 0.0, spread_overrides: Mapping[str, float] | None = None,
    commission_overrides: Mapping[str, float] | None = None,
) -> dict[str, tuple[float, float]]:
    """Order type -> (spread multiplier, commission per unit)."""
    spread = {normalize_order_type(k): float(v) for k, v in (spread_overrides or {}).items()}
    comm = {normalize_order_type(k): float(v) for k, v in (commission_overrides or {}).items()}
    return {t: (spread.get(t, SPREAD_MULTIPLIER[t]), comm.get(t, float(commission_rate)))
            for t in ORDER_TYPES}


def cost_profile_table(spark: SparkSession, profile: Mapping[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame(
        [(t, *v) for t, v in profile.items()],
        "order_type STRING, spread_multiplier DOUBLE, commission_rate DOUBLE")


def _of_type(profile: Mapping[str, tuple[float, float]], which: int, order_type: Column) -> Column:
    out = F.raise_error(F.lit("unsupported order type")).cast("double")
    for t, v in profile.items():
        out = F.when(order_type == t, F.lit(v[which])).otherwise(out)
    return out


def spread_ticks(ticks: Column, multiplier: Column) -> Column:
    return F.greatest(F.lit(0), half_even(ticks * multiplier).cast("int"))


def order_cost(
    rows: DataFrame, profile: Mapping[str, tuple[float, float]], ticks: str = "spread_ticks",
    order_type: str = "order_type", prefix: str = "",
) -> DataFrame:
    """Slippage per unit and in cash, commission and total of one fill. Needs the spec columns."""
    t = order_type_column(order_type)
    eff = spread_ticks(F.col(ticks), _of_type(profile, 0, t))
    qty = F.abs("quantity")
    slip = eff * F.col("tick_size")
    cash = qty * slip * F.col("multiplier")
    comm = qty * _of_type(profile, 1, t)
    return rows.withColumns({
        f"{prefix}effective_ticks": eff, f"{prefix}slippage_price": slip,
        f"{prefix}slippage_cash": cash, f"{prefix}commission_cash": comm,
        f"{prefix}total_cash": cash + comm,
    })


def round_trip_cost(
    rows: DataFrame, profile: Mapping[str, tuple[float, float]], entry_type: str, exit_type: str,
    ticks: str = "spread_ticks",
) -> DataFrame:
    out = rows.withColumns({"_in": F.lit(normalize_order_type(entry_type)),
                            "_out": F.lit(normalize_order_type(exit_type))})
    out = order_cost(order_cost(out, profile, ticks, "_in", "entry_"), profile, ticks, "_out", "exit_")
    return out.withColumn(
        "round_trip_cash", F.col("entry_total_cash") + F.col("exit_total_cash")).drop("_in", "_out")


def adaptive_spread(
    bars: DataFrame, base_ticks: int, step: float, step_multiplier: float, mode: str = "adaptive_volatility",
    lookback: int = 20, baseline: int = 100, block_rows: int | None = None,
) -> DataFrame:
    """Spread in ticks per bar from the closes before it: base * multiplier ** whole vol steps."""
    base = F.lit(max(0, base_ticks))
    if mode == "static":
        return bars.withColumn("spread_ticks", base)
    if mode != "adaptive_volatility":
        raise ValueError(f"unknown spread mode: {mode}")
    s = Series(bars, block_rows=block_rows)
    ret = log_return(s)

    def vol(n: int):
        def build(f) -> Column:
            w = f.between(-n, -1)
            return F.when(F.count(ret).over(w) >= 2, F.stddev_samp(ret).over(w)).otherwise(0.0)
        return build

    now = F.col(s.add(f"_vol_now_{lookback}", vol(lookback), [ret], back=lookback))
    usual = F.col(s.add(f"_vol_base_{baseline}", vol(baseline), [ret], back=baseline))
    steps = (over_zero(now - usual, usual) / F.lit(step)).cast("int") if step > 0 else F.lit(0)
    ok = (F.col("_rn") - 1 >= lookback + 1) & (usual > 0) & (now > 0) & (F.lit(step) > 0)
    adjusted = F.greatest(F.lit(0), half_even(F.lit(float(base_ticks)) * F.pow(
        F.lit(float(step_multiplier)), steps)).cast("int"))
    f = s.frame().withColumn(
        "spread_ticks", F.when(falsy(ok & (steps != 0)), adjusted).otherwise(base))
    return f.select(*bars.columns, "spread_ticks")


def fill_price(
    order_type: Column, side: Column, limit: Column, stop: Column, o: Column, h: Column, lo: Column,
    close: Column | None = None, at_close: Column | None = None,
) -> tuple[Column, Column]:
    """Price and phase (OPEN, INTRABAR, CLOSE) at which an order fills on one bar; null if not.

    A bar that opens beyond a level fills at its open. At the close only market orders fill.
    """
    buy = side == "BUY"
    none = F.lit(None).cast("double")
    lim = F.when(
        buy, F.when(o <= limit, o).when(lo <= limit, limit)
    ).otherwise(F.when(o >= limit, o).when(h >= limit, limit))
    stp = F.when(
        buy, F.when(o >= stop, o).when(h >= stop, stop)
    ).otherwise(F.when(o <= stop, o).when(lo <= stop, stop))
    sl_buy = F.when(o >= stop, F.when(o <= limit, o)).when((h >= stop) & (lo <= limit), limit)
    sl_sell = F.when(o <= stop, F.when(o >= limit, o)).when((lo <= stop) & (h >= limit), limit)
    beyond = F.when(
        order_type == "LIMIT", F.when(buy, o <= limit).otherwise(o >= limit)
    ).otherwise(F.when(buy, o >= stop).otherwise(o <= stop))
    price = (
        F.when(order_type == "MARKET", o)
        .when(order_type == "LIMIT", lim)
        .when(order_type == "STOP", stp)
        .when(order_type == "STOP_LIMIT", F.when(buy, sl_buy).otherwise(sl_sell))
    )
    phase = F.when((order_type == "MARKET") | falsy(beyond), "OPEN").otherwise("INTRABAR")
    if at_close is not None:
        price = F.when(at_close, F.when(order_type == "MARKET", close).otherwise(none)).otherwise(price)
        phase = F.when(at_close, "CLOSE").otherwise(phase)
    return price, F.when(price.isNotNull(), phase)


def rejection() -> Column:
    """Why an order is not valid, null when it is."""
    t = F.upper("order_type")
    return (
        F.when(F.col("quantity") <= 0, "quantity not positive")
        .when(~t.isin(ORDER_TYPES), "unsupported order type")
        .when(t.isin("LIMIT", "STOP_LIMIT") & F.col("limit_price").isNull(), "limit price missing")
        .when(t.isin("STOP", "STOP_LIMIT") & F.col("stop_price").isNull(), "stop price missing")
    )


def executable_quantity(side: Column, quantity: Column, reduce_only: Column, position: Column) -> Column:
    """Requested quantity, or for reduce-only orders what the opposite position leaves."""
    left = F.when(side == "BUY", F.greatest(-position, F.lit(0.0))).otherwise(
        F.greatest(position, F.lit(0.0)))
    return F.when(reduce_only, F.least(F.abs(quantity), left)).otherwise(F.abs(quantity))


def next_bar(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Orders with the first bar strictly after ``placed_at`` (columns ``bar_*``)."""
    cols = {c: f"bar_{c}" for c in ("ts", "open", "high", "low", "close")}
    return asof(orders, bars, KEYS, "placed_at", "ts", cols, forward=True, strict=True)


def preview(orders: DataFrame, at_close: bool = False) -> DataFrame:
    """``raw_price`` and ``fill_phase`` against the attached bar; invalid orders get neither."""
    price, phase = fill_price(
        F.upper("order_type"), F.col("side"), F.col("limit_price"), F.col("stop_price"),
        F.col("bar_open"), F.col("bar_high"), F.col("bar_low"), F.col("bar_close"), F.lit(at_close))
    valid = F.col("rejection").isNull()
    return orders.withColumn("rejection", rejection()).withColumns({
        "raw_price": F.when(valid, price), "fill_phase": F.when(valid, phase)})


def execute(
    orders: DataFrame, bars: DataFrame, profile: Mapping[str, tuple[float, float]],
    specs: DataFrame, at_close: bool = False,
) -> DataFrame:
    """Orders filled on their next bar: quantity, price after spread, commission, slippage, status."""
    o = with_specs(preview(next_bar(orders, bars), at_close), specs)
    buy = F.col("side") == "BUY"
    qty = executable_quantity(F.col("side"), F.col("quantity"), F.col("reduce_only"), F.col("position"))
    valid = F.col("rejection").isNull()
    t = F.when(valid, F.upper("order_type"))
    slip = F.when(valid, spread_ticks(F.col("spread_ticks"), _of_type(profile, 0, t)) * F.col("tick_size"))
    filled = valid & (F.col("exec_quantity") > 0) & F.col("raw_price").isNotNull()
    o = o.withColumn("exec_quantity", qty).withColumn("slippage", slip)
    price = F.when(buy, F.col("raw_price") + F.col("slippage")).otherwise(F.col("raw_price") - F.col("slippage"))
    o = o.withColumn("status", F.when(~valid, "REJECTED")
                     .when(F.col("exec_quantity") <= 0,
                           F.when(F.col("reduce_only"), "CANCELLED").otherwise("REJECTED"))
                     .when(filled, "FILLED")
                     .when(F.upper("time_in_force") == "IOC", "CANCELLED").otherwise("ACCEPTED"))
    done = F.col("status") == "FILLED"
    return o.withColumns({
        "fill_price": F.when(done, price),
        "commission": F.when(done, F.col("exec_quantity") * _of_type(profile, 1, t)),
        "slippage": F.when(done, F.col("slippage")),
    }).withColumn(
        "cost", F.when(buy, F.col("fill_price") * F.col("exec_quantity")).otherwise(
            -F.col("fill_price") * F.col("exec_quantity")))


def resting_fills(
    orders: DataFrame, bars: DataFrame, kinds: Collection[tuple[str, str]] | None = None
) -> DataFrame:
    """First bar at which each order fills: IOC the next bar, DAY the same date, GTC any later bar.

    Orders that :func:`preview` rejects never fill. Needs a unique ``order_id``; market orders fill on the next bar. Returns the orders with
    ``bar_ts``, ``raw_price`` and ``fill_phase``, null when they never fill. ``kinds`` names the (order
    type, time in force) pairs that occur, in upper case; other kinds are not planned for.
    """
    o = orders.withColumn("_tif", F.upper("time_in_force")).withColumn("_bad", rejection().isNotNull())
    o = o.withColumn("order_type", F.upper("order_type"))
    refused, o = o.where("_bad"), o.where(~F.col("_bad"))
    market = F.col("order_type") == "MARKET"
    once = (F.col("_tif") == "IOC") | market
    cols = ["ts", "open", "high", "low", "close"]

    def priced(df: DataFrame) -> DataFrame:
        price, phase = fill_price(
            F.col("order_type"), F.col("side"), F.col("limit_price"), F.col("stop_price"),
            F.col("bar_open"), F.col("bar_high"), F.col("bar_low"))
        return df.withColumns({"raw_price": price, "fill_phase": phase})

    def finish(df: DataFrame) -> DataFrame:
        hit = F.col("raw_price").isNotNull()
        return df.select(*orders.columns, F.when(hit, F.col("bar_ts")).alias("bar_ts"),
                         "raw_price", "fill_phase")

    def occurs(test: Callable[[str, str], bool]) -> bool:
        return kinds is None or any(test(t, f) for t, f in kinds)

    made = []
    if occurs(lambda t, f: t == "MARKET" or f == "IOC"):
        made.append(finish(priced(next_bar(o.where(once), bars))))
    if occurs(lambda t, f: t != "MARKET" and f == "DAY"):
        same_day = o.where(~once & (F.col("_tif") == "DAY")).withColumn("_d", F.to_date("placed_at"))
        day_bars = bars.select(*[F.col(k).alias(f"_k_{k}") for k in KEYS], F.to_date("ts").alias("_bd"),
                               *[F.col(c).alias(f"bar_{c}") for c in cols])
        on = [F.col(k) == F.col(f"_k_{k}") for k in KEYS] + [
            F.col("_d") == F.col("_bd"), F.col("bar_ts") > F.col("placed_at")]
        made.append(_first_fill(priced(same_day.join(day_bars, on, "left")), orders.columns))
    gtc = o.where(~once & (F.col("_tif") != "DAY"))
    buy = F.col("side") == "BUY"
    if occurs(lambda t, f: t in ("LIMIT", "STOP") and f not in ("DAY", "IOC")):
        plain = gtc.where(F.col("order_type") != "STOP_LIMIT")
        level = F.when(F.col("order_type") == "LIMIT", F.col("limit_price")).otherwise(F.col("stop_price"))
        upward = buy == (F.col("order_type") == "STOP")
        touched = first_touch(
            plain.withColumns({"_up": F.when(upward, level), "_down": F.when(~upward, level)}),
            bars, KEYS, "order_id", "placed_at", "_up", "_down", cols, prefix="bar_")
        made.append(finish(priced(touched)))
    none = refused.select(*orders.columns)
    if occurs(lambda t, f: t == "STOP_LIMIT" and f not in ("DAY", "IOC")):
        # A stop-limit needs both levels inside a bar, so candidate days must span both of them.
        both = gtc.where(F.col("order_type") == "STOP_LIMIT").withColumns({
            "_top": F.when(buy, F.col("stop_price")).otherwise(F.col("limit_price")),
            "_bot": F.when(buy, F.col("limit_price")).otherwise(F.col("stop_price"))})
        double = _first_fill(
            priced(matching_bars(both, bars, KEYS, "placed_at", "_top", "_bot", cols, "bar_")), orders.columns)
        made.append(double)
        none = both.select(*orders.columns).join(double.select("order_id"), "order_id", "left_anti").unionByName(none)
    never = none.withColumns({"bar_ts": F.lit(None).cast(bars.schema["ts"].dataType), "raw_price": F.lit(None).cast("double"),
                              "fill_phase": F.lit(None).cast("string")})
    return reduce(DataFrame.unionByName, [*made, never])


def _first_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    hit = F.when(F.col("raw_price").isNotNull(), F.col("bar_ts"))
    return (
        df.groupBy(F.col("order_id").alias("_id"))
        .agg(F.any_value(F.struct(*columns)).alias("_o"),
             F.min_by(F.struct("bar_ts", "raw_price", "fill_phase"), hit).alias("_f"))
        .select("_o.*", "_f.bar_ts", "_f.raw_price", "_f.fill_phase")
    )


def target_contracts(
    signals: DataFrame, target_vol: float, max_expansion: float, max_contracts: int | None = None
) -> DataFrame:
    """Volatility-targeted position per signal.

    Needs equity, weight, duty_cycle, n_symbols, price, multiplier, margin_ratio, annual_vol
    (null or not positive counts as 1), direction, intent.
    """
    c = F.col
    duty = F.greatest(c("duty_cycle"), F.lit(1e-4))
    boost = F.least(1.0 / F.sqrt(duty), F.lit(math.sqrt(max_expansion)))
    n = F.nullif(c("n_symbols"), F.lit(0))
    budget = F.when(c("weight") > 0, c("equity") * target_vol * F.sqrt("weight") * boost).otherwise(0.0) / n
    margin = c("equity") * c("weight") / n
    vol = F.when(c("annual_vol") > 0, c("annual_vol")).otherwise(1.0)
    unit = F.nullif(vol * c("price") * c("multiplier"), F.lit(0.0))
    raw = half_even(F.greatest(F.lit(0.0), budget / unit))
    cap = F.floor(margin / F.nullif(c("price") * c("multiplier") * c("margin_ratio"), F.lit(0.0)))
    size = F.least(raw, F.greatest(cap, F.lit(0)).cast("double"))
    if max_contracts is not None:
        size = F.least(size, F.lit(float(max_contracts)))
    ok = (c("price") > 0) & (c("multiplier") > 0) & (c("margin_ratio") > 0) & (c("direction") != 0)
    qty = F.when(falsy(ok), F.coalesce(size, F.lit(0.0))).otherwise(0.0)
    close = F.upper("intent") == "CLOSE"
    return signals.withColumn(
        "target_qty", F.when(falsy(close), F.lit(0.0)).otherwise(qty * c("direction")))


def target_deltas(targets: DataFrame, positions: DataFrame, pending: DataFrame) -> DataFrame:
    """Orders that move current plus pending quantity to target; less than half a unit is dropped.

    ``targets`` and ``positions`` hold one row per (slot_id, symbol), ``pending`` signed orders;
    pending reduce-only orders do not count.
    """
    on = ["slot_id", "symbol"]
    waiting = pending.where(~F.col("reduce_only")).groupBy(*on).agg(F.sum("signed_quantity").alias("_p"))
    zero = F.lit(0.0)
    held = F.coalesce("position", zero) + F.coalesce("_p", zero)
    delta, target = F.col("delta"), F.col("target_qty")
    now = F.col("exposure")
    reduces = ((now > 0) & (delta < 0) & (target >= 0)) | ((now < 0) & (delta > 0) & (target <= 0))
    return (
        targets.join(positions, on, "left").join(waiting, on, "left")
        .withColumn("exposure", held)
        .withColumn("delta", F.col("target_qty") - F.col("exposure"))
        .where(F.abs("delta") >= 0.5)
        .select(*on, "target_qty", "exposure", "delta",
                F.when(delta > 0, "BUY").otherwise("SELL").alias("side"),
                F.abs("delta").alias("quantity"), reduces.alias("reduce_only"))
    )


def gross_pnl(trades: DataFrame) -> DataFrame:
    """Price difference times quantity and multiplier, in the trade's direction, to the cent."""
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    g = sign * (F.col("exit_price") - F.col("entry_price")) * F.abs("quantity") * F.col("multiplier")
    return trades.withColumn("gross_pnl", F.round(g, 2))


