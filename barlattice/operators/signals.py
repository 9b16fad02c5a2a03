"""Entry rules as columns, evaluated for many parameter sets over one pass of the bars.

A rule declares what it needs on a Series and returns its columns. It keeps no position state:
every bar is judged on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.functions.exprs import falsy
from barlattice.operators import indicators as I
from barlattice.operators.predicates import gate_direction, hour_mask
from barlattice.plans.blocks import Series

KEYS = ["symbol", "timeframe"]
DEFAULT_TICK = 0.01


@dataclass(frozen=True)
class Rule:
    """Columns of one entry rule: side is 1, -1 or 0; a null entry means at market."""

    side: Column
    entry_type: str
    tif: str
    entry: Column
    stop: Column
    target: Column


# Parameter defaults of the rules, their prefixes and search ranges.
SMA_PULLBACK = dict(fast_sma_window=50, slow_sma_window=200, atr_window=14, atr_sl_mult=2.0,
                    rr_ratio=3.0, trade_direction="both")
THREE_BAR = dict(regime_window=50, extreme_lookback=5, trade_direction="long",
                 use_shock_filter=True, shock_atr_window=14, shock_max_gap_atr=1.0,
                 shock_max_range_atr=2.5, shock_max_close_change_atr=1.75, entry_atr_window=14,
                 entry_limit_atr_frac=0.10)
CHANNEL = dict(length=50, ema_period=200, entry_buffer_ticks=1, trade_direction="long",
               use_shock_filter=True, shock_atr_window=14, shock_max_gap_atr=1.25,
               shock_max_range_atr=3.0, shock_max_close_change_atr=2.0)
SQUEEZE = dict(bb_window=20, bb_num_std=2.0, squeeze_lookback=120, squeeze_quantile=0.20,
               squeeze_memory=5, width_expansion_factor=1.05, breakout_lookback=20,
               volume_window=20, breakout_volume_ratio=1.30, atr_window=14, stop_atr_buffer=0.50,
               target_rr=1.75, entry_buffer_ticks=1, trade_direction="short",
               use_shock_filter=True, shock_atr_window=14, shock_max_gap_atr=1.50,
               shock_max_range_atr=3.50, shock_max_close_change_atr=2.25)
TIGHTENING = dict(kc_ema_window=20, kc_atr_window=20, kc_atr_mult=1.5, tightening_lookback=100,
                  tightening_quantile=0.25, tightening_memory=5, width_expansion_factor=1.03,
                  breakout_lookback=20, volume_window=20, breakout_volume_ratio=1.25,
                  risk_atr_window=14, stop_atr_buffer=0.60, target_rr=1.60, entry_buffer_ticks=1,
                  trade_direction="long", use_shock_filter=True, shock_atr_window=14,
                  shock_max_gap_atr=1.50, shock_max_range_atr=3.75,
                  shock_max_close_change_atr=2.25)
FRACTAL = dict(penetration_ticks=2.0, atr_length=14, atr_mult_tp=2.0, atr_mult_sl=2.0,
               ibs_buy_threshold=0.7, ibs_sell_threshold=0.3, lookback_bars=10, start_hour=2,
               end_hour=15, enable_time_filter=True, trade_direction="both",
               use_shock_filter=True, shock_atr_window=14, shock_max_gap_atr=1.0,
               shock_max_range_atr=2.75, shock_max_close_change_atr=1.8, use_stretch_filter=True,
               stretch_baseline_window=20, stretch_atr_window=14, stretch_max_long_atr=2.0,
               stretch_max_short_atr=2.0)
ORDER_BLOCK = dict(ob_impulse_atr_mult=0.75, ob_max_age_bars=48, atr_window=14, atr_tp_mult=3.0,
                   min_rr_ratio=3.0, sl_offset_ticks=2, trade_direction="both",
                   trend_sma_window=1000, use_vol_filter=True, vol_regime_window=50,
                   vol_history_window=500, vol_min_pct=0.20, vol_max_pct=0.80)


def override(defaults: Mapping[str, Any], prefix: str, settings: Mapping[str, Any]) -> dict[str, Any]:
    """Defaults with every ``prefix_name`` found in ``settings`` put in."""
    return {k: settings.get(f"{prefix}_{k}", v) for k, v in defaults.items()}


def param(params: str, prefix: str, name: str, default: Any) -> Column:
    """The same for a parameter map column."""
    return F.coalesce(F.try_element_at(params, F.lit(f"{prefix}_{name}")), F.lit(default))


def _tick(s: Series) -> Column:
    if "tick_size" in s.df.columns:
        return F.coalesce(F.col("tick_size"), F.lit(DEFAULT_TICK))
    return F.lit(DEFAULT_TICK)


def _shock_ok(s: Series, p: Mapping[str, Any]) -> Column:
    if not p["use_shock_filter"]:
        return F.lit(True)
    c = I.shock(s, p["shock_atr_window"], p["shock_max_gap_atr"], p["shock_max_range_atr"],
                p["shock_max_close_change_atr"])
    return F.col(c["allowed"])


def _side(long_ok: Column, short_ok: Column) -> Column:
    return F.when(falsy(long_ok), 1).when(falsy(short_ok), -1).otherwise(0)


def _pick(side: Column, up: Column, down: Column) -> Column:
    return F.when(side == 1, up).when(side == -1, down)


def _none() -> Column:
    return F.lit(None).cast("double")


def sma_pullback(s: Series, p: Mapping[str, Any]) -> Rule:
    fast, slow = F.col(I.sma(s, p["fast_sma_window"])), F.col(I.sma(s, p["slow_sma_window"]))
    c, a = F.col("close"), F.col(I.atr(s, p["atr_window"]))
    spans = (F.col("low") <= fast) & (F.col("high") >= fast)
    up, down = gate_direction(p["trade_direction"], spans & (c > slow), spans & (c < slow))
    side = _side(up, down)
    risk = a * float(p["atr_sl_mult"])
    reward = risk * float(p["rr_ratio"])
    return Rule(side, "MARKET", "GTC", _none(), _pick(side, c - risk, c + risk),
                _pick(side, c + reward, c - reward))


def three_bar_regime(bars: DataFrame, params: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Bars with one daily regime column per distinct regime window."""
    for n in sorted({p["regime_window"] for p in params}):
        bars = I.daily_regime(bars, n).withColumnRenamed("regime", f"regime_{n}")
    return bars


def three_bar(s: Series, p: Mapping[str, Any]) -> Rule:
    c, c1, c2 = F.col("close"), F.col(s.lag("close")), F.col(s.lag("close", 2))
    n = p["extreme_lookback"]
    lo = F.col(s.roll(f"_min_low_{n}", F.min("low"), ["low"], n))
    hi = F.col(s.roll(f"_max_high_{n}", F.max("high"), ["high"], n))
    bull = F.col(f"regime_{p['regime_window']}")
    more = F.col(s.lead("ts")).isNotNull()
    calm = _shock_ok(s, p)
    up, down = gate_direction(
        p["trade_direction"],
        (c < c1) & (c1 < c2) & (F.col("low") <= lo) & bull & calm & more,
        (c > c1) & (c1 > c2) & (F.col("high") >= hi) & ~bull & calm & more,
    )
    side = _side(up, down)
    off = F.col(I.atr(s, p["entry_atr_window"])) * float(p["entry_limit_atr_frac"])
    return Rule(side, "LIMIT", "DAY", _pick(side, c - off, c + off), _none(), _none())


def channel_breakout(s: Series, p: Mapping[str, Any]) -> Rule:
    lv = I.range_levels(s, max(1, int(p["length"])))
    top, bottom = F.col(lv["resistance"]), F.col(lv["support"])
    c, mean = F.col("close"), F.col(I.ema(s, max(1, int(p["ema_period"]))))
    buf = _tick(s) * max(1, int(p["entry_buffer_ticks"]))
    calm = _shock_ok(s, p)
    up, down = gate_direction(
        p["trade_direction"],
        (top + buf).isNotNull() & (c > mean) & calm, (bottom - buf).isNotNull() & (c < mean) & calm,
    )
    side = _side(up, down)
    # The stop trails: this is its level on the next bar; the exit search reads later levels.
    return Rule(side, "STOP", "IOC", _pick(side, top + buf, bottom - buf),
                _pick(side, bottom - buf, top + buf), _none())


def _breakout(s: Series, p: Mapping[str, Any], band: dict[str, str], quiet: dict[str, str], a: str) -> Rule:
    lv = I.range_levels(s, p["breakout_lookback"])
    top, bottom, height = (F.col(lv[k]) for k in ("resistance", "support", "height"))
    busy = F.col(I.volume_ratio(s, p["volume_window"])) >= p["breakout_volume_ratio"]
    ready = F.col(quiet["recent"]) & F.col(quiet["expanding"]) & busy & _shock_ok(s, p)
    c, atr = F.col("close"), F.col(a)
    buf = _tick(s) * max(1, int(p["entry_buffer_ticks"]))
    move = F.greatest(height, atr) * float(p["target_rr"])
    pad = atr * float(p["stop_atr_buffer"])
    up_in, up_stop, up_goal = top + buf, bottom - pad, top + buf + move
    dn_in, dn_stop, dn_goal = bottom - buf, top + pad, bottom - buf - move
    up, down = gate_direction(
        p["trade_direction"],
        falsy(ready & (c > top) & (F.col("high") >= F.col(band["upper"]))),
        falsy(ready & (c < bottom) & (F.col("low") <= F.col(band["lower"]))),
    )
    side = _side(
        up & ~down & (up_stop < up_in) & (up_in < up_goal),
        down & ~up & (dn_goal < dn_in) & (dn_in < dn_stop),
    )
    return Rule(side, "STOP", "IOC", _pick(side, up_in, dn_in), _pick(side, up_stop, dn_stop),
                _pick(side, up_goal, dn_goal))


def bollinger_squeeze(s: Series, p: Mapping[str, Any]) -> Rule:
    band = I.bollinger(s, p["bb_window"], p["bb_num_std"])
    quiet = I.compression(s, band["norm_width"], p["squeeze_lookback"], p["squeeze_quantile"],
                          p["squeeze_memory"], p["width_expansion_factor"])
    return _breakout(s, p, band, quiet, I.atr(s, p["atr_window"]))


def keltner_tightening(s: Series, p: Mapping[str, Any]) -> Rule:
    band = I.keltner(s, p["kc_ema_window"], p["kc_atr_window"], p["kc_atr_mult"])
    quiet = I.compression(s, band["norm_width"], p["tightening_lookback"], p["tightening_quantile"],
                          p["tightening_memory"], p["width_expansion_factor"])
    return _breakout(s, p, band, quiet, I.atr(s, p["risk_atr_window"]))


def fractal_pivot(s: Series, p: Mapping[str, Any]) -> Rule:
    lv = I.fractal_levels(s, max(3, int(p["lookback_bars"])))
    hf, lf = F.col(lv["high"]), F.col(lv["low"])
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    reach = _tick(s) * float(p["penetration_ticks"])
    hours = hour_mask(F.col("ts"), p["start_hour"], p["end_hour"], p["enable_time_filter"])
    buy = falsy(hours & (lo < lf) & (c > lf) & (o > lf) & (I.ibs() > p["ibs_buy_threshold"])
                & (lf - lo >= reach))
    sell = falsy(hours & (h > hf) & (c < hf) & (o < hf) & (I.ibs() < p["ibs_sell_threshold"])
                 & (h - hf >= reach))
    a, calm = F.col(I.atr(s, p["atr_length"])), _shock_ok(s, p)
    near_long = near_short = F.lit(True)
    if p["use_stretch_filter"]:
        x = I.stretch(s, p["stretch_baseline_window"], p["stretch_atr_window"],
                      p["stretch_max_long_atr"], p["stretch_max_short_atr"])
        near_long, near_short = F.col(x["long_ok"]), F.col(x["short_ok"])
    up, down = gate_direction(
        p["trade_direction"],
        buy & ~sell & calm & near_long & a.isNotNull(), sell & ~buy & calm & near_short & a.isNotNull(),
    )
    side = _side(up, down)
    risk, goal = a * float(p["atr_mult_sl"]), a * float(p["atr_mult_tp"])
    return Rule(side, "MARKET", "GTC", _none(), _pick(side, c - risk, c + risk),
                _pick(side, c + goal, c - goal))


@dataclass(frozen=True)
class Signal:
    """A registered rule: its parameters' prefix, defaults and search ranges."""

    prefix: str
    defaults: Mapping[str, Any]
    rule: Callable[[Series, Mapping[str, Any]], Rule] | None
    space: Mapping[str, Any]
    exit_fill: str
    table: Callable[..., DataFrame] | None = None
    prepare: Callable[[DataFrame, Sequence[Mapping[str, Any]]], DataFrame] | None = None


SIGNALS: dict[str, Signal] = {
    "sma_pullback": Signal("smapull", SMA_PULLBACK, sma_pullback, {
        "fast_sma_window": (20, 80, 10), "slow_sma_window": (120, 300, 30),
        "atr_window": (10, 30, 5), "atr_sl_mult": (1.25, 3.0, 0.25), "rr_ratio": (1.5, 4.0, 0.5),
        "trade_direction": ["both", "long", "short"]}, "next_open"),
    "three_bar_mr": Signal("tbar", THREE_BAR, three_bar, {
        "regime_window": (30, 120, 10), "extreme_lookback": (3, 9, 1),
        "entry_atr_window": (10, 30, 5), "entry_limit_atr_frac": (0.05, 0.30, 0.05),
        "shock_max_gap_atr": (0.75, 1.75, 0.25), "shock_max_range_atr": (1.75, 3.25, 0.25)},
        "end_of_day", prepare=three_bar_regime),
    "channel_breakout": Signal("chbrk", CHANNEL, channel_breakout, {
        "length": (20, 120, 10), "ema_period": (50, 400, 25), "entry_buffer_ticks": (1, 4, 1),
        "shock_max_gap_atr": (0.75, 2.0, 0.25), "shock_max_range_atr": (2.0, 4.0, 0.25),
        "shock_max_close_change_atr": (1.25, 3.0, 0.25)}, "trailing"),
    "bollinger_squeeze_breakout": Signal("bbsq", SQUEEZE, bollinger_squeeze, {
        "bb_window": (14, 30, 2), "breakout_lookback": (10, 40, 5),
        "breakout_volume_ratio": (1.10, 2.00, 0.10), "squeeze_quantile": (0.10, 0.35, 0.05),
        "target_rr": (1.25, 2.50, 0.25)}, "resting"),
    "keltner_tightening_breakout": Signal("kctg", TIGHTENING, keltner_tightening, {
        "kc_ema_window": (12, 30, 2), "kc_atr_window": (10, 30, 2),
        "breakout_lookback": (10, 40, 5), "breakout_volume_ratio": (1.10, 1.90, 0.10),
        "target_rr": (1.25, 2.25, 0.25)}, "resting"),
    "rfp_fractal": Signal("rfp", FRACTAL, fractal_pivot, {
        "lookback_bars": (5, 18, 1), "penetration_ticks": (1.0, 8.0, 1.0),
        "atr_mult_tp": (1.5, 4.0, 0.5), "atr_mult_sl": (1.0, 3.0, 0.25),
        "ibs_buy_threshold": (0.60, 0.85, 0.05), "ibs_sell_threshold": (0.15, 0.40, 0.05)},
        "next_open"),
}
# Other names the rules are known by.
ALIASES = {
    "ict_order_block": "ict_ob",
    "rolling_fractal_pivot": "rfp_fractal",
    "channel_breakout_long": "channel_breakout",
    "bollinger_breakout": "bollinger_squeeze_breakout",
    "kc_breakout": "keltner_tightening_breakout",
}


def register(name: str, signal: Signal) -> None:
    """Add a rule of one's own under an id."""
    SIGNALS[name] = signal


def resolve(name: str) -> str:
    """Signal id of an id or alias; unknown names raise."""
    key = str(name).strip()
    key = ALIASES.get(key, key)
    if key not in SIGNALS:
        raise KeyError(f"unknown signal {name!r}; known: {', '.join(sorted(SIGNALS))}")
    return key


def resolve_column(name: Column) -> Column:
    """Signal id per row; null for unknown names."""
    pairs = [x for kv in ALIASES.items() for x in map(F.lit, kv)]
    key = F.trim(name)
    found = F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)
    return F.when(found.isin(sorted(SIGNALS)), found)


def signals(
    bars: DataFrame, name: str, params: Sequence[Mapping[str, Any]] | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Rows with a signal, for every parameter set at once (``params_id`` is the list position).

    All sets are declared on one Series, so bars are read and shuffled once whatever their number.
    Next-bar time and open come along for entries.
    """
    return signals_with_orders(bars, name, params, block_rows)[0]


def signals_with_orders(
    bars: DataFrame, name: str, params: Sequence[Mapping[str, Any]] | None = None,
    block_rows: int | None = None,
) -> tuple[DataFrame, set[tuple[str, str]]]:
    """:func:`signals`, and the (order type, time in force) pairs the rule enters by."""
    sig = SIGNALS[resolve(name)]
    sets = [{**sig.defaults, **p} for p in (params or [{}])]
    if sig.table:
        made = [sig.table(bars, p, block_rows).withColumn("params_id", F.lit(i))
                for i, p in enumerate(sets)]
        return reduce(DataFrame.unionByName, made), {("MARKET", "GTC")}
    if sig.prepare:
        bars = sig.prepare(bars, sets)
    s = Series(bars, block_rows=block_rows)
    for c in ("ts", "open", "high", "low"):
        s.lead(c)
    rules = [sig.rule(s, p) for p in sets]
    made = [F.struct(
        F.lit(i).alias("params_id"), r.side.alias("side"), F.lit(r.entry_type).alias("entry_type"),
        F.lit(r.tif).alias("tif"), r.entry.alias("entry_level"), r.stop.alias("stop"),
        r.target.alias("target")) for i, r in enumerate(rules)]
    hits = F.filter(F.array(*made), lambda x: x["side"] != 0)
    found = s.frame().select(
        *KEYS, "ts", "close", F.explode(hits).alias("_s"),
        F.col("_ts_lead1").alias("next_ts"), F.col("_open_lead1").alias("next_open"),
        F.col("_high_lead1").alias("next_high"), F.col("_low_lead1").alias("next_low"),
    ).select(*KEYS, "ts", "close", "_s.*", "next_ts", "next_open", "next_high", "next_low")
    return found, {(r.entry_type, r.tif) for r in rules}


def order_blocks(
    bars: DataFrame, p: Mapping[str, Any] | None = None, block_rows: int | None = None
) -> DataFrame:
    """Zones left by a three-candle sweep and impulse, one row per zone."""
    p = {**ORDER_BLOCK, **(p or {})}
    return _zones(_zone_series(bars, p, block_rows).frame(), p)


def _zone_series(bars: DataFrame, p: Mapping[str, Any], block_rows: int | None) -> Series:
    s = Series(bars, block_rows=block_rows)
    I.atr(s, p["atr_window"])
    for c in ("high", "low"):
        s.lag(c)
        s.lag(c, 2)
    return s


def _zones(f: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    atr = F.col(f"atr_{p['atr_window']}")
    h1, l1, h2, l2 = (F.col(c) for c in ("_high_lag2", "_low_lag2", "_high_lag1", "_low_lag1"))
    strong = (F.abs(F.col("close") - F.col("open")) >= atr * p["ob_impulse_atr_mult"]) & (F.col("_rn") >= 4)
    bull = falsy(strong & (l2 < l1) & (l2 < F.col("low")) & (F.col("close") > h2))
    bear = falsy(strong & (h2 > h1) & (h2 > F.col("high")) & (F.col("close") < l2))
    zone = [
        F.when(bull, F.struct(F.lit("bull").alias("direction"), h2.alias("zone_high"),
                              l2.alias("zone_low"), l2.alias("stop_base"))),
        F.when(bear, F.struct(F.lit("bear").alias("direction"), h2.alias("zone_high"),
                              l2.alias("zone_low"), h2.alias("stop_base"))),
    ]
    return f.select(
        *KEYS, F.col("ts").alias("formed_ts"), F.col("_rn").alias("formed_rn"),
        F.explode(F.array_compact(F.array(*zone))).alias("_z"),
    ).select(*KEYS, "formed_ts", "formed_rn", "_z.*")


def zone_entries(
    bars: DataFrame, p: Mapping[str, Any] | None = None, block_rows: int | None = None
) -> DataFrame:
    """First valid retest of each zone within its age limit, unless a close went through it before.

    Every zone is judged alone. Zones meet later bars through row-number buckets as wide as the
    age limit, so a zone reads at most two buckets.
    """
    p = {**ORDER_BLOCK, **(p or {})}
    age = int(p["ob_max_age_bars"])
    s = _zone_series(bars, p, block_rows)
    gate_long = gate_short = F.lit(True)
    if p["use_vol_filter"]:
        _, ok = I.vol_regime(s, p["vol_regime_window"], p["vol_history_window"], p["vol_min_pct"],
                             p["vol_max_pct"])
        gate_long = gate_short = F.col(ok)
    if p["trend_sma_window"]:
        mean = F.col(I.sma(s, p["trend_sma_window"]))
        gate_long = gate_long & (mean.isNull() | (F.col("close") > mean))
        gate_short = gate_short & (mean.isNull() | ~(F.col("close") > mean))
    gate_long, gate_short = gate_direction(p["trade_direction"], gate_long, gate_short)
    for name in ("ts", "open", "high", "low"):
        s.lead(name)
    f = s.frame().withColumns({"_gl": gate_long, "_gs": gate_short})
    width = age + 1
    zones = _zones(f, p).withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("formed_rn") / width), F.floor((F.col("formed_rn") + age) / width))))
    tick = _tick(s)
    b = f.select(
        *KEYS, F.floor(F.col("_rn") / width).alias("_b"), "_rn", "ts", "open", "high", "low", "close",
        F.col(f"atr_{p['atr_window']}").alias("_atr"), "_gl", "_gs", tick.alias("_tick"),
        F.col("_ts_lead1").alias("next_ts"), F.col("_open_lead1").alias("next_open"),
        F.col("_high_lead1").alias("next_high"), F.col("_low_lead1").alias("next_low"),
    )
    j = zones.join(b, [*KEYS, "_b"]).where(
        (F.col("_rn") >= F.col("formed_rn")) & (F.col("_rn") <= F.col("formed_rn") + age))
    bull = F.col("direction") == "bull"
    c = F.col("close")
    off = p["sl_offset_ticks"] * F.col("_tick")
    stop = F.when(bull, F.col("stop_base") - off).otherwise(F.col("stop_base") + off)
    risk = F.when(bull, c - stop).otherwise(stop - c)
    trigger = F.when(
        bull, (F.col("low") <= F.col("zone_high")) & (c > F.col("open")) & (c >= F.col("zone_low"))
    ).otherwise((F.col("high") >= F.col("zone_low")) & (c < F.col("open")) & (c <= F.col("zone_high")))
    gate = F.when(bull, F.col("_gl")).otherwise(F.col("_gs"))
    enter = trigger & gate & (risk > 0)
    blown = ~trigger & F.when(bull, c < F.col("zone_low")).otherwise(c > F.col("zone_high"))
    reward = F.greatest(F.col("_atr") * p["atr_tp_mult"], risk * p["min_rr_ratio"])
    target = F.when(bull, c + reward).otherwise(c - reward)
    return (
        j.groupBy(*KEYS, "formed_ts", "direction", "zone_high", "zone_low")
        .agg(
            F.min(F.when(enter, F.struct("_rn", "ts", c.alias("entry_close"), stop.alias("stop"),
                                         target.alias("target"), "next_ts", "next_open",
                                         "next_high", "next_low"))).alias("_e"),
            F.min(F.when(blown, F.col("_rn"))).alias("_x"),
        )
        .where(F.col("_e").isNotNull() & (F.col("_x").isNull() | (F.col("_e._rn") < F.col("_x"))))
        .select(*KEYS, "formed_ts", "direction", "zone_high", "zone_low", "_e.ts", "_e.entry_close",
                "_e.stop", "_e.target", "_e.next_ts", "_e.next_open", "_e.next_high", "_e.next_low")
    )


def order_block_signals(
    bars: DataFrame, p: Mapping[str, Any], block_rows: int | None = None
) -> DataFrame:
    """Zone entries in the shape of the other signals."""
    return zone_entries(bars, p, block_rows).select(
        *KEYS, "ts", F.col("entry_close").alias("close"),
        F.when(F.col("direction") == "bull", 1).otherwise(-1).alias("side"),
        F.lit("MARKET").alias("entry_type"), F.lit("GTC").alias("tif"), _none().alias("entry_level"),
        "stop", "target", "next_ts", "next_open", "next_high", "next_low",
    )


register("ict_ob", Signal("ict", ORDER_BLOCK, None, {
    "ob_impulse_atr_mult": (0.6, 1.6, 0.2), "ob_max_age_bars": (12, 72, 6),
    "atr_window": (10, 24, 2), "atr_tp_mult": (2.0, 5.0, 0.5), "min_rr_ratio": (1.5, 4.0, 0.5),
    "sl_offset_ticks": (0, 4, 1)}, "next_open", table=order_block_signals))
