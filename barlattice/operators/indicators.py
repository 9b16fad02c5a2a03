"""Indicators as columns declared on a Series; each returns the name of its column.

Calling one twice with the same parameters adds the column once, so signals that share an ATR or
a mean share the work. Windows with fewer rows than asked give null unless stated otherwise.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions import kalman
from barlattice.functions.exprs import falsy, over_zero, truthy
from barlattice.functions.order_stats import rolling_quantile, rolling_rank
from barlattice.functions.probability import adf_p
from barlattice.operators.bars import daily_close, slow_last
from barlattice.plans.asof import asof
from barlattice.plans.blocks import Series
from barlattice.plans.prefix import prefix_scan
from barlattice.plans.salt import join_small

EPS = 1e-9
IBS_FLOOR = 1e-5
KEYS = ["symbol", "timeframe"]


def sma(s: Series, n: int, x: str = "close") -> str:
    return s.roll(f"sma_{x}_{n}", F.avg(x), [x], n)


def ema(s: Series, span: int, x: str = "close") -> str:
    return s.ema(f"ema_{x}_{span}", x, span)


def true_range(s: Series) -> str:
    prev = s.lag("close")
    return s.add(
        "tr",
        F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - F.col(prev)),
            F.abs(F.col("low") - F.col(prev)),
        ),
        ["high", "low", prev],
    )


def atr(s: Series, span: int = 14) -> str:
    return s.ema(f"atr_{span}", true_range(s), span)


def vol_percentile(s: Series, regime: int, history: int) -> str:
    """Percent rank of the current close deviation among the last ``history`` deviations."""
    vol = s.roll(f"_vol_{regime}", F.stddev_samp("close"), ["close"], regime, regime // 2)
    rank = partial(rolling_rank, n=history, need=max(1, history // 2))
    return s.arrays(f"vol_pct_{regime}_{history}", rank, [vol], back=history - 1)


def vol_regime(
    s: Series, regime: int = 50, history: int = 500, low: float = 0.2, high: float = 0.8
) -> tuple[str, str]:
    """Previous bar's volatility percentile and whether it permits trading (unknown permits)."""
    pct = s.lag(vol_percentile(s, regime, history))
    ok = s.add(
        f"vol_ok_{regime}_{history}_{low}_{high}".replace(".", "_"),
        truthy((F.col(pct) >= low) & (F.col(pct) <= high)), [pct],
    )
    return pct, ok


def shock(
    s: Series, span: int = 14, gap: float = 1.0, rng: float = 2.5, change: float = 1.75
) -> dict[str, str]:
    """Gap, range and close change in units of the previous ATR, and the allow flag."""
    ref, prev = s.lag(atr(s, span)), s.lag("close")
    d = F.nullif(F.col(ref), F.lit(0.0))
    g = s.add(f"gap_atr_{span}", F.abs(F.col("open") - F.col(prev)) / d, ["open", prev, ref])
    r = s.add(f"range_atr_{span}", F.abs(F.col("high") - F.col("low")) / d, ["high", "low", ref])
    c = s.add(f"change_atr_{span}", F.abs(F.col("close") - F.col(prev)) / d, ["close", prev, ref])
    calm = (F.col(g) <= gap) & (F.col(r) <= rng) & (F.col(c) <= change)
    ok = s.add(
        f"shock_ok_{span}_{gap}_{rng}_{change}".replace(".", "_"),
        F.when(F.col(ref).isNull(), True).otherwise(falsy(calm)), [g, r, c, ref],
    )
    return {"gap_atr": g, "range_atr": r, "change_atr": c, "allowed": ok}


def stretch(
    s: Series, base: int = 20, span: int = 14, max_long: float = 1.75, max_short: float = 1.75
) -> dict[str, str]:
    """Distance of the close from its exponential mean in units of the previous ATR, and gates."""
    ref, mean = s.lag(atr(s, span)), ema(s, base)
    x = s.add(
        f"stretch_{base}_{span}",
        (F.col("close") - F.col(mean)) / F.nullif(F.col(ref), F.lit(0.0)), ["close", mean, ref],
    )
    tag = f"{base}_{span}_{max_long}_{max_short}".replace(".", "_")
    known = F.col(ref).isNotNull()
    lo = s.add(f"stretch_long_ok_{tag}", ~known | falsy(F.col(x) <= max_long), [x, ref])
    sh = s.add(f"stretch_short_ok_{tag}", ~known | falsy(F.col(x) >= -max_short), [x, ref])
    return {"stretch": x, "long_ok": lo, "short_ok": sh}


def trend_t(s: Series, n: int, max_t: float = 2.0) -> tuple[str, str]:
    """Previous bar's slope statistic of the close on the bar number, and the gate |t| < max.

    Each bar's residual comes from its own window's line; the residual variance rolls over those.
    """
    half = n // 2
    var_t = s.roll(f"_var_t_{n}", F.var_samp("_rn"), ["_rn"], n, half)
    cov = s.roll(f"_cov_t_{n}", F.covar_samp("close", "_rn"), ["close", "_rn"], n, half)
    m_p = s.roll(f"_mean_p_{n}", F.avg("close"), ["close"], n, half)
    m_t = s.roll(f"_mean_t_{n}", F.avg("_rn"), ["_rn"], n, half)
    slope = s.add(f"_slope_t_{n}", over_zero(F.col(cov), F.col(var_t)), [cov, var_t])
    res = s.add(
        f"_res_t_{n}",
        F.col("close") - (F.col(m_p) + F.col(slope) * (F.col("_rn") - F.col(m_t))),
        ["close", m_p, slope, m_t],
    )
    res_var = s.roll(f"_res_var_{n}", F.var_samp(res), [res], n, half)
    se = F.sqrt(F.greatest(over_zero(F.col(res_var), (n - 1) * F.col(var_t)), F.lit(0.0)))
    t = s.add(
        f"_t_raw_{n}",
        F.when(F.col(res_var).isNull(), None)
        .when((se == 0) & (F.col(slope) != 0), F.signum(slope) * float("inf"))
        .otherwise(over_zero(F.col(slope), se)),
        [res_var, slope, var_t],
    )
    prev = s.lag(t)
    ok = s.add(f"trend_ok_{n}", truthy(F.abs(prev) < max_t), [prev])
    return prev, ok


def half_life(
    s: Series, n: int = 100, max_half_life: float = 50.0, lam: float | None = 1e-4,
    cap: float | None = 500.0,
) -> tuple[str, str]:
    """Previous bar's mean-reversion half-life and the gate 0 < half-life <= max (unknown blocks)."""
    prev = s.lag("close")
    dy = s.add("_dy", F.col("close") - F.col(prev), ["close", prev])
    var = s.roll(f"_hl_var_{n}", F.var_samp(prev), [prev], n, n // 2)
    cov = s.roll(f"_hl_cov_{n}", F.covar_samp(prev, dy), [prev, dy], n, n // 2)
    slope = over_zero(F.col(cov), F.col(var))
    raw = F.lit(-math.log(2.0)) / F.nullif(slope, F.lit(0.0))
    hl = F.when(slope < -(abs(lam) if lam is not None else 1e-8),
                raw if cap is None else F.least(raw, F.lit(float(cap))))
    now = s.add(f"_hl_{n}", hl, [var, cov])
    out = s.lag(now)
    ok = s.add(f"hl_ok_{n}", falsy((F.col(out) > 0) & (F.col(out) <= max_half_life)), [out])
    return out, ok


def unit_root_tau(s: Series, n: int, x: str = "close") -> str:
    """t statistic of the lagged level over the ``n`` values before each row, one lagged difference, constant.

    The regression of the change d on the level l and the change z before it needs no more than the six
    rolling (co)variances, so it is solved in column arithmetic. Null where a value is missing, the
    window is flat or the line fits exactly.
    """
    level = s.lag(x)
    d = s.add(f"_ur_d_{x}", F.col(x) - F.col(level), [x, level])
    z = s.lag(d)
    rows = n - 2

    def solved(f) -> Column:
        w = f.between(-rows, -1)
        ll, lz, zz, ld, zd, dd = (F.covar_pop(a, b).over(w) * rows for a, b in (
            (level, level), (level, z), (z, z), (level, d), (z, d), (d, d)))
        det = F.nullif(ll * zz - lz * lz, F.lit(0.0))
        slope, other = (zz * ld - lz * zd) / det, (ll * zd - lz * ld) / det
        variance = (dd - slope * ld - other * zd) / F.lit(rows - 3) * zz / det
        return F.when((F.count(z).over(w) == rows) & (F.count(d).over(w) == rows) & (variance > 0), slope / F.sqrt(variance))

    return s.add(f"_ur_tau_{x}_{n}", solved, [level, d, z], back=rows)


def adf(
    bars: DataFrame, n: int = 72, seconds: int = 3600, max_p: float = 0.05,
    block_rows: int | None = None,
) -> DataFrame:
    """Bars with the previous bar's unit-root p-value of a slower close series, and the gate."""
    slow = Series(slow_last(bars, "close", seconds), ts="slow_ts", block_rows=block_rows)
    p = slow.select(adf_p(F.col(unit_root_tau(slow, n))).alias("_p"))
    s = Series(asof(bars, p, KEYS, "ts", "slow_ts", {"_p": "_p"}), block_rows=block_rows)
    s.lag("_p")
    return (
        s.frame()
        .withColumn("adf_pvalue", F.col("__p_lag1"))
        .withColumn("adf_ok", falsy(F.col("adf_pvalue") < max_p))
        .drop("_p", "__p_lag1", "_rn")
    )


def kalman_beta(
    x: DataFrame, y: DataFrame, q_var: float = 1e-5, r_var: float = 1e-1,
    block_rows: int | None = None,
) -> DataFrame:
    """Time-varying slope of y on x per pair: random-walk intercept and slope, previous estimate.

    ``x`` and ``y`` have (pair_id, ts, close). Both are divided by the pair's first x.
    """
    both = x.select("pair_id", "ts", F.col("close").cast("double").alias("x")).join(
        y.select("pair_id", "ts", F.col("close").cast("double").alias("y")), ["pair_id", "ts"]
    )
    first = both.groupBy("pair_id").agg(F.min_by("x", "ts").alias("_f"), F.min("ts").alias("_start"))
    scaled = join_small(both, first, ["pair_id"]).withColumn("_f", F.when(F.col("_f") == 0, 1.0).otherwise(F.col("_f")))

    return prefix_scan(
        scaled, ["pair_id"], "ts", partial(kalman.summarise, q_var=q_var, r_var=r_var), kalman.SUMMARY,
        kalman.begin, kalman.advance, kalman.STATE, partial(kalman.run, q_var=q_var, r_var=r_var),
        "pair_id string, ts timestamp_ntz, beta double", block_rows,
    )


def candle_shape() -> dict[str, Column]:
    """Body and wick shares of the bar range; 0 for a bar without range."""
    rng = F.nullif(F.abs(F.col("high") - F.col("low")), F.lit(0.0))

    def share(x: Column) -> Column:
        return F.coalesce(x / rng, F.lit(0.0))

    zero = F.lit(0.0)
    return {
        "body_fraction": share(F.abs(F.col("close") - F.col("open"))),
        "upper_wick_fraction": share(F.greatest(F.col("high") - F.greatest("open", "close"), zero)),
        "lower_wick_fraction": share(F.greatest(F.least("open", "close") - F.col("low"), zero)),
    }


def diamond(
    s: Series, window: int, trend: int, atr_span: int = 14, min_slope: float = 0.15,
    max_contraction: float = 0.75, min_height: float = 2.5,
) -> dict[str, str]:
    """Expanding then contracting range with a trend before it."""
    n = max(8, int(window))
    h = max(4, n // 2)
    a = atr(s, atr_span)

    def over(agg: Column, lo: int, hi: int):
        return lambda f: agg.over(f.between(lo, hi))

    def part(name: str, agg: Column, x: list[str], lo: int, hi: int) -> str:
        return s.add(f"_dm_{name}", over(agg, lo, hi), [*x, "_rn"], back=-lo)

    first, second = (-(n - 1), -(n - h)), (-(n - h) + 1, 0)
    c: dict[str, str] = {}
    for tag, (lo, hi) in (("1", first), ("2", second), ("a", (-(n - 1), 0))):
        c["hi" + tag] = part("hi" + tag, F.max("high"), ["high"], lo, hi)
        c["lo" + tag] = part("lo" + tag, F.min("low"), ["low"], lo, hi)
    for tag, (lo, hi) in (("1", first), ("2", second)):
        c["sh" + tag] = part("sh" + tag, F.regr_slope("high", "_rn"), ["high"], lo, hi)
        c["sl" + tag] = part("sl" + tag, F.regr_slope("low", "_rn"), ["low"], lo, hi)
    back = (-(n - 1) - trend, -n)
    c["ts"] = part("ts", F.regr_slope("close", "_rn"), ["close"], *back)
    c["tn"] = part("tn", F.count("close"), ["close"], *back)

    g = {k: F.col(v) for k, v in c.items()}
    full = (F.col("_rn") >= n) & (F.col(a) > 0)
    steep = F.col(a) * min_slope / h
    shape = (
        full
        & (g["sh1"] > steep) & (g["sl1"] < -steep) & (g["sh2"] < -steep) & (g["sl2"] > steep)
        & (g["hi2"] - g["lo2"] <= (g["hi1"] - g["lo1"]) * max_contraction)
        & (g["hia"] - g["loa"] >= F.col(a) * min_height)
        & (g["tn"] >= max(4, trend // 2))
    )
    uses = [*c.values(), a]
    return {
        "top_pattern": s.add("top_pattern", falsy(shape & (g["ts"] > steep * 0.5)), uses),
        "bottom_pattern": s.add("bottom_pattern", falsy(shape & (g["ts"] < -steep * 0.5)), uses),
        "upper_boundary": s.add("upper_boundary", F.when(full, g["hi2"]), uses),
        "lower_boundary": s.add("lower_boundary", F.when(full, g["lo2"]), uses),
        "pattern_height": s.add("pattern_height", F.when(full, g["hia"] - g["loa"]), uses),
    }


def structure(s: Series, window: int) -> tuple[str, str]:
    """Previous swing low above, and swing high below, the one half a window earlier."""
    n = max(2, int(window))
    step = max(1, n // 2)
    lo = s.lag(s.roll(f"_min_low_{n}", F.min("low"), ["low"], n))
    hi = s.lag(s.roll(f"_max_high_{n}", F.max("high"), ["high"], n))
    lo0, hi0 = s.lag(lo, step), s.lag(hi, step)
    return (
        s.add(f"higher_lows_{n}", falsy(F.col(lo) > F.col(lo0)), [lo, lo0]),
        s.add(f"lower_highs_{n}", falsy(F.col(hi) < F.col(hi0)), [hi, hi0]),
    )


def range_levels(s: Series, n: int, shift: int = 1) -> dict[str, str]:
    """Highest high and lowest low of n bars ending ``shift`` bars ago."""

    def level(agg: Column, x: str):
        def build(f) -> Column:
            w = f.between(-(n - 1 + shift), -shift)
            return F.when(F.count(x).over(w) >= n, agg.over(w))

        return build

    r = s.add(f"resistance_{n}_{shift}", level(F.max("high"), "high"), ["high"], back=n - 1 + shift)
    u = s.add(f"support_{n}_{shift}", level(F.min("low"), "low"), ["low"], back=n - 1 + shift)
    h = s.add(f"height_{n}_{shift}", F.col(r) - F.col(u), [r, u])
    return {"resistance": r, "support": u, "height": h}


def _bands(s: Series, tag: str, mid: str, half: Column, uses: list[str]) -> dict[str, str]:
    up = s.add(f"{tag}_upper", F.col(mid) + half, uses)
    lo = s.add(f"{tag}_lower", F.col(mid) - half, uses)
    width = s.add(f"{tag}_width", F.col(up) - F.col(lo), [up, lo])
    norm = s.add(
        f"{tag}_norm_width", F.col(width) / F.greatest(F.abs(F.col(mid)), F.lit(EPS)), [width, mid]
    )
    return {"middle": mid, "upper": up, "lower": lo, "width": width, "norm_width": norm}


def bollinger(s: Series, n: int = 20, k: float = 2.0) -> dict[str, str]:
    mid = sma(s, n)
    dev = s.roll(f"_dev_{n}", F.stddev_samp("close"), ["close"], n)
    return _bands(s, f"bb_{n}_{k}".replace(".", "_"), mid, F.col(dev) * float(k), [mid, dev])


def keltner(s: Series, span: int = 20, atr_span: int = 20, k: float = 1.5) -> dict[str, str]:
    mid, a = ema(s, span), atr(s, atr_span)
    return _bands(s, f"kc_{span}_{atr_span}_{k}".replace(".", "_"), mid, F.col(a) * float(k), [mid, a])


def volume_ratio(s: Series, n: int = 20) -> str:
    base = s.roll(f"_vol_mean_{n}", F.avg("volume"), ["volume"], n)
    return s.add(f"volume_ratio_{n}", over_zero(F.col("volume"), F.col(base)), ["volume", base])


def poc(s: Series, n: int = 20) -> str:
    """Volume-weighted close of the last n bars."""
    pv = s.add("_pv", F.col("close") * F.col("volume"), ["close", "volume"])
    num = s.roll(f"_pv_sum_{n}", F.sum(pv), [pv], n)
    den = s.roll(f"_v_sum_{n}", F.sum("volume"), ["volume"], n)
    return s.add(f"poc_{n}", over_zero(F.col(num), F.col(den)), [num, den])


def compression(
    s: Series, width: str, lookback: int, q: float, memory: int = 5, expand: float = 1.05
) -> dict[str, str]:
    """Width at or below its rolling quantile, such a bar within memory, and width growing now."""
    need = min(lookback, max(5, lookback // 2))
    tag = f"{width}_{lookback}_{q}".replace(".", "_")
    limit = s.arrays(f"_lim_{tag}", partial(rolling_quantile, n=lookback, need=need, q=q), [width], back=lookback - 1)
    tight = s.add(f"_tight_{tag}", falsy(F.col(width) <= F.col(limit)), [width, limit])
    recent = s.add(
        f"_recent_{tag}_{memory}",
        lambda f: F.coalesce(F.max(tight).over(f.between(-memory, -1)), F.lit(False)),
        [tight], back=memory,
    )
    prev = s.lag(width)
    grow = s.add(f"_grow_{tag}_{expand}".replace(".", "_"),
                 falsy(F.col(width) > F.col(prev) * float(expand)), [width, prev])
    return {"threshold": limit, "compressed": tight, "recent": recent, "expanding": grow}


def fractal_levels(s: Series, n: int) -> dict[str, str]:
    """Highest confirmed 3-bar high pivot and lowest low pivot with centre 1..n bars ago."""
    hp, hn = s.lag("high"), s.lead("high")
    lp, ln = s.lag("low"), s.lead("low")
    top = s.add("_pivot_high", F.when((F.col("high") > F.col(hp)) & (F.col("high") > F.col(hn)),
                                      F.col("high")), ["high", hp, hn])
    bot = s.add("_pivot_low", F.when((F.col("low") < F.col(lp)) & (F.col("low") < F.col(ln)),
                                     F.col("low")), ["low", lp, ln])
    return {
        "high": s.add(f"fractal_high_{n}", lambda f: F.max(top).over(f.between(-n, -1)), [top], back=n),
        "low": s.add(f"fractal_low_{n}", lambda f: F.min(bot).over(f.between(-n, -1)), [bot], back=n),
    }


def ibs() -> Column:
    """Position of the close inside the bar."""
    return (F.col("close") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(IBS_FLOOR))


def log_return(s: Series) -> str:
    prev = s.lag("close")
    ratio = over_zero(F.col("close"), F.col(prev))
    return s.add("log_ret", F.when(ratio > 0, F.log(ratio)), ["close", prev])


def realized_vol(s: Series, n: int) -> str:
    ret = log_return(s)
    return s.roll(f"realized_vol_{n}", F.stddev_samp(ret), [ret], n)


def daily_regime(bars: DataFrame, n: int = 50) -> DataFrame:
    """Bars with ``regime``: previous trading day's close above its n-day mean (null if unknown).

    The windows run over one row per series and day.
    """
    w = Window.partitionBy(*KEYS).orderBy("day")
    last = w.rowsBetween(-(n - 1), 0)
    mean = F.when(F.count("close").over(last) >= n, F.avg("close").over(last))
    day = (
        daily_close(bars)
        .withColumn("_bull", F.when(mean.isNull(), F.lit(False)).otherwise(F.col("close") > mean))
        .withColumn("regime", F.lag("_bull").over(w))
        .select(*KEYS, "day", "regime")
    )
    return bars.withColumn("day", F.to_date("ts")).join(day, [*KEYS, "day"], "left").drop("day")
