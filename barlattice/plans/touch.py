"""Searches along a price path: first bar that reaches a level, days that span two levels.

Both use bar extremes per day and per 32-day bucket, so a search that runs over years reads a few
small arrays instead of all bars in between, without any limit on how far it may run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.functions.exprs import period_of

_D, _M, _A = "_d", "_m", "_salt"
SPAN = 32  # days per bucket
SALTS = 16  # copies of the one-row-per-series table; spreads the probes of a hot series


def _daily(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        bars.groupBy(*keys, period_of("ts").alias(_D))
        .agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
        .withColumn(_M, F.floor(F.col(_D) / SPAN).cast("long"))
    )


def first_touch(
    probes: DataFrame,
    bars: DataFrame,
    on: Sequence[str],
    probe_id: str,
    probe_ts: str,
    up: str,
    down: str,
    carry: Sequence[str],
    prefix: str = "hit_",
    path: DataFrame | None = None,
) -> DataFrame:
    """First bar strictly after ``probe_ts`` with high >= ``up`` or low <= ``down``.

    A null level is never reached. Returns every probe with the bar columns ``carry`` (plus
    ``ts``) under ``prefix``, null when no later bar reaches a level. ``probe_id`` must be unique.
    ``path`` gives plain bars for the extremes when ``bars`` is costly to derive.
    """
    on = list(on)
    names = list(dict.fromkeys(["ts", "high", "low", *carry]))
    daily = _daily(path if path is not None else bars, on)
    days = daily.groupBy(*on, _M).agg(
        F.sort_array(F.collect_list(F.struct(_D, "hi", "lo"))).alias("_days")
    )
    buckets = (
        daily.groupBy(*on, _M)
        .agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        .groupBy(*on)
        .agg(F.sort_array(F.collect_list(F.struct(_M, "hi", "lo"))).alias("_buckets"))
        .withColumn(_A, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )

    def reached(x: Column) -> Column:
        return F.coalesce(x["hi"] >= F.col(up), F.lit(False)) | F.coalesce(
            x["lo"] <= F.col(down), F.lit(False)
        )

    def first_after(array: str, field: str, start: Column) -> Column:
        return F.get(F.filter(array, lambda x: (x[field] > start) & reached(x)), F.lit(0))[field]

    p = (
        probes.select(F.struct("*").alias("_probe"), *on, probe_id, probe_ts, up, down)
        .withColumn(_D, period_of(probe_ts))
        .withColumn(_M, F.floor(F.col(_D) / SPAN).cast("long"))
        .withColumn(_A, F.pmod(F.xxhash64(probe_id), F.lit(SALTS)).cast("int"))
        .join(days, [*on, _M], "left")
        .withColumn("_day", first_after("_days", _D, F.col(_D)))
        .drop("_days")
        .join(buckets, [*on, _A], "left")
        .withColumn("_next", F.when(F.col("_day").isNull(), first_after("_buckets", _M, F.col(_M))))
        .drop("_buckets", _M)
        .join(days.withColumnRenamed(_M, "_next"), [*on, "_next"], "left")
        .withColumn(
            "_day",
            F.coalesce("_day", first_after("_days", _D, F.lit(-1).cast("long") * F.lit(10**9))),
        )
        .drop("_days", "_next")
        .withColumn(_D, F.explode(F.array_distinct(F.array_compact(F.array(_D, "_day")))))
    )
    b = bars.select(
        *on, period_of("ts").alias(_D), F.struct(*names).alias("_bar")
    )
    later = (F.col("_bar.ts") > F.col(probe_ts)) & (
        F.coalesce(F.col("_bar.high") >= F.col(up), F.lit(False))
        | F.coalesce(F.col("_bar.low") <= F.col(down), F.lit(False))
    )
    bp = b.select(*[F.col(k).alias(f"_b_{k}") for k in (*on, _D)], "_bar")
    cond = later
    for k in (*on, _D):
        cond = cond & (F.col(k) == F.col(f"_b_{k}"))
    hit = (
        p.join(bp, cond, "left")
        .groupBy(F.col(probe_id).alias("_pid"))
        .agg(
            F.min_by("_bar", F.col("_bar.ts")).alias("_bar"),
            F.any_value("_probe").alias("_probe"),
        )
    )
    keep = list(dict.fromkeys(["ts", *carry]))
    return hit.select(
        "_probe.*", *[F.col(f"_bar.{c}").alias(f"{prefix}{c}") for c in keep]
    )


def matching_bars(
    probes: DataFrame,
    bars: DataFrame,
    on: Sequence[str],
    probe_ts: str,
    top: str,
    bottom: str,
    carry: Sequence[str],
    prefix: str,
) -> DataFrame:
    """Bars after ``probe_ts`` on days that reach up to ``top`` and down to ``bottom``.

    One row per probe and bar of such a day; probes without one are absent. Days are found through
    the same two levels of extremes as :func:`first_touch`.
    """
    on = list(on)
    daily = _daily(bars, on)

    def spans(x: Column) -> Column:
        return (x["hi"] >= F.col(top)) & (x["lo"] <= F.col(bottom))

    days = daily.groupBy(*on, _M).agg(F.collect_list(F.struct(_D, "hi", "lo")).alias("_days"))
    buckets = (
        daily.groupBy(*on, _M)
        .agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        .groupBy(*on)
        .agg(F.collect_list(F.struct(_M, "hi", "lo")).alias("_buckets"))
        .withColumn(_A, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    day = period_of(probe_ts)
    found = (
        probes.withColumn(_A, F.pmod(F.xxhash64(probe_ts, top, bottom), F.lit(SALTS)).cast("int"))
        .join(buckets, [*on, _A])
        .withColumn(_M, F.explode(F.transform(
            F.filter("_buckets", lambda x: (x[_M] >= F.floor(day / SPAN)) & spans(x)), lambda x: x[_M])))
        .drop("_buckets", _A)
        .join(days, [*on, _M])
        .withColumn(_D, F.explode(F.transform(
            F.filter("_days", lambda x: (x[_D] >= day) & spans(x)), lambda x: x[_D])))
        .drop("_days", _M)
    )
    b = bars.select(*on, period_of("ts").alias(_D), *[F.col(c).alias(f"{prefix}{c}") for c in carry])
    return found.join(b, [*on, _D]).where(F.col(f"{prefix}ts") > F.col(probe_ts)).drop(_D)
