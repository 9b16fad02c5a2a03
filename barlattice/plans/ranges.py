"""Extremes of a price path between two times, by doubling tables.

Two tables hold the highest high and lowest low of every stretch of 1, 2, 4, ... hours within a day
and of 1, 2, 4, ... whole days. Any range of hours or days is covered by two stretches of one length,
so it takes two equality lookups, however long it is. Bars are read for the hours of the two ends only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.functions.exprs import period_of

HOUR = 3600
HOUR_LEVELS, DAY_LEVELS = 5, 16  # 16 hours, and 2**15 days (89 years), are the longest stretches
_AT, _K, _TIER = "_at", "_k", "_tier"


def _log2(n: Column) -> Column:
    """Floor of the binary logarithm of a whole number, exact."""
    return F.length(F.bin(n)) - 1


def _hour_table(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches of 2**k hours that lie within one day; an hour is part of at most 31 of them."""
    h = F.pmod(F.col(_AT), F.lit(24))

    def of_level(k: int) -> Column:
        starts = F.sequence(F.greatest(h - (2 ** k - 1), F.lit(0)), F.least(h, F.lit(24 - 2 ** k)))
        return F.transform(starts, lambda start: F.struct(F.lit(k).alias(_K), (F.col(_AT) - h + start).alias(_AT)))

    stretches = F.flatten(F.array(*map(of_level, range(HOUR_LEVELS))))
    return (hours.select(*keys, "hi", "lo", F.explode(stretches).alias("_s")).select(*keys, "hi", "lo", "_s.*")
            .groupBy(*keys, F.lit(0).alias(_TIER), _K, _AT).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")))


def _day_table(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches of 2**k days from each day of a series, days without bars included.

    A level joins two stretches of the level below. A series is one row of its days meanwhile, whose
    size is bounded by the calendar.
    """
    days = hours.groupBy(*keys, F.floor(F.col(_AT) / 24).cast("long").alias(_AT)).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    every = days.groupBy(*keys).agg(F.min(_AT).alias("_a"), F.max(_AT).alias("_z")).select(
        *keys, F.explode(F.sequence("_a", "_z")).alias(_AT))
    series = every.join(days, [*keys, _AT], "left").groupBy(*keys).agg(
        F.min(_AT).alias("_a"), F.sort_array(F.collect_list(F.struct(_AT, "hi", "lo"))).alias("_d"))

    def joined(levels: Column, k: Column) -> Column:
        last = F.element_at(levels, -1)
        ahead = F.pow(F.lit(2), k).cast("int")
        level = F.transform(last, lambda x, i: F.struct(
            F.greatest(x["hi"], F.get(last, i + ahead)["hi"]).alias("hi"), F.least(x["lo"], F.get(last, i + ahead)["lo"]).alias("lo")))
        return F.concat(levels, F.array(level))

    first = F.array(F.transform("_d", lambda x: F.struct(x["hi"].alias("hi"), x["lo"].alias("lo"))))
    levels = F.aggregate(F.sequence(F.lit(0), F.lit(DAY_LEVELS - 2)), first, joined)
    return (series.select(*keys, "_a", F.posexplode(levels).alias(_K, "_l"))
            .select(*keys, "_a", _K, F.posexplode("_l").alias("_i", "_x"))
            .where(F.col("_x.hi").isNotNull() | F.col("_x.lo").isNotNull())
            .select(*keys, F.lit(1).alias(_TIER), _K, (F.col("_a") + F.col("_i")).alias(_AT), "_x.hi", "_x.lo"))


def _asked(tier: int, first: Column, last: Column) -> Column:
    """The two lookups that cover first to last, none if the range is empty."""
    k = _log2(last - first + 1)
    one = F.struct(F.lit(tier).alias(_TIER), k.alias(_K), first.alias(_AT))
    two = F.struct(F.lit(tier).alias(_TIER), k.alias(_K), (last - F.pow(F.lit(2), k).cast("long") + 1).alias(_AT))
    return F.when(last >= first, F.array_distinct(F.array(one, two))).otherwise(F.array().cast(f"array<struct<{_TIER}:int,{_K}:int,{_AT}:bigint>>"))


def extremes_between(
    spans: DataFrame, bars: DataFrame, on: Sequence[str], span_id: str, start: str, end: str,
) -> DataFrame:
    """``(span_id, max_high, min_low)`` over bars with start < ts <= end.

    A span makes at most six lookups in the doubling tables and reads the bars of the hours it begins
    and ends in. Spans without bars give no row. Bars without high or low count for the other one.
    """
    on = list(on)
    path = bars.select(*on, "ts", period_of("ts", HOUR).alias(_AT), F.col("high").cast("double").alias("hi"), F.col("low").cast("double").alias("lo"))
    hours = path.groupBy(*on, _AT).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    table = _hour_table(hours, on).unionByName(_day_table(hours, on))
    s = spans.where(F.col(start) < F.col(end)).select(
        *on, F.col(span_id).alias("_sid"), F.col(start).alias("_s"), F.col(end).alias("_e"),
        period_of(start, HOUR).alias("_a"), period_of(end, HOUR).alias("_z"))
    a, z = F.col("_a"), F.col("_z")
    day_a, day_z = F.floor(a / 24).cast("long"), F.floor(z / 24).cast("long")
    lookups = F.when(day_a == day_z, _asked(0, a + 1, z - 1)).otherwise(F.concat(
        _asked(0, a + 1, day_a * 24 + 23), _asked(0, day_z * 24, z - 1), _asked(1, day_a + 1, day_z - 1)))
    inner = (s.select(*on, "_sid", F.explode(lookups).alias("_l")).select(*on, "_sid", "_l.*")
             .join(table, [*on, _TIER, _K, _AT]).select("_sid", "hi", "lo"))
    edge = (s.withColumn(_AT, F.explode(F.array_distinct(F.array("_a", "_z")))).join(path, [*on, _AT])
            .where((F.col("ts") > F.col("_s")) & (F.col("ts") <= F.col("_e"))).select("_sid", "hi", "lo"))
    return (inner.unionByName(edge).groupBy("_sid").agg(F.max("hi").alias("max_high"), F.min("lo").alias("min_low"))
            .withColumnRenamed("_sid", span_id))
