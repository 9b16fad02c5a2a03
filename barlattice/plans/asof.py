"""As-of joins and forward fills that never gather one series in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.exprs import DAY, MICROS, micros

_P, _T, _ORD, _V = "_part", "_t", "_ord", "_v"


def asof(
    probes: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    probe_ts: str,
    fact_ts: str,
    values: dict[str, str],
    forward: bool = False,
    strict: bool = False,
    period_seconds: int = DAY,
    parts: int = 24,
) -> DataFrame:
    """Attach to each probe the last fact at or before it (``forward``: first at or after it).

    ``values`` maps fact column to output column. ``strict`` excludes equal timestamps. Facts need
    unique (key, timestamp). A probe without key or time gets null.

    Facts and the distinct times of the probes are stacked and shuffled once, by key and part of a
    period (``period_seconds / parts``). What a part inherits from earlier ones comes from one row
    per key and part. The answers, one row per key and time, are then joined to the probes, so
    probes that share a time are never one window; Spark splits their partition if it is skewed.
    Facts are read once and probes twice.
    """
    on = list(on)
    sign = -1 if forward else 1
    width = float(period_seconds * MICROS // parts)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn(_P, F.floor(F.col(_T) / F.lit(width)).cast("long"))

    value = F.struct(*[F.col(c).alias(o) for c, o in values.items()])
    known = facts.select(*on, (micros(fact_ts) * sign).alias(_T), value.alias(_V))
    asked = probes.withColumn(_T, micros(probe_ts) * sign)
    times = asked.select(*on, _T).distinct()
    none = F.lit(None).cast(known.schema[_V].dataType)
    stacked = placed(
        known.select(*on, _T, F.lit(1).alias(_ORD), _V)
        .unionByName(times.select(*on, _T, F.lit(0 if strict else 2).alias(_ORD), none.alias(_V)))
    ).repartition(*on, _P)
    # the last fact of each part, and from it what the next parts inherit
    ends = stacked.groupBy(*on, _P).agg(F.max_by(_V, F.when(F.col(_V).isNotNull(), F.col(_T))).alias("_last"))
    earlier = Window.partitionBy(*on).orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*on, _P, F.last("_last", ignorenulls=True).over(earlier).alias("_from"))
    upto = Window.partitionBy(*on, _P).orderBy(_T, _ORD).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    answers = (
        stacked.join(ends, [*on, _P])
        .withColumn("_found", F.coalesce(F.last(_V, ignorenulls=True).over(upto), F.col("_from")))
        .where(F.col(_ORD) != 1)
        .select(*on, _T, F.col("_found").alias(_V))
    )
    return asked.join(answers, [*on, _T], "left").select(
        *probes.columns, *[F.col(f"{_V}.{o}").alias(o) for o in values.values()])
