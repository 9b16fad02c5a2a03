"""Window work over one long series without putting the series into one task.

A series (for example every 1-minute bar of one symbol) may hold a large share of all rows, so
``Window.partitionBy(symbol)`` would make one task do most of the job. Here a series is cut into
blocks of about ``block_rows`` consecutive rows. Each block is shipped together with the rows
just before (and, for ``lead``, just after) it that its windows look at, the windows run per
block, and the shipped-in rows are dropped again. One full shuffle, like a plain window, but
keyed by (series, block).

Where a block starts is known from row counts per calendar period, an aggregate with one row
per series and day. The per-series windows over *that* table are bounded by the calendar, not
by the data.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlattice.functions.exprs import DAY, period_of

BLOCK_ROWS = 16_384
_P, _LO, _OWN, _BLK, _RN = "_period", "_lo", "_own", "_block", "_rn"


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    back: int = 0,
    ahead: int = 0,
    block_rows: int | None = None,
    period_seconds: int = DAY,
    known: Sequence[Column] = (),
) -> DataFrame:
    """Rows of ``df`` plus their halo copies.

    Adds ``_block``, ``_own`` (true for the one original of each row) and ``_lo`` (rows of the
    series before this row's period). A block sees at least the ``back`` rows before its first
    row and the ``ahead`` rows after its last row.

    ``known`` are conditions of which a block must see the last row before it where they hold, and the
    ``back`` rows before that row, however far back it is. Rows between it and the halo may be absent.
    """
    keys = list(keys)
    size = block_rows or max(BLOCK_ROWS, 8 * back)
    rows = df.withColumn(_P, period_of(ts, period_seconds))
    by_period = Window.partitionBy(*keys).orderBy(_P)
    layout = (
        rows.groupBy(*keys, _P)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_k{i}") for i, c in enumerate(known)])
        .withColumn(_LO, F.sum("_n").over(by_period) - F.col("_n"))
        .withColumn("_mine", F.floor(F.col(_LO) / size).cast("long"))
    )
    last = F.floor((F.col(_LO) + F.col("_n") + F.lit(back - 1)) / size).cast("long")
    last = F.greatest(F.col("_mine"), last) if back else F.col("_mine")
    first = F.col("_mine")
    if ahead:
        near = F.min("_mine").over(by_period.rowsBetween(-ahead, -1))
        first = F.least(F.col("_mine"), F.coalesce(near, F.col("_mine")))
    targets = F.sequence(first, last)
    if known and back:
        # A period is needed up to the block of the first known period that begins ``back`` rows or more
        # after it, if one nearer by is known: until then that one is the last known of the blocks. The
        # windows run over the periods backwards.
        part, end = Window.partitionBy(*keys), F.max("_mine").over(Window.partitionBy(*keys))
        later = part.orderBy(-F.col(_LO))
        beyond = later.rangeBetween(Window.unboundedPreceding, -back)
        none = F.array().cast("array<bigint>")
        far = []
        layout = layout.withColumns({"_first": first, "_last": last})
        for i in range(len(known)):
            hit = F.when(F.col(f"_k{i}") > 0, F.col("_mine"))
            layout = layout.withColumns({
                f"_all{i}": F.count(hit).over(later.rowsBetween(Window.unboundedPreceding, 0)),
                f"_far{i}": F.struct(F.count(hit).over(beyond).alias("n"), F.last(hit, ignorenulls=True).over(beyond).alias("block"))})
            layout = layout.withColumn(f"_far{i}", F.lag(f"_far{i}").over(later))  # of the next period, which begins where this one ends
            upto = F.greatest("_mine", F.coalesce(F.col(f"_far{i}.block"), end))
            needed = F.col(f"_all{i}") > F.coalesce(F.col(f"_far{i}.n"), F.lit(0))
            far.append(F.when(needed, F.sequence("_mine", upto)).otherwise(none))
        targets = F.array_distinct(F.concat(F.sequence("_first", "_last"), *far))
    layout = layout.select(*keys, _P, _LO, "_mine", targets.alias("_targets"))
    return (
        rows.join(layout, [*keys, _P])
        .withColumn(_BLK, F.explode("_targets"))
        .withColumn(_OWN, F.col(_BLK) == F.col("_mine"))
        .drop(_P, "_mine", "_targets")
    )


class Frame:
    """Window specs of one opened series, handed to column builders."""

    def __init__(self, keys: Sequence[str], order: Sequence[str]):
        self.part = [*keys, _BLK]
        self.order = list(order)
        self.w = Window.partitionBy(*self.part).orderBy(*self.order)

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n - 1 rows before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def between(self, a: int, b: int) -> WindowSpec:
        return self.w.rowsBetween(a, b)


class Series:
    """Columns to be added to a table of series, with the row reach each of them needs.

    Columns are declared first; :meth:`frame` then opens the blocks once with a halo deep enough
    for the longest chain and adds all columns level by level, so a stack of indicators costs one
    shuffle. A column declared twice under the same name is computed once.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str] = ("symbol", "timeframe"),
        ts: str = "ts",
        tie: Sequence[str] = (),
        block_rows: int | None = None,
        period_seconds: int = DAY,
    ):
        self.df, self.keys, self.ts, self.tie = df, list(keys), ts, list(tie)
        self.block_rows, self.period_seconds = block_rows, period_seconds
        self._back = {c: 0 for c in df.columns} | {_RN: 0}
        self._ahead = dict(self._back)
        self._level = dict(self._back)
        self._from: dict[str, frozenset[str]] = {c: frozenset([c]) for c in df.columns} | {_RN: frozenset()}
        self._carried: list[str] = []  # inputs of recurrences
        self._steps: list[tuple[int, str, Callable[[Frame], Column]]] = []
        self._arrays: list[tuple[int, str, Callable[..., np.ndarray], list[str]]] = []

    def add(
        self,
        name: str,
        build: Callable[[Frame], Column] | Column,
        uses: Sequence[str],
        back: int = 0,
        ahead: int = 0,
    ) -> str:
        """Declare column ``name``: ``uses`` are the columns read, ``back`` / ``ahead`` the rows."""
        if name in self._level:
            return name
        self._level[name] = 1 + max((self._level[u] for u in uses), default=0)
        self._from[name] = frozenset().union(*[self._from[u] for u in uses])
        self._back[name] = back + max((self._back[u] for u in uses), default=0)
        self._ahead[name] = ahead + max((self._ahead[u] for u in uses), default=0)
        fn = build if callable(build) and not isinstance(build, Column) else (lambda _f, c=build: c)
        self._steps.append((self._level[name], name, fn))
        return name

    def arrays(self, name: str, fn: Callable[..., np.ndarray], uses: Sequence[str], back: int = 0) -> str:
        """Declare a double column that ``fn`` makes from the columns ``uses`` of a whole block.

        For what no window expression does well. Columns are float arrays in row order, NaN for null.
        """
        if name not in self._level:
            self.add(name, F.lit(None), uses, back)
            level = self._steps.pop()[0]
            self._arrays.append((level, name, fn, list(uses)))
        return name

    def lag(self, x: str, n: int = 1) -> str:
        return self.add(f"_{x}_lag{n}", lambda f: F.lag(x, n).over(f.w), [x], back=n)

    def lead(self, x: str, n: int = 1) -> str:
        return self.add(f"_{x}_lead{n}", lambda f: F.lead(x, n).over(f.w), [x], ahead=n)

    def roll(self, name: str, agg: Column, x: Sequence[str], n: int, min_rows: int | None = None) -> str:
        """Aggregate over the last n rows, null below ``min_rows`` non-null values of x[0]."""
        need = n if min_rows is None else min_rows

        def build(f: Frame) -> Column:
            w = f.rows(n)
            return F.when(F.count(x[0]).over(w) >= need, agg.over(w))

        return self.add(name, build, list(x), back=n - 1)

    def recurrence(self, name: str, x: str, keep: float, first: float | None = None) -> str:
        """y(t) = keep * y(t-1) + (1 - keep) * x(t), y = x at the first value (or ``first`` times x).

        Nulls of x keep y and let the old weight decay, as weighted means over gaps do: a value d
        rows after the one before it weighs 1 - keep against keep**d. Nulls before the first value
        stay null.

        Rows are numbered along the whole series and cut into runs of ``b`` rows with
        keep**b near 1e-6. Inside a run y is one scaled running sum; older rows enter through the
        ends of the three runs before it. What is left out weighs less than 1e-18. Behind a gap longer
        than that the new value stands alone, so all that must cross such a gap is the value that is
        held, which the last row with a value brings into every block (see :func:`with_halo`).
        """
        b = max(1, math.floor(math.log(1e6) / -math.log(keep)))
        run = F.floor((F.col(_RN) - 1) / b)
        here, before, at = f"_{name}_at", f"_{name}_prev", f"_{name}_y"
        gap, steps, part = f"_{name}_gap", f"_{name}_steps", f"_{name}_run"
        reach = self._back[x]

        def place(f: Frame) -> Column:
            """The row number where x is known; rows without the rows that x looks back on do not count."""
            whole = F.lag(_RN, reach).over(f.w) == F.col(_RN) - reach if reach else F.lit(True)
            return F.when(F.col(x).isNotNull() & ((F.col(_RN) <= reach) | whole), F.col(_RN))

        def in_run(f: Frame) -> WindowSpec:
            return Window.partitionBy(*f.part, run).orderBy(*f.order).rowsBetween(Window.unboundedPreceding, 0)

        def factor(c: Column, sign: int = 1) -> Column:
            """What is left of an old value after the (steps, gap) in ``c``, or its inverse."""
            return F.pow(F.lit(keep), sign * c["n"]) * F.exp(sign * c["log"])

        def joined(f: Frame) -> Column:
            w = Window.partitionBy(*f.part).orderBy(run)
            last = F.col(_RN) % b == 0
            carry = F.lit(0.0)
            for k in (3, 2, 1):
                ago = w.rangeBetween(-k, -k)
                end = F.coalesce(F.max(F.when(last, F.col(part))).over(ago), F.lit(0.0))
                left = F.coalesce(factor(F.max(F.when(last, F.col(steps))).over(ago)), F.lit(1.0))
                carry = end + left * carry
            y = F.coalesce(F.col(part), F.lit(0.0)) + factor(F.col(steps)) * carry
            return F.when(F.col(here).isNotNull(), y)

        self._carried.append(x)
        self.add(here, place, [x, _RN])
        self.add(before, lambda f: F.last(here, ignorenulls=True).over(
            f.w.rowsBetween(Window.unboundedPreceding, -1)), [here], back=4 * b)
        rows = F.col(_RN) - F.col(before)
        old = F.pow(F.lit(keep), rows)
        # a step without gap is the factor ``keep`` itself, so that series without nulls stay exact; a
        # gap so long that nothing is left counts as exp(-80)
        more = F.when(rows == 1, F.lit(0.0)).otherwise(F.coalesce(F.greatest(
            F.log(old / (old + F.lit(1.0 - keep))) - F.lit(math.log(keep)), F.lit(-80.0)), F.lit(-80.0)))
        follows = F.col(here).isNotNull() & F.col(before).isNotNull()
        self.add(gap, F.when(follows, more), [here, before])
        self.add(steps, lambda f: F.struct(
            F.count(gap).over(in_run(f)).alias("n"), F.coalesce(F.sum(gap).over(in_run(f)), F.lit(0.0)).alias("log")), [gap])
        weight = F.when(F.col(gap) == 0, F.lit(1.0 - keep)).otherwise(F.lit(1.0) - F.lit(keep) * F.exp(gap))
        weight = F.coalesce(weight, F.lit(1.0 if first is None else first))
        self.add(part, lambda f: factor(F.col(steps)) * F.sum(F.when(
            F.col(here).isNotNull(), weight * F.col(x) * factor(F.col(steps), -1))).over(in_run(f)), [steps, x])
        self.add(at, joined, [part, steps])
        return self.add(name, lambda f: F.last(at, ignorenulls=True).over(
            f.w.rowsBetween(Window.unboundedPreceding, 0)), [at])

    def ema(self, name: str, x: str, span: int) -> str:
        """Exponential mean with smoothing 2 / (span + 1), seeded by the first value."""
        if span <= 1:
            return self.add(name, F.col(x), [x])
        return self.recurrence(name, x, 1.0 - 2.0 / (span + 1.0))

    def frame(self) -> DataFrame:
        """All source and declared columns, one row per source row."""
        back, ahead = max(self._back.values()), max(self._ahead.values())
        sources = {self._from[x] for x in self._carried} - {frozenset()}
        known = [functools.reduce(operator.and_, [F.col(c).isNotNull() for c in sorted(cols)]) for cols in sorted(sources, key=sorted)]
        df = with_halo(
            self.df, self.keys, self.ts, back, ahead, self.block_rows, self.period_seconds, known
        )
        # periods may be missing between the rows shipped in, so rows are numbered from their period's start
        f = Frame(self.keys, [_LO, self.ts, *self.tie])
        period = F.rank().over(Window.partitionBy(*f.part).orderBy(_LO))
        df = df.withColumn(_RN, F.row_number().over(f.w) - period + 1 + F.col(_LO))
        for level in sorted({s[0] for s in (*self._steps, *self._arrays)}):
            df = df.withColumns({n: fn(f) for lv, n, fn in self._steps if lv == level})
            made = [a[1:] for a in self._arrays if a[0] == level]
            if made:
                df = _with_arrays(df, f.part, made)
        return df.where(_OWN).drop(_OWN, _BLK, _LO)

    def select(self, *columns: str | Column) -> DataFrame:
        """The frame reduced to the series keys, the timestamp and ``columns``."""
        return self.frame().select(*self.keys, self.ts, *columns)


def _with_arrays(df: DataFrame, part: Sequence[str], made: Sequence[tuple]) -> DataFrame:
    """``df`` with columns of doubles that numpy functions make from the rows of each block."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name, _, _ in made]])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by(_RN)
        for name, fn, uses in made:
            given = [np.asarray(block.column(u).cast(pa.float64()).to_numpy(), float) for u in uses]
            out = fn(*given)
            block = block.append_column(name, pa.array(out, pa.float64(), mask=np.isnan(out)))
        return block

    return df.groupBy(*part).applyInArrow(run, schema)


def running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    tie: Sequence[str] = (),
    period_seconds: int = DAY,
    parts: int = 1,
) -> DataFrame:
    """Running sum / max / last non-null over a whole series, computed per calendar period.

    ``sums``, ``maxes`` and ``lasts`` map output column to input column. Each period is first
    reduced to one row; the running value before a period comes from those rows and is put in
    front of the period, so no task holds more than one part of a period of one series. One part a
    day is enough for rows on a bar clock (at most 1,440 a day); for rows without such a bound, like
    fills, cut the period into more ``parts``. The rows are shuffled once.
    """
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    keys = list(keys)
    outs = [f"_c_{o}" for o in (*sums, *maxes, *lasts)]
    rows = df.withColumn(_P, period_of(ts, period_seconds // parts)).repartition(*keys, _P)
    # The last row is picked on (ts, ties): the tie columns complete the order.
    order = F.struct(ts, *tie)
    aggs = [
        *[F.sum(c).alias(f"_c_{o}") for o, c in sums.items()],
        *[F.max(c).alias(f"_c_{o}") for o, c in maxes.items()],
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_c_{o}")
            for o, c in lasts.items()
        ],
    ]

    def before(w: WindowSpec) -> list[Column]:
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return [
            *[F.coalesce(F.sum(f"_c_{o}").over(w), F.lit(0)).alias(f"_c_{o}") for o in sums],
            *[F.max(f"_c_{o}").over(w).alias(f"_c_{o}") for o in maxes],
            *[F.last(f"_c_{o}", ignorenulls=True).over(w).alias(f"_c_{o}") for o in lasts],
        ]

    totals = rows.groupBy(*keys, _P).agg(*aggs)
    carry = totals.select(*keys, _P, *before(Window.partitionBy(*keys).orderBy(_P)))
    part = [*keys, _P]
    out = rows.join(carry.select(*part, *outs), part)
    upto = Window.partitionBy(*part).orderBy(ts, *tie).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    added = {}
    for o, c in sums.items():
        added[o] = F.col(f"_c_{o}") + F.coalesce(F.sum(c).over(upto), F.lit(0))
    for o, c in maxes.items():
        added[o] = F.greatest(F.col(f"_c_{o}"), F.max(c).over(upto))
    for o, c in lasts.items():
        added[o] = F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_c_{o}"))
    return out.withColumns(added).drop(_P, *outs)
