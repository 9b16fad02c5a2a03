"""Places of rows in a global order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlattice.llm.common import written


def with_places(rows: DataFrame, order: Sequence[Column], name: str = "place", group: str | None = None) -> DataFrame:
    """``rows`` with the place (from 1) of each row in ``order``, within ``group`` if one is named.

    The rows are cut into ranges of the order and written once; a window runs within a range, and
    what stands before it in its group comes from one row per range and group. ``order`` should end
    in a unique column, so that equal rows can be cut apart.
    """
    keys = [group] if group else []
    lead = [F.col(group).asc()] if group else []
    cut = written(rows.repartitionByRange(*lead, *order).withColumn("__range", F.spark_partition_id()))
    counts = cut.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__range").orderBy(*order)
    return (cut.withColumn("__at", F.row_number().over(within)).join(before, [*keys, "__range"])
            .withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before"))
