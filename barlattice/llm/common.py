"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.plans.lineage import settle as settled
from barlattice.plans.lineage import shared_folder
from barlattice.session import configure

#: Letters that count as one for equality: A-Z only, so that results do not depend on a locale.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word rules.
BLANK = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column) -> Column:
    """The text, with null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there.

    The rows are computed once, however many branches read them, and do not depend on executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_group_values(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int,
                      share: int = 1000) -> DataFrame:
    """Join one row per group to all rows of the group, without sending a large group to one task.

    At most ``share`` groups can hold more than ``total / share`` rows each, so the values of those
    groups are broadcast and their rows stay where they are; all other rows are shuffled by ``key``.
    """
    large = total // share
    hot = F.broadcast(groups.filter(F.col(size) > large))
    cold = groups.filter(F.col(size) <= large)
    known = hot.select(F.col(key).alias("_hot"))
    in_hot = rows.join(hot, key, "inner")
    rest = rows.join(F.broadcast(known), F.col(key) == F.col("_hot"), "left_anti").join(cold, key, "inner")
    return in_hot.unionByName(rest)
