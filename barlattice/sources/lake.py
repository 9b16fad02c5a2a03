"""The bar lake: reading, saving, inventory, freshness, merging and planning of missing ranges.

One table partitioned by symbol and timeframe; filters on those prune directories, filters on the
timestamp reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlattice.schemas import BARS

KEYS = ["symbol", "timeframe"]

# Cached timeframes, staleness limit, planner slacks.
TIMEFRAMES = ["1m", "5m", "30m", "1h"]
MAX_STALENESS_DAYS = 10
HEAD_SLACK_DAYS, TAIL_SLACK_DAYS, MAX_YEARS = 2, 7, 5
DIGEST_CHARS = 16


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BARS).parquet(root)


def _between(ts: Column, start: str | dt.datetime | None, end: str | dt.datetime | None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ts >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (ts <= F.lit(str(end)).cast("timestamp_ntz"))
    return cond


def load(
    lake: DataFrame, symbol: str, timeframe: str = "5m", start: str | dt.datetime | None = None,
    end: str | dt.datetime | None = None,
) -> DataFrame:
    """One series with inclusive bounds in time order."""
    return lake.where(
        (F.col("symbol") == symbol) & (F.col("timeframe") == timeframe) & _between(F.col("ts"), start, end)
    ).orderBy("ts")


def load_timeframes(lake: DataFrame, symbol: str, timeframes: Sequence[str] = TIMEFRAMES) -> DataFrame:
    return lake.where((F.col("symbol") == symbol) & F.col("timeframe").isin(list(timeframes)))


def save(bars: DataFrame, root: str) -> bool:
    """Replace the series present in ``bars``; nothing happens when it is empty.

    Rows are range-partitioned by series and time, so a long series becomes several sorted files.
    """
    if bars.isEmpty():
        return False
    spark = bars.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (bars.repartitionByRange(*KEYS, "ts").sortWithinPartitions(*KEYS, "ts")
     .write.mode("overwrite").partitionBy(*KEYS).parquet(root))
    return True


def list_symbols(lake: DataFrame) -> DataFrame:
    return lake.select("symbol").distinct().orderBy("symbol")


def inventory(
    lake: DataFrame, timeframes: Sequence[str] = TIMEFRAMES, symbols: Sequence[str] | None = None
) -> DataFrame:
    """Existence, bar count and span of every (symbol, timeframe), also of absent ones."""
    base = lake.select("symbol").distinct()
    if symbols is not None:
        base = lake.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"))
    grid = base.withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in timeframes])))
    have = lake.groupBy(*KEYS).agg(
        F.count("*").alias("bars"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return grid.join(have, KEYS, "left").withColumn("exists", F.col("bars").isNotNull())


def _files(spark: SparkSession, root: str) -> DataFrame:
    """One row per data file of a lake, from its listing: no file is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(root)
    return found.select(*[F.col(k).cast("string").alias(k) for k in KEYS], "length", "modificationTime")


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Megabytes per series of a saved lake, from the listing."""
    return _files(spark, root).groupBy(*KEYS).agg((F.sum("length") / F.lit(1024.0 * 1024.0)).alias("size_mb"))


def freshness(lake: DataFrame, as_of: str | dt.datetime, max_days: int = MAX_STALENESS_DAYS) -> DataFrame:
    """Latest bar and status of every series at ``as_of``."""
    return _status(lake.groupBy(*KEYS).agg(F.max("ts").alias("last_ts")), as_of, max_days)


def _status(rows: DataFrame, as_of: str | dt.datetime, max_days: int) -> DataFrame:
    oldest = F.lit(str(as_of)).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max_days))
    return rows.withColumn("status", F.when(F.col("last_ts").isNull(), "missing").when(
        F.col("last_ts") < oldest, "stale").otherwise("fresh"))


def failed_requirements(
    requirements: DataFrame, lake: DataFrame, as_of: str | dt.datetime, max_days: int = MAX_STALENESS_DAYS
) -> DataFrame:
    """Required (symbol, timeframe) that are missing or stale."""
    last = lake.groupBy(*KEYS).agg(F.max("ts").alias("last_ts"))
    return _status(requirements.join(last, KEYS, "left"), as_of, max_days).where(F.col("status") != "fresh")


def merge(head: DataFrame, existing: DataFrame, tail: DataFrame) -> DataFrame:
    """All bars once per timestamp; the tail wins over existing bars, these over the head."""
    parts = [d.withColumn("_p", F.lit(p)) for p, d in ((1, head), (2, existing), (3, tail))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in rows.columns if c not in (*KEYS, "ts", "_p")]
    return rows.groupBy(*KEYS, "ts").agg(F.max_by(F.struct(*rest), "_p").alias("_v")).select(
        *KEYS, "ts", "_v.*")


def missing_ranges(
    requirements: DataFrame, lake: DataFrame, now: str | dt.datetime, max_years: int = MAX_YEARS
) -> DataFrame:
    """Time ranges to fetch: everything, newer than the last bar, or older than the first one."""
    t = F.lit(str(now)).cast("timestamp_ntz")
    oldest = t - F.make_dt_interval(F.lit(max_years * 365))
    span = lake.groupBy(*KEYS).agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    ranges = F.array_compact(F.array(
        F.when(F.col("_z").isNull(), F.struct(
            F.lit("init").alias("kind"), oldest.alias("from_ts"), t.alias("to_ts"))),
        F.when(F.col("_z") < t - F.make_dt_interval(F.lit(HEAD_SLACK_DAYS)), F.struct(
            F.lit("head").alias("kind"), F.col("_z").alias("from_ts"), t.alias("to_ts"))),
        F.when(F.col("_a") > oldest + F.make_dt_interval(F.lit(TAIL_SLACK_DAYS)), F.struct(
            F.lit("tail").alias("kind"), oldest.alias("from_ts"), F.col("_a").alias("to_ts"))),
    ))
    return requirements.join(span, KEYS, "left").select(*KEYS, F.explode(ranges).alias("_r")).select(
        *KEYS, "_r.*")


def to_naive_utc(rows: DataFrame, column: str, zone: str | None = None) -> DataFrame:
    """Timestamps as naive UTC: instants are read in UTC, naive ones in ``zone`` when given."""
    kind = rows.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        return rows.withColumn(column, F.convert_timezone(
            F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")))
    if zone:
        return rows.withColumn(column, F.convert_timezone(F.lit(zone), F.lit("UTC"), c.cast("timestamp_ntz")))
    return rows.withColumn(column, c.cast("timestamp_ntz"))


def daily_closes(bars: DataFrame) -> DataFrame:
    """Last close per symbol and day, days without a close left out."""
    return bars.where(F.col("close").isNotNull()).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.max_by("close", "ts").alias("close"))


def data_version(files: DataFrame) -> DataFrame:
    """Short digest of (symbol, timeframe, modified) rows; it changes with any row, not with their order."""
    mark = F.sha2(F.concat_ws(":", "symbol", "timeframe", "modified"), 256)
    half = [F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]
    sums = F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in half])
    return files.agg(F.substring(F.sha2(sums, 256), 1, DIGEST_CHARS).alias("data_version"))


def file_marks(spark: SparkSession, root: str) -> DataFrame:
    """Latest modification time per series of a saved lake, from the listing."""
    return _files(spark, root).groupBy(*KEYS).agg(
        F.unix_micros(F.max("modificationTime")).cast("string").alias("modified"))


def json_safe(rows: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, dates and times as ISO text."""
    out = {}
    for f in rows.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumns(out) if out else rows


def to_json(rows: DataFrame, keys: Sequence[str], name: str = "json") -> DataFrame:
    """Keys and the remaining columns as one JSON text."""
    rest = [c for c in rows.columns if c not in keys]
    return json_safe(rows).select(*keys, F.to_json(F.struct(*rest)).alias(name))
