"""Mixing sources to target weights by systematic sampling.

Every source has a number of expected copies of each of its documents (target words over words of
the source, two at most). The documents of a source are put in order of size, their expected copies
are added up, one offset is drawn per source, and a document is emitted once for each integer that
its stretch of the sum crosses. Ordered by size, the words taken stay within about one document of
the target.

The sum within a source is never one task: ranks come from counts per (source, size, bucket of an
id digest), so a task holds one bucket, and the tables that are added up have one row per distinct
size of a source or per bucket of a size.

Defined cases: null and empty texts have size 0 and may be taken freely; a source without words has
target 0 and takes nothing; the null source comes last; rows that repeat an id are ranked one after
another; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlattice.llm.common import BLANK, settled, whole_text

#: Weights by place of the source, repeating; words of the mix over words of the input; most copies.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Rows of one size that share a bucket, on average.
BUCKET_ROWS = 5000
RESULTS = ("size", "source_size", "target", "copies", "taken")


def n_words(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(f"[^{BLANK}]+")).cast("long")


def unit(digest: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): weights shared out under the cap of ``MOST`` times the size.

    Capping and resharing until no source is above its cap is the same as one level L with
    target = min(cap, L * weight). L follows from sums in order of cap / weight. ``sizes`` has one
    row per source, which is what the windows here run over.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1)
    rows = (sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * MOST)
            .withColumn("_ratio", F.col("_cap") / F.col("_w")))
    whole = Window.partitionBy()
    below = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
             / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(below), F.lit(0.0))))
    rows = rows.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_ratio"))
    best = F.min(F.when(F.col("_open"), F.struct("_ratio", "_level"))).over(whole)["_level"]
    return rows.select("source", "source_size",
                       F.least(F.col("_cap"), F.coalesce(best * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id",
        size: str | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken; one row per input row.

    ``size`` names a column that holds the words of each row, where they are known already.
    """
    words = F.coalesce(F.col(size), F.lit(0)).cast("long") if size else n_words(text)
    docs = docs.withColumn("__size", words).drop(*[c for c in docs.columns if c in RESULTS])
    kept = [c for c in docs.columns if c != "__size"]
    buckets = max(1, docs.count() // BUCKET_ROWS)
    digest = F.md5(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary"))
    # a key that is never null and keeps the order of code points, null last
    key = F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))
    rows = (docs.withColumn("__source", key).withColumn("__digest", digest)
            .withColumn("__bucket", F.floor(unit(F.col("__digest")) * buckets)))
    counts = settled(rows.groupBy("__source", "__size", "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    per_size = counts.groupBy("__source", "__size").agg(F.sum("__n").alias("__n"))
    targets = source_targets(per_size.groupBy(F.col("__source").alias("source")).agg(
        F.sum(F.col("__size") * F.col("__n")).alias("source_size"))).withColumnRenamed("source", "__source")

    def before(frame: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn(name, F.coalesce(F.sum("__n").over(window), F.lit(0)))

    smaller = before(per_size, ["__source"], "__size", "__smaller").drop("__n")
    ahead = (before(counts, ["__source", "__size"], "__bucket", "__earlier").drop("__n")
             .join(smaller, ["__source", "__size"]).join(targets, "__source"))
    place = Window.partitionBy("__source", "__size", "__bucket").orderBy("__digest")
    rows = rows.withColumn("__at", F.row_number().over(place)).join(ahead, ["__source", "__size", "__bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__source")).cast("binary")))
    rank = F.col("__smaller") + F.col("__earlier") + F.col("__at")
    crossed = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return (rows.withColumn("size", F.col("__size")).withColumn("copies", crossed.cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size")).select(*kept, *RESULTS))


def emit(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id",
         seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    named = {c: f"__doc_{c}" for c in docs.columns if c in RESULTS}
    mixed = mix(docs.withColumnsRenamed(named), named.get(text, text), named.get(source, source),
                named.get(row_id, row_id), seed=seed).filter("copies > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    return mixed.select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns], copy).drop("__copy")
