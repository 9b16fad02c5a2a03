"""Exact copies by a two-pass Bloom filter; only rows whose hash may repeat are shuffled.

Pass one sets ``HASHES`` slots per row in a bit field and keeps the slots that were set twice. A row
with a slot that was set once has no copy, so in pass two it goes straight through; only the others
are grouped by the SHA-256 of their normalised text. False positives only cost a shuffle.

Defined cases: a null text is empty, so null and empty texts are one group; a null id ranks below
every other; rows that repeat an id and a text count separately and only one of them stays; an
empty table gives an empty result; ``drop_copies`` passes extra columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlattice.llm.common import ascii_lower, whole_text, with_group_values, written

#: Slots of a row, bits per row, and the proven bound of what is broadcast: a field of 2**25 bits is
#: at most 2**19 words. Larger tables fill the field more and shuffle more, with the same result.
HASHES, BITS_PER_ROW, MAX_BITS = 2, 16, 2 ** 25


def normalised_sha256(text: str) -> Column:
    return F.sha2(ascii_lower(whole_text(text)).cast("binary"), 256)


def row_hash(text: str) -> Column:
    """A hash that equal normalised texts share. lower() folds more than A-Z, which is enough here."""
    return F.xxhash64(F.lower(whole_text(text)))


def field_bits(rows: int) -> int:
    """Bits of each field for a table of ``rows`` rows: a power of two within the bound."""
    return min(MAX_BITS, 1 << max(12, (rows * BITS_PER_ROW).bit_length()))


def _slot(i: int, bits: int) -> Column:
    """Slot of the row in field ``i``: separate bits of the 64-bit hash."""
    return F.shiftrightunsigned("__h", 26 * i).bitwiseAND(F.lit(bits - 1))


def with_repeats(rows: DataFrame, bits: int) -> DataFrame:
    """Adds __maybe: false where no other row has the hash ``__h``."""
    slots = rows.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), _slot(i, bits).alias("slot")) for i in range(HASHES)])).alias("s"))
    words = (slots.groupBy("s.field", "s.slot").count().filter("count > 1")
             .groupBy("field", F.shiftrightunsigned("slot", 6).alias("__word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("__mask")))
    maybe = F.lit(True)
    for i in range(HASHES):
        field = words.filter(F.col("field") == i).select("__word", F.col("__mask").alias(f"__mask{i}"))
        rows = (rows.withColumn("__word", F.shiftrightunsigned(_slot(i, bits), 6))
                .join(F.broadcast(field), "__word", "left").drop("__word"))
        bit = F.expr(f"shiftrightunsigned(__mask{i}, int(shiftrightunsigned(__h, {26 * i}) & 63)) & 1")
        maybe = maybe & (F.coalesce(bit, F.lit(0).cast("long")) == 1)
    return rows.withColumn("__maybe", maybe).drop(*[f"__mask{i}" for i in range(HASHES)])


def mark_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept and text_sha256."""
    rows = written(docs.select(F.col(row_id), row_hash(text).alias("__h"),
                               normalised_sha256(text).alias("text_sha256")))
    total = rows.count()
    probed = with_repeats(rows, field_bits(total)).drop("__h")
    alone = (probed.filter(~F.col("__maybe"))
             .withColumns({"keep_id": F.col(row_id), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}))
    again = probed.filter("__maybe")
    groups = again.groupBy("text_sha256").agg(
        F.max(row_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    marked = with_group_values(again, groups, "text_sha256", "group_size", total)
    one = Window.partitionBy("text_sha256", row_id).orderBy("keep_id")
    is_keeper = F.col(row_id).eqNullSafe(F.col("keep_id"))
    keepers = marked.filter(is_keeper).withColumn("kept", F.row_number().over(one) == 1)
    others = marked.filter(~is_keeper).withColumn("kept", F.lit(False))
    return (alone.unionByName(keepers).unionByName(others)
            .select(row_id, "keep_id", "group_size", "kept", "text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of every group of equal texts, with the columns of ``docs``."""
    probed = with_repeats(docs.withColumn("__h", row_hash(text)), field_bits(docs.count()))
    alone = probed.filter(~F.col("__maybe"))
    again = probed.filter("__maybe").withColumn("__sha", normalised_sha256(text))
    keep = again.groupBy(F.col("__sha").alias("__key")).agg(F.max(row_id).alias("__keep"))
    # joined by text and id, so that a large group is not one key
    stay = again.join(keep, (F.col("__sha") == F.col("__key")) & F.col(row_id).eqNullSafe(F.col("__keep")))
    one = Window.partitionBy("__sha", row_id).orderBy("__h")
    stay = stay.withColumn("__n", F.row_number().over(one)).filter("__n = 1")
    return alone.select(*docs.columns).unionByName(stay.select(*docs.columns))
