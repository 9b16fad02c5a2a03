"""Importance resampling towards a target distribution of word n-grams.

Texts are bags of hashed features: runs of one and two words, by CRC-32 modulo ``BUCKETS``. The gain
of a bucket is the log ratio of its smoothed shares in the target and in the documents; the weight of
a document is the mean gain of its features. With Gumbel noise from a hash of the id, the documents
of highest score are a draw without replacement in proportion to exp(weight / 1000).

Gains are one array of ``BUCKETS`` numbers that goes to every task, and a document is scored by
looking its buckets up. The draw needs the score at one rank only: a quantile sketch gives a bracket
around it, exact counts of the rows outside validate the bracket or take the next wider one, and only
the rows inside are sorted to find where the draw ends.

Defined cases: null and empty texts have no features and weight 0; texts under ``MIN_WORDS`` words are
never drawn; a null id hashes as the empty string and comes last in ties; rows that repeat an id are
drawn one by one; an empty table gives an empty result, an empty target counts as no features; long
texts are read whole, in steps of bounded memory.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import hashing
from barlattice.llm.common import whole_text, written
from barlattice.llm.places import with_places

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Accuracy of the sketch, and half the share of rows in the first bracket; each wider one has 8 times that.
ACCURACY, HALF, WIDER = 10_000, 0.0005, 8
#: Words that are hashed at a time, and bytes of a word beyond which zlib hashes it.
STEP, LONG = 200_000, 64
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


_TABLE = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _by_byte(state: np.ndarray, lengths: np.ndarray, data: np.ndarray | None, starts: np.ndarray | None) -> np.ndarray:
    """Run the register over the bytes of each word (zero bytes without ``data``), longest words first."""
    order = np.argsort(-lengths, kind="stable")
    held, falling = state[order], -lengths[order]
    at = starts[order] if starts is not None else None
    for k in range(min(LONG, int(lengths.max(initial=0)))):
        m = int(np.searchsorted(falling, -k, side="left"))  # words longer than k
        byte = data[at[:m] + k] if data is not None else np.uint8(0)
        held[:m] = (held[:m] >> np.uint32(8)) ^ _TABLE[(held[:m] ^ byte) & np.uint32(255)]
    out = np.empty_like(state)
    out[order] = held
    return out


def feature_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRC-32, text) of the features that words a bounded number at a time begin.

    The hash of two words follows from those of each: the first one's register runs over as many
    zero bytes as the second word has, and the second's hash is added.
    """
    for a in range(0, len(starts), STEP):
        s, e, o = starts[a:a + STEP + 1], ends[a:a + STEP + 1], owner[a:a + STEP + 1]
        lengths = e - s
        one = _by_byte(np.full(len(s), _ONES), lengths, data, s) ^ _ONES
        for i in np.flatnonzero(lengths > LONG):
            one[i] = zlib.crc32(data[s[i]:e[i]].tobytes())
        n = min(STEP, len(s))
        yield one[:n], o[:n]
        pair = np.flatnonzero(o[:-1] == o[1:])
        blank = one[pair] ^ _ONES
        blank = (blank >> np.uint32(8)) ^ _TABLE[(blank ^ np.uint32(32)) & np.uint32(255)] ^ _ONES
        two = _by_byte(blank, lengths[pair + 1], None, None) ^ one[pair + 1]
        for i in np.flatnonzero(lengths[pair + 1] > LONG):
            j = pair[i]
            two[i] = zlib.crc32(data[s[j]:e[j]].tobytes() + b" " + data[s[j + 1]:e[j + 1]].tobytes())
        yield two, o[pair]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = hashing.text_bytes(texts)
    return (hashing._LOWER[data], *hashing.spans(_WORD[data], offsets))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of the task: at most ``BUCKETS`` rows."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for a, b in hashing.slices(batch.column(0)):
            for hashes, _ in feature_hashes(*_words(batch.column(0)[a:b])):
                counts += np.bincount(hashes % BUCKETS, minlength=BUCKETS)
    hashing.give_back()
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Uses of each bucket over all texts; the result has ``BUCKETS`` numbers at any size."""
    parts = docs.select(whole_text(text).alias("text")).mapInArrow(_counted, "bucket bigint, n bigint")
    counts = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, in thousandths, rounded down."""
    size, goal = float(documents.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((float(t) + 1) * size) / ((float(s) + 1) * goal)))
                     for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def _scored(table: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in hashing.slices(batch.column(1)):
                data, starts, ends, owner = _words(batch.column(1)[a:b])
                words = np.bincount(owner, minlength=b - a)
                features, total = np.zeros(b - a, np.int64), np.zeros(b - a)
                for hashes, of in feature_hashes(data, starts, ends, owner):
                    features += np.bincount(of, minlength=b - a)
                    total += np.bincount(of, weights=table[hashes % BUCKETS], minlength=b - a)  # whole numbers
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(words), pa.array(features), pa.array(total.astype(np.int64))],
                    names=[batch.schema.names[0], "n_words", "n_features", "total"])
        hashing.give_back()
    return score


def scores(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
           row_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Per row: its id, n_words, n_features, weight and score."""
    table = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    kind = docs.schema[row_id].dataType.simpleString()
    rows = docs.select(F.col(row_id), whole_text(text).alias("__text")).mapInArrow(
        _scored(table), f"`{row_id}` {kind}, n_words bigint, n_features bigint, total bigint")
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(F.lit(0)).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("long")
    return rows.select(row_id, "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def bracket(rows: DataFrame, take: int, total: int) -> tuple[int, int, int]:
    """(lowest, highest, number above) of scores that hold the ``take``-th highest of ``total`` rows."""
    share = 1 - take / total
    half = [HALF * WIDER ** k for k in range(12) if HALF * WIDER ** k < 1]
    asked = [max(0.0, share - h) for h in half] + [min(1.0, share + h) for h in half]
    sketch = rows.agg(F.percentile_approx("score", asked, ACCURACY).alias("q"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    held = list(zip(sketch["q"][:len(half)], sketch["q"][len(half):])) + [(sketch["lo"], sketch["hi"])]
    for low, high in held:
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < take <= above + inside:
            break
    return low, high, above


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
             row_id: str = "doc_id", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per row: its id, n_words, n_features, weight, score, and its rank in the draw (null: not drawn)."""
    rows = written(scores(docs, target, text, target_text, row_id, seed).withColumn("__row", F.monotonically_increasing_id()))
    names = [row_id, "n_words", "n_features", "weight", "score"]
    able = rows.filter(F.col("n_words") >= MIN_WORDS)
    total = able.count()
    take = percent * total // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if take == 0:
        return rows.select(*names, undrawn)
    low, high, above = bracket(able, take, total)
    order = [F.col("score").desc(), F.col(row_id).asc_nulls_last(), F.col("__row").asc()]
    inside = with_places(able.filter(F.col("score").between(low, high)), order)
    edge = inside.select(*names, F.when(F.col("place") <= take - above, F.col("place") + above).alias("rank"))
    ahead = with_places(able.filter(F.col("score") > high), order).select(*names, F.col("place").alias("rank"))
    rest = rows.filter((F.col("n_words") < MIN_WORDS) | (F.col("score") < low)).select(*names, undrawn)
    return ahead.unionByName(edge).unionByName(rest)
