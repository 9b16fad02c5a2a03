"""Spans of regular expressions in texts, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are added up one after another; longer arrays are added up in runs of this length,
#: so that the work stays close to linear.
RUN = 256


def _running(values: Column) -> Column:
    empty = F.array().cast("array<int>")
    return F.aggregate(values, empty, lambda held, x: F.concat(
        held, F.array(F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit(0)) + x)))


def running_sums(values: Column) -> Column:
    """Running sums of an array of ints."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(RUN))
    runs = F.transform(starts, lambda s: _running(F.slice(values, s, RUN)))
    ends = _running(F.transform(runs, lambda r: F.element_at(r, -1)))
    shifted = F.transform(F.arrays_zip(runs.alias("run"), ends.alias("end")), lambda p: F.transform(
        p["run"], lambda v: v + p["end"] - F.element_at(p["run"], -1)))
    return F.when(F.size(values) <= RUN, _running(values)).otherwise(F.flatten(shifted))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in code points.

    ``pattern`` must not match the empty string. What lies between the matches comes from split(),
    so the positions are sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    # one more stretch than matches; each start is the sum of the stretches and matches before it
    lengths = F.transform(found, lambda x: F.length(x))
    steps = F.zip_with(F.slice(between, 1, F.size(lengths)), lengths, lambda a, b: F.coalesce(a, F.lit(0)) + b)
    spans = F.zip_with(running_sums(steps), found, lambda end, x: F.struct(
        (end - F.length(x)).alias("start"), end.alias("end"), x.alias("found")))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(F.size(found) > 0, spans).otherwise(none)


def of_kind(spans: Column, kind: str) -> Column:
    """array<struct<kind, start, end>>."""
    return F.transform(spans, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def replaced(text: Column, spans: Column, by: Column) -> Column:
    """The text with sorted, disjoint spans replaced by the parallel array ``by``."""
    count = F.size(spans)
    pieces = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(
        F.substring(text, F.when(i > 1, F.try_element_at(spans, i - 1)["end"]).otherwise(F.lit(0)) + 1,
                    F.element_at(spans, i)["start"] - F.when(i > 1, F.try_element_at(spans, i - 1)["end"]).otherwise(F.lit(0))),
        F.element_at(by, i)))
    tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    return F.when(count > 0, F.concat(F.concat_ws("", pieces), tail)).otherwise(text)
