"""License scan: ordered signature rules over the words of a text.

A text is its words in lower case with one blank between them. Rules are tried in three steps: the
rule's rarest-looking word must be among the words of the text (one hash intersection for all rules),
then its keyword must stand in the text, and only then its pattern is searched. A detection that lies
within the interval of one of the same or a stronger class is suppressed, so the wording of a license
silences the names in it, and 'cc by nc 4 0' silences 'cc by nc'. The base phrases are reported apart
and never suppressed.

All work is on one row at a time, so nothing is shuffled.

Defined cases: null and empty texts have no words, no labels and score 0; rows that repeat an id are
scanned one by one; an empty table gives an empty result; long texts are scanned whole, in time that
grows with their words and detections; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import ascii_lower, whole_text
from barlattice.llm.license_rules import BASE, CLASSES, RULES, Rule
from barlattice.llm.native_spans import RUN, running_sums

#: What parts words, and the score of a base phrase.
PARTS, BASE_SCORE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", 0.6
_HIT = "struct<start:int,far:int,priority:int,label:string,kind:string>"


def normal_words(text: str) -> Column:
    """The words of the text, each with a blank before it."""
    return F.rtrim(F.concat(F.lit(" "), F.ltrim(F.regexp_replace(ascii_lower(whole_text(text)), PARTS, " "))))


def _rule_array(rules: Sequence[Rule]) -> Column:
    return F.array(*[F.struct(
        F.lit(r.gate).alias("gate"), F.lit(f" {r.keyword} ").alias("keyword"), F.lit(f" (?:{r.pattern})(?= |$)").alias("pattern"),
        F.lit(CLASSES[r.kind][0] if r.kind in CLASSES else 0).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.kind).alias("kind"))
        for r in rules])


def _n_blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _hits(normal: Column, rule: Column) -> Column:
    """array<hit> of the places where a rule matches, in words; ``far`` is the negative end."""
    found = F.transform(F.regexp_extract_all(normal, rule["pattern"], F.lit(0)), _n_blanks)
    between = F.transform(F.split(normal, rule["pattern"], -1), _n_blanks)
    ends = running_sums(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.coalesce(a, F.lit(0)) + b))
    hits = F.zip_with(ends, found, lambda end, n: F.struct(
        (end - n).alias("start"), (-end).alias("far"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["kind"].alias("kind")))
    return F.when(F.size(found) > 0, hits).otherwise(F.array().cast(f"array<{_HIT}>"))


def _surviving(hits: Column) -> Column:
    """Sorted hits without those that lie within one of the same or a stronger class.

    Behind the sort by start and falling end, a hit lies within an earlier one if that one ends no
    earlier, so a fold that holds the furthest end of each class finds them.
    """
    none = F.array().cast(f"array<{_HIT}>")
    best = F.array(*[F.lit(-1)] * len(CLASSES))

    def step(held: Column, x: Column) -> Column:
        end = -x["far"]
        within = F.array_max(F.slice(held["best"], F.lit(1), x["priority"])) >= end
        moved = F.transform(held["best"], lambda b, i: F.when(i == x["priority"] - 1, F.greatest(b, end)).otherwise(b))
        return F.struct(moved.alias("best"), F.when(within, held["out"]).otherwise(F.concat(held["out"], F.array(x))).alias("out"))

    def run(held: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(held["best"].alias("best"), none.alias("out")), step)
        return F.struct(done["best"].alias("best"), F.concat(held["out"], F.array(done["out"])).alias("out"))

    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(RUN)), lambda s: F.slice(hits, s, RUN))
    start = F.struct(best.alias("best"), F.array().cast(f"array<array<{_HIT}>>").alias("out"))
    return F.aggregate(parts, start, run, lambda held: F.flatten(held["out"]))


def _spans(hits: Column) -> Column:
    return F.transform(hits, lambda x: F.struct(
        x["label"].alias("label"), x["kind"].alias("kind"), x["start"].alias("start"), (-x["far"]).alias("end")))


def find(docs: DataFrame, text: str = "text", row_id: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, base and detections.

    Both are array<struct<label, kind, start, end>> in words from 0, the end exclusive.
    """
    every = [*BASE, *rules]
    gates = F.array(*[F.lit(g) for g in sorted({r.gate for r in every})])
    rows = docs.select(F.col(row_id), normal_words(text).alias("__normal"))
    words = F.split(F.ltrim("__normal"), " ")
    rows = rows.select(row_id, "__normal", F.when(F.col("__normal") == "", 0).otherwise(F.size(words)).cast("long").alias("n_words"),
                       F.array_intersect(gates, words).alias("__gates"))
    tried = F.filter(_rule_array(every), lambda r: F.array_contains(F.col("__gates"), r["gate"]) & F.contains(
        F.concat(F.col("__normal"), F.lit(" ")), r["keyword"]))
    hits = F.array_sort(F.flatten(F.transform(tried, lambda r: _hits(F.col("__normal"), r))))
    none = F.array().cast(f"array<{_HIT}>")
    rows = rows.select(row_id, "n_words", F.when(F.size("__gates") > 0, hits).otherwise(none).alias("__hits"))
    rows = rows.select(row_id, "n_words", F.filter("__hits", lambda x: x["priority"] == 0).alias("__base"),
                       F.filter("__hits", lambda x: x["priority"] > 0).alias("__rest"))
    return rows.select(row_id, "n_words", _spans(F.col("__base")).alias("base"), _spans(
        F.when(F.size("__rest") > 0, _surviving(F.col("__rest"))).otherwise(none)).alias("detections"))


def digest_columns(found: DataFrame, row_id: str = "doc_id") -> DataFrame:
    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    places = F.transform("base", lambda x: x["start"])
    kinds = F.transform("detections", lambda x: x["kind"])
    worth = F.coalesce(*[F.when(F.array_contains(kinds, kind), F.lit(score))
                         for kind, (_, score) in sorted(CLASSES.items(), key=lambda c: -c[1][1])],
                       F.when(F.size("base") > 0, F.lit(BASE_SCORE)), F.lit(0.0))
    return found.select(
        row_id, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), labels(F.col("base")).alias("base_labels"),
        labels(F.concat("base", "detections")).alias("labels"), worth.alias("score"))
