"""Personal data: patterns, and terms that disclose protected entities by co-occurrence.

Emails, IP addresses, card and phone numbers are found by pattern. Each distinct value is a
protected entity. How much a term tells about an entity is measured over the whole corpus: a term is
judged in the stretch of ``WINDOW`` code points on both sides of each mention, and

    disclosure(t, e) = PMI(t, e) / IC(e) = ln(n(t,e) N / (n(t) n(e))) / ln(N / n(e))

where N counts all terms of the corpus, n(t) the uses of t, n(e) the mentions of e, and n(t,e) the
mentions of e with t beside them. It is 1 where t is only ever used beside e. With the support of
``MIN_CONTEXTS`` different stretches of text, terms at ``REMOVE`` or more are removed, and at
``GENERALISE`` or more replaced by a word for their class, in every text and wherever they stand. One mention proves nothing, so documents
without repeated entities keep all their words, and copies of a text count as one stretch.

Defined cases: null and empty texts have no spans; rows that repeat an id are searched one by one;
an entity that fills the corpus (IC 0) discloses nothing; an empty table gives an empty result; long
texts are searched whole, in time that grows with their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import whole_text, with_group_values, written
from barlattice.llm.exact_dedup import field_bits
from barlattice.llm.native_spans import joined, matches, of_kind, replaced

WINDOW, MIN_CONTEXTS, REMOVE, GENERALISE = 60, 2, 0.9, 0.75
#: Patterns, written so that no start is tried twice within one run of characters; \G lets a match
#: begin where the one before it ended.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}][\p{L}\p{Nd}]{2,}+"
KINDS = ("email", "ip", "card", "phone")
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum over the digits is a multiple of ten."""
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda held, i: held + value(i))
    return total % 10 == 0


def _small_parts(address: Column) -> Column:
    short = F.transform(F.split(address, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _found(text: Column) -> dict[str, Column]:
    """Per kind: array<struct<start, end, found>>. Cheap tests keep most texts from the patterns."""
    def within(test: Column, pattern: str) -> Column:
        return F.when(test, matches(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))

    return {
        "email": within(F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(within(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP), lambda x: _small_parts(x["found"])),
        "card": F.filter(within(text.rlike(CARD), CARD), lambda x: _luhn(_digits(x["found"]))),
        "phone": F.filter(within(F.contains(text, F.lit("+")), PHONE),
                          lambda x: F.length(_digits(x["found"])).between(8, 15)),
    }


def _terms_beside(text: Column, mention: Column, base: Column) -> Column:
    """array<struct<term, start, end>> of the whole terms in the window, outside all base spans."""
    low = F.greatest(mention["start"] - WINDOW, F.lit(0))
    # one more on the left, so that a term cut by the window is seen to be cut
    shown = F.substring(text, low + 1, mention["end"] + WINDOW - low)
    whole = F.filter(matches(shown, TERM), lambda t: (
        (t["start"] > F.when(low > 0, 0).otherwise(-1)) & ((t["end"] < F.length(shown)) | (low + t["end"] >= F.length(text)))))
    placed = F.transform(whole, lambda t: F.struct(
        F.lower(t["found"]).alias("term"), (low + t["start"]).alias("start"), (low + t["end"]).alias("end")))
    return F.filter(placed, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))


def _values(kind: str) -> Column:
    """array<struct<kind, value, start, end>>: the entity of each span."""
    return F.transform(f"found_{kind}", lambda x: F.struct(
        F.lit(kind).alias("kind"), F.lower(x["found"]).alias("value"), x["start"].alias("start"), x["end"].alias("end")))


def mentions(docs: DataFrame, text: str = "text", row_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Written table of one row per row of ``docs``: row key, id, base spans and what stands beside them."""
    rows = docs.select(F.col(row_id), whole_text(text).alias("text")).select("*", *[
        c.alias(f"found_{k}") for k, c in _found(F.col("text")).items()])
    rows = rows.withColumn("base", F.concat(*[of_kind(F.col(f"found_{k}"), k) for k in KINDS]))
    values = F.concat(*map(_values, KINDS))
    beside = F.transform(values, lambda m: F.struct(
        m["kind"].alias("kind"), m["value"].alias("value"), _terms_beside(F.col("text"), m, F.col("base")).alias("terms")))
    empty = F.array().cast("array<struct<kind:string,value:string,terms:array<struct<term:string,start:int,end:int>>>>")
    rows = rows.withColumn("beside", F.when(F.size("base") > 0, beside).otherwise(empty))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), row_id, "base", "beside",
                               *(["text"] if keep_text else [])))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, uses) over all texts; counts are added up before they are shuffled."""
    terms = docs.select(F.explode(F.regexp_extract_all(F.lower(whole_text(text)), F.lit(TERM), 0)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))


def disclosing_terms(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, term, disclosure, uses, action) of the terms over the thresholds."""
    each = found.select(F.explode("beside").alias("m")).select(
        "m.kind", "m.value", F.array_distinct(F.transform("m.terms", lambda t: t["term"])).alias("terms"))
    # mentions in the same surroundings are one context
    contexts = each.groupBy("kind", "value", "terms").agg(F.count(F.lit(1)).alias("mentions"))
    contexts = written(contexts)
    of_entity = contexts.groupBy("kind", "value").agg(F.sum("mentions").alias("entity_mentions"))
    pairs = (contexts.select("kind", "value", "mentions", F.explode("terms").alias("term"))
             .groupBy("kind", "value", "term").agg(F.sum("mentions").alias("together"), F.count(F.lit(1)).alias("contexts"))
             .filter(F.col("contexts") >= MIN_CONTEXTS))
    counts = written(term_counts(docs, text))
    total = counts.agg(F.sum("uses")).first()[0] or 0
    judged = pairs.join(of_entity, ["kind", "value"]).join(counts, "term")
    information = F.log(F.lit(float(max(total, 1))) / F.col("entity_mentions"))
    pmi = F.log(F.col("together") * F.lit(float(max(total, 1))) / (F.col("uses") * F.col("entity_mentions")))
    judged = judged.withColumn("disclosure", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)))
    return judged.filter(F.col("disclosure") >= GENERALISE).select(
        "kind", "value", "term", "disclosure", "uses",
        F.when(F.col("disclosure") >= REMOVE, "removed").otherwise("generalised").alias("action"))


def find(docs: DataFrame, text: str = "text", row_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, base spans, term spans (kinds removed and generalised).

    A flagged term is marked wherever a text uses it, by the strongest of its actions.
    """
    found = mentions(docs, text, row_id, keep_text=True)
    flagged = disclosing_terms(found, docs, text)
    flagged = written(flagged.groupBy("term").agg(F.max("action").alias("action"), F.max("uses").alias("uses")))  # removed outranks generalised
    held = _flagged_of_rows(found, flagged)
    rows = found.join(held, "row", "left").withColumn("terms", F.when(
        F.col("held").isNotNull(), _placed(F.col("text"), F.col("held"), F.col("base"))).otherwise(F.array().cast(_SPANS)))
    return rows.select(row_id, "base", "terms", *(["text"] if keep_text else []))


def _placed(text: Column, held: Column, base: Column) -> Column:
    """array<struct<kind, start, end>> of the terms of ``held`` outside all base spans, removed ones first.

    One fold over the stretches between terms and the terms, so that long texts take linear time.
    """
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
    steps = F.zip_with(F.transform(F.split(text, TERM, -1), lambda x: F.length(x)), F.regexp_extract_all(text, F.lit(TERM), 0),
                       lambda gap, word: F.struct(gap.alias("gap"), word.alias("word")))

    def step(at: Column, x: Column) -> Column:
        start = at["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["word"]), F.lit(0))
        kind = F.try_element_at(held, F.lower(x["word"]))
        hit = F.struct(F.when(kind == "removed", 0).otherwise(1).alias("rank"), start.alias("start"), end.alias("end"), kind.alias("kind"))
        return F.struct(end.alias("at"), F.when(kind.isNotNull(), F.concat(at["hits"], F.array(hit))).otherwise(at["hits"]).alias("hits"))

    hits = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("hits")), step, lambda at: at["hits"])
    apart = F.filter(hits, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    return F.transform(F.array_sort(apart), lambda t: F.struct(
        t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end")))


def _flagged_of_rows(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """(row, held) of the rows that use flagged terms: a map of their terms to actions.

    A bit field of the flagged terms, which is broadcast, keeps nearly all other words from the shuffle.
    """
    bits = field_bits(flagged.count())
    slot = F.xxhash64("term").bitwiseAND(F.lit(bits - 1))
    words = (flagged.select(slot.alias("slot")).groupBy(F.shiftrightunsigned("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("mask")))
    used = found.select("row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), 0))).alias("term"))
    used = used.select("row", F.lower("term").alias("term")).withColumn("slot", slot)
    used = (used.join(F.broadcast(words), F.shiftrightunsigned("slot", 6) == F.col("word"))
            .filter(F.expr("shiftrightunsigned(mask, int(slot & 63)) & 1") == 1).select("row", "term"))
    used = written(used)
    named = with_group_values(used, flagged, "term", "uses", used.count())
    return named.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("held"))


def sanitise(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(id, text): base spans become their kind in brackets, disclosing terms a class word or nothing.

    Base spans of different kinds may overlap; the one that starts first is replaced.
    """
    rows = find(docs, text, row_id, keep_text=True)
    spans = F.array_sort(F.transform(F.concat("base", "terms"), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    apart = F.aggregate(spans, empty, lambda held, x: F.when(
        F.coalesce(F.try_element_at(held, F.lit(-1))["end"], F.lit(0)) <= x["start"], F.concat(held, F.array(x))).otherwise(held))
    rows = rows.withColumn("spans", apart)
    label = F.transform("spans", lambda x: F.when(x["kind"] == "removed", F.lit("")).when(
        x["kind"] == "generalised",
        F.when(F.substring(F.col("text"), x["start"] + 1, F.lit(1)).rlike(r"\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]")))
        .otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
    return rows.select(row_id, replaced(F.col("text"), F.col("spans"), label).alias("text"))


def digest_columns(found: DataFrame, row_id: str = "doc_id") -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(row_id, *[count(k) for k in KINDS],
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.concat("base", "terms")).alias("spans"))
