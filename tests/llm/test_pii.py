import random
import re

from barlattice.llm import pii

POOL = ["a", "b.c", "@", "x@y.com", "é", "😀", "1", "12", "255", "256", ".", "10.0.0.1", " ", "-", "+1 (752) 555-7047", "+",
        "4111 1111 1111 1111", "4111111111111111", "000", "123456789", "_", "%", "a_d@e.f", "\n"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_brute_force(documents, sample):
    random.seed(5)
    texts = ["".join(random.choice(POOL) for _ in range(random.randint(0, 30))) for _ in range(1500)]
    texts += ["a@b" + ".c" * 20_000, "1.2.3.4." * 2_000, "a" * 100_000 + "@", "+1" + " " * 20_000, None, ""]
    texts += [r.text for r in sample.select("text").collect()]
    rows = {r.doc_id: r for r in pii.find(documents(texts, extra=", base bigint, terms bigint")).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert [(x.kind, x.start, x.end) for x in rows[i].base] == base(t or ""), ascii((t or "")[:80])


def test_terms_that_disclose(documents):
    """Brute force of the formula, and the texts that come out."""
    near = "quorbix writes to {} every day about {}"
    texts = [near.format("ann@x.org", w) for w in ("tea", "bread", "stones")] + [near.format("ann@x.org", "tea")]
    texts += ["every day somebody writes about tea and bread " * 5] * 400 + ["Zanthor met bob@y.org once", None, ""]
    docs = documents(texts)
    found = pii.find(docs).collect()
    named = {(texts[r.doc_id][x.start:x.end], x.kind) for r in found for x in r.terms}
    assert named == {("quorbix", "removed")}  # used only beside the address; Zanthor has one context
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == " writes to [EMAIL] every day about tea"
    assert clean[404] == "Zanthor met [EMAIL] once" and clean[405] == "" and clean[10] == texts[10]


def test_flagged_terms_are_marked_everywhere(documents):
    """Far from the mention in the same text, and in a text that does not repeat the entity."""
    near, common = "quorbix writes to ann@x.org every day about {}", "every day somebody writes about tea and bread "
    texts = [near.format(w) for w in ("tea", "bread", "stones", "tea")] + [common * 5] * 400
    texts += [near.format("tea") + " " + common * 5 + "says Quorbix", "it was QUORBIX, not quorbixes"]
    docs = documents(texts)
    marked = {r.doc_id: [(texts[r.doc_id][x.start:x.end], x.kind) for x in r.terms] for r in pii.find(docs).collect() if r.terms}
    one = ("quorbix", "removed")
    assert marked == {**{i: [one] for i in range(4)}, 404: [one, ("Quorbix", "removed")], 405: [("QUORBIX", "removed")]}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[405] == "it was , not quorbixes" and clean[404].endswith("bread says ")


def test_repeated_rows_and_empty_table(documents):
    rows = pii.find(documents(["me@a.org"] * 3, ids=[1, 1, None])).collect()
    assert len(rows) == 3 and all(len(r.base) == 1 for r in rows)
    assert pii.find(documents([])).count() == 0


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from barlattice.llm.native_spans import running_sums
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(running_sums(F.array(*[F.lit(i % 7) for i in range(n)]).cast("array<int>"))).first()[0]
        want, total = [], 0
        for i in range(n):
            total += i % 7
            want.append(total)
        assert got == want
