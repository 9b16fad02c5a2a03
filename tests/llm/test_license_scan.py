import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barlattice.llm import license_scan
from barlattice.llm.license_rules import BASE, CLASSES, RULES

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    """All rules on all texts, without gates, and suppression by all pairs."""
    words = words_of(text)
    normal = "".join(f" {w}" for w in words)
    base = sorted((i, label, i + len(phrase)) for phrase, label in (
        (("gnu", "general", "public", "license"), "gpl"), (("apache", "license"), "apache"), (("cc", "by"), "cc-by"), (("mit", "license"), "mit"))
        for i in range(len(words)) if tuple(words[i:i + len(phrase)]) == phrase)
    hits = []
    for r in RULES:
        for m in re.finditer(f" (?:{r.pattern})(?= |$)", normal):
            start = normal[:m.start()].count(" ")
            hits.append((start, start + m.group().count(" "), CLASSES[r.kind][0], r.label, r.kind))
    stay = [h for i, h in enumerate(hits) if not any(
        o[0] <= h[0] and o[1] >= h[1] and o[2] <= h[2] and (o[:2] != h[:2] or (o[2:], j) < (h[2:], i))
        for j, o in enumerate(hits) if j != i)]
    return len(words), base, sorted(stay)


def rows_of(df):
    return {r.doc_id: (r.n_words, sorted((x.start, x.label, x.end) for x in r.base),
                       sorted((x.start, x.end, CLASSES[x.kind][0], x.label, x.kind) for x in r.detections)) for r in df.collect()}


def make(seed):
    random.seed(seed)
    pieces = ["Licensed under the Apache License, Version 2.0.", "MIT License", "GNU General Public License, version 3", "CC-BY-NC 4.0", "cc by",
              "SPDX-License-Identifier: GPL-2.0-or-later", "see https://www.apache.org/licenses/LICENSE-2.0", "Permission is hereby granted",
              "free of charge, to any person obtaining a copy of this software and associated documentation files", "the theme", "ünd cc0",
              "to deal in the Software without restriction", "creative commons attribution share alike", "all rights reserved", "Copyright (c) me",
              "public domain", "released into the public domain", "GPLv3 gpl v2", "licen", "mit", "apache license apache license", "cc by cc by nc sa 4.0",
              "dual licensed under MIT and Apache 2.0", "llama 3 community license", "0BSD", "naïve"]
    return [random.choice([" ", "\n", " - "]).join(random.choice(pieces) for _ in range(random.randint(0, 12))) for _ in range(150)]


def test_equal_brute_force(documents):
    texts = make(1) + [None, "", "...", "x", "MIT License", "filler text " * 30_000 + "the mit license", "cc by nc 4.0 mit license " * 700]
    docs = documents(texts, extra=", n_words bigint, base bigint, detections bigint, labels bigint")
    got = rows_of(license_scan.find(docs))
    for i, t in enumerate(texts[:-1]):
        assert got[i] == brute(t), t
    last = len(texts) - 1
    assert got[last][0] == 700 * 7 and len(got[last][1]) == 1400 and len(got[last][2]) == 1400


def test_given_texts(sample):
    found = rows_of(license_scan.find(sample))
    for r in sample.collect():
        if re.search("(?i)licens|gpl|cc.by|mit", r.text or "") or r.doc_id % 10 == 0:
            assert found[r.doc_id] == brute(r.text)


def test_digests(documents):
    texts = ["Released under the MIT License.", "GNU General Public License; cc by, Apache License Version 2.0", "nothing", None]
    rows = {r.doc_id: r for r in license_scan.digest_columns(license_scan.find(documents(texts))).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels, rows[0].labels, rows[0].score) == (1, 3, 3, "mit", "mit", 0.85)
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].last_word) == (11, 3, 0, 6)
    assert (rows[1].base_labels, rows[1].labels) == ("apache,cc-by,gpl", "apache,apache-2.0,cc-by,gpl")
    for i in (2, 3):
        assert (rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].labels, rows[i].score) == (0, None, None, "", 0.0)
    assert license_scan.digest_columns(license_scan.find(documents([]))).count() == 0


def test_rules_are_many_and_distinct():
    assert len(RULES) >= 200 and len(set(RULES)) == len(RULES)
    assert {r.kind for r in RULES} == set(CLASSES)


@settings(max_examples=3, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_holds_the_keyword(data):
    word = st.characters(min_codepoint=97, max_codepoint=122)
    for r in [*RULES, *BASE]:
        found = data.draw(st.from_regex(re.compile(r.pattern.replace("[^ ]+", "[a-z]+")), fullmatch=True, alphabet=st.one_of(word, st.sampled_from(" 0123456789"))))
        assert f" {r.keyword} " in f" {found} ", (r, found)
