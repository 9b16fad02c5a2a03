import random

import pytest

from barlattice.llm import shingle_join
from barlattice.llm.components import components


def shingles(text, n=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: " " for i in range(9, 14)}).split(" ") if w]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, n=4, percent=85):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def make(seed, count=250):
    """Groups of near copies around the threshold, shared passages, chains and short texts."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(random.choice([3, 8, 30, 60, 120]))] for _ in range(12)]
    texts = []
    for i in range(count):
        t = list(random.choice(bases)) if random.random() < 0.8 else [word() for _ in range(50)]
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            t[random.randrange(len(t))] = word()
        if random.random() < 0.3:
            t += passage
        texts.append(random.choice([" ", "\n", "  "]).join(t))
    return texts + [None, "", " \t\n", "one", "ONE", "one two three", "One two  three", "É x y z w", "é x y z w", "  　 a"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(documents, seed):
    texts = make(seed)
    docs = documents(texts, extra=", n_shingles bigint, set_key bigint, held bigint")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(docs).collect()}
    assert got == brute(texts)


def test_other_parameters(documents):
    texts = make(4, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(documents(texts), n=5, percent=80).collect()}
    assert got == brute(texts, 5, 80)


def test_many_fragments(documents, monkeypatch):
    monkeypatch.setattr(shingle_join, "FRAGMENT_SHINGLES", 100)
    texts = make(5, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(documents(texts)).collect()}
    assert got == brute(texts)


def test_given_documents(sample):
    rows = sample.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(sample).collect()}
    want = brute([r.text for r in rows])
    assert got == {rows[i].doc_id: (n, rows[c].doc_id) for i, (n, c) in want.items()}


def test_odd_ids_and_empty_table(documents):
    docs = documents(["a b c d e", "a b c d e", "a b c d e", None, "f g h i j"], ids=[7, 7, None, None, 3], extra=", component bigint")
    rows = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in shingle_join.linked_components(docs).collect())
    assert rows[:3] == [("3", 2, 3), ("7", 2, 7), ("7", 2, 7)] and len(rows) == 5
    stay = shingle_join.drop_near_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["3", "7", "7", "None", "None"]  # both rows without an id stay
    assert shingle_join.linked_components(documents([])).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
