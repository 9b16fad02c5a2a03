import hashlib

from barlattice.llm import exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_marks_follow_groups(documents):
    texts = ["a", "A", None, "", "É", "é", "x" * 50_000, "b", "B ", "a", "I", "ı"]
    ids = [5, 3, 1, 2, 7, 8, 9, None, None, 5, 20, 21]
    docs = documents(texts, ids, extra=", kept bigint, text_sha256 bigint")
    found = exact_dedup.mark_copies(docs).collect()
    want = brute(list(zip(ids, texts)))
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(found) == len(texts)
    for r in found:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
    assert sum(r.kept for r in found) == len(want)  # one of the two rows (5, "a") stays


def test_large_group_and_drop(documents, spark):
    texts = ["same"] * 3000 + [f"t{i}" for i in range(3000)]
    docs = documents(texts, extra=", kept bigint")
    found = exact_dedup.mark_copies(docs)
    assert found.filter("kept").count() == 3001
    assert found.filter("group_size = 3000 and keep_id = 2999").count() == 3000
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == list(range(2999, 6000))


def test_full_field_changes_nothing(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "field_bits", lambda rows: 64)
    docs = documents([f"t{i % 700}" for i in range(1000)])
    assert exact_dedup.mark_copies(docs).filter("kept").count() == 700


def test_empty_table(documents):
    docs = documents([])
    assert exact_dedup.mark_copies(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0
