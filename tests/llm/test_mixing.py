import pytest

from barlattice.llm import mixing


def reshared(sizes, total):
    """Targets by repeating: share by weight, cap, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), total
    while True:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)


def test_targets_and_words_taken(spark):
    rows = []
    for i in range(4000):
        source = ("b", "a", None, "c", "ä")[0 if i % 3 else i % 5]
        rows.append((i, " w" * (1 + i * 7919 % 180), source, i))
    rows += [(9000, "w " * 3000, "a", 0), (9001, None, "a", 0), (9002, "", "zero", 0), (None, "x y", "b", 0), (5, "x y", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies bigint")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = reshared({s: n for s, n in sizes.items()}, 1.5 * sum(sizes.values()))
    taken = {}
    for r in found:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * max(len((x or "").split()) for _, x, y, _ in rows if y == s)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_emit_repeats_rows(documents):
    docs = documents([f"w {i}" for i in range(500)], extra=", size bigint, target bigint")
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert out.count() == 750  # one source: 150 percent
    assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 2
    assert out.filter("size = doc_id and target = doc_id").count() == 750


def test_same_size_is_split_over_buckets(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = documents(["same words here"] * 1000)
    assert mixing.mix(docs).agg({"taken": "sum"}).first()[0] == pytest.approx(4500, abs=3)


def test_empty_table(documents):
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([None, ""])).agg({"taken": "sum"}).first()[0] == 0
