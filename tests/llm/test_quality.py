import random
import zlib

import numpy as np
import pyarrow as pa

from barlattice.llm import quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in test) >= 0.97 * len(test)
    good, bad = [r.score for r in test if r.quality], [r.score for r in test if not r.quality]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.98 * len(good) * len(bad)


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    changed = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - quality, quality) quality", "toxic")
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), changed).collect()}
    assert a == b


def test_conflicting_labels_in_any_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.quality, 0) for r in labels.collect()]
    rows += [(i, 1 - q if i % 3 else q, 0) for i, q, _ in rows]
    least = {}
    for i, q, _ in rows:
        least[i] = min(q, least.get(i, 1))
    scores = []
    for given in (rows, rows[::-1], [(i, q, 0) for i, q in least.items()]):
        table = spark.createDataFrame(given, "doc_id bigint, quality int, toxic int").coalesce(1)
        scores.append({r.doc_id: r.score for r in quality.classify(docs, table).collect()})
    assert scores[0] == scores[1] == scores[2]


def test_votes_equal_brute_force(sample):
    random.seed(4)
    texts = [r.text or "" for r in sample.select("text").collect()]
    rows = quality.features(pa.array(texts))
    rng = np.random.default_rng(3)
    directions = rng.normal(size=(quality.FEATURES, 8)).astype(np.float32)
    weights = np.ones(quality.FEATURES, np.float32)
    bare = quality.Model(weights, directions, np.zeros((0, 8), np.float32), np.zeros(0), 0.5)
    chosen = [*range(0, len(texts), 2), *range(0, 60, 2)]  # copies, so that neighbours tie
    labels = np.array([float(random.random() < 0.5) for _ in chosen])
    model = quality.Model(weights, directions, bare.embed(rows[chosen]), labels, 0.5)
    order = np.random.default_rng(1).permutation(len(chosen))
    shuffled = quality.Model(weights, directions, model.vectors[order], labels[order], 0.5)
    got, again = model.score(rows), shuffled.score(rows)
    wrong = 0
    for i, v in enumerate(bare.embed(rows)):
        alike = [round(float(x), 5) for x in np.round((v[None] @ model.vectors.T)[0], 5)]
        last = sorted(alike)[-quality.NEIGHBOURS]
        votes = [(max(a, 0), l) for a, l in zip(alike, labels) if a >= last]
        total = sum(a for a, _ in votes)
        want = sum(a * l for a, l in votes) / total if total else 0.5
        assert abs(got[i] - again[i]) < 1e-9
        wrong += abs(got[i] - want) > 1e-6
    assert wrong <= 0.01 * len(rows)  # single products round to other fifth decimals than blocks


def test_odd_rows(spark, documents):
    docs = documents(["words and words", "words and words", None, "", "x", "*** $$$ " * 40_000], ids=[1, 1, 2, 3, 4, None],
                     extra=", score bigint, label bigint, __score bigint")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id == 1}) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("score is not null").count() == kept.count()
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(documents([]), labels).count() == 0
