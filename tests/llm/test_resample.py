import hashlib
import math
import random
import re
import zlib

from barlattice.llm import resample

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(rows, goals):
    s, t = [0] * 10000, [0] * 10000
    held = [(i, *features(text)) for i, text in rows]
    for _, _, f in held:
        for b in f:
            s[b] += 1
    for text in goals:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t)]
    out = []
    for i, n, f in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:25 * len(able) // 100], 1):
        r[4] = place
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


def make(n, seed):
    random.seed(seed)
    words = ["alpha", "Beta", "GAMMA", "théta", "😀x", "k9", "z" * 70, "y" * 64, "w" * 65, "mu", "nu"]
    return [" ".join(random.choice(words) for _ in range(random.choice([0, 1, 5, 19, 20, 21, 60]))) + random.choice(["", ".", " - x"])
            for _ in range(n)] + [None, "", "one"]


def run(spark, documents, texts, ids, goals):
    docs = documents(texts, ids, extra=", rank bigint, n_words bigint, total bigint, score bigint")
    target = spark.createDataFrame([(g,) for g in goals], "text string")
    rows = resample.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(repr(tuple(r)) for r in rows)


def test_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(resample, "STEP", 50)
    texts = make(400, 1) + ["long " * 60_000 + "Ünd"]
    ids = [*range(len(texts) - 1), None]
    goals = [x for x in make(20, 2)]
    assert run(spark, documents, texts, ids, goals) == brute(list(zip(ids, texts)), goals)


def test_repeated_rows_and_empty_target(spark, documents):
    texts = [make(40, 3)[9] + " alpha beta" * 12] * 50 + make(40, 4)
    ids = [5] * 30 + [6] * 20 + list(range(100, 143))
    assert run(spark, documents, texts, ids, []) == brute(list(zip(ids, texts)), [])


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(resample, "ACCURACY", 2)  # a sketch that is nearly blind
    monkeypatch.setattr(resample, "HALF", 0.0005)
    rows = spark.range(2000).selectExpr("id * id AS score")
    for take in (1, 20, 500, 1999, 2000):
        low, high, above = resample.bracket(rows, take, 2000)
        inside = rows.filter(f"score between {low} and {high}").count()
        assert above == rows.filter(f"score > {high}").count() and above < take <= above + inside


def test_empty_table(spark, documents):
    assert run(spark, documents, [], [], ["a b"]) == []
