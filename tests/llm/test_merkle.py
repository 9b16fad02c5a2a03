import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from barlattice.llm import merkle
from barlattice.llm.catalog import op13_columns

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree bigint, idx bigint, carry bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes):
    """Root of the nodes, and of each the siblings on its way: (side, digest), or None in a run of one."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            paths[i].append(("<" if p % 2 else ">", nodes[p ^ 1]) if p ^ 1 < len(nodes) else None)
            at[i] = p // 2
        nodes = [sha("".join(nodes[k:k + 2])) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, sha(encoded(row)), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = {x: climb([r[2] for r in sorted(trees[x], key=lambda r: r[:3])]) for x in langs}
    root, upper = climb([lower[x][0] for x in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, upper):
        for (_, _, leaf, row), path in zip(sorted(trees[lang], key=lambda r: r[:3]), lower[lang][1]):
            i, source, _, n, text = row
            held = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0:
                held = sha(encoded((i, source, lang, None if n is None else n + 1, text)))
            for step in path + top:
                held = sha(held if step is None else step[1] + held if step[0] == "<" else held + step[1])
            proof = sha("".join(step[1] for step in path + top if step))
            out.append((i, leaf, lower[lang][0], root, proof, held, held == root))
    return sorted(map(repr, out))


def make(n, seed=3):
    random.seed(seed)
    return [(random.choice([None, *range(2 * n)]) if random.random() < 0.2 else i, random.choice([None, "s", "é"]),
             random.choice([None, "en", "en", "en", "de", "é", "z"]), random.choice([None, 5, 77]),
             random.choice([None, "", "a b", "é" * random.randint(0, 50)])) for i in range(n)]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert sorted(repr(tuple(r)) for r in op13_columns(docs).collect()) == brute(rows)


def test_equal_brute_force(spark):
    check(spark, make(700) + [(9, "s", "en", 1, "x " * 200_000)] + [(8, None, "de", None, "same")] * 3)


def test_small_blocks_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)
    monkeypatch.setattr(merkle, "SMALL", 3)
    check(spark, make(150, seed=5))


def test_few_rows(spark):
    for n in (0, 1, 2):
        check(spark, make(n))


def test_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame(make(40, seed=7), SCHEMA.rsplit(", tree", 1)[0])
    found = merkle.manifest(docs).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof")))
    assert found.filter("again <> root").count() == 0 and found.select("root").distinct().count() == 1
