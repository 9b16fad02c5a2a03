import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barlattice.llm import hashing, line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def normal(line):
    return " ".join(lower(line).split())


def brute(texts, ids):
    """Group of every normal form by edit distance alone, and (id, line, form) of the lines with words."""
    lines = [(i, n, normal(line)) for i, t in zip(ids, texts) for n, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    forms = sorted({x[2] for x in lines}, key=len)
    near, parent = [], {f: f for f in forms}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(forms):
        for b in forms[i + 1:]:
            most = len(b) * 20 // 100
            if len(b) - len(a) > most:
                break
            if line_dedup.edits_within(a, b, most):  # held against the plain table below
                near.append((a, b))
                parent[find(a)] = find(b)
    return {f: find(f) for f in forms}, lines, near


def hold(rows, texts, ids):
    """Nothing is dropped that edit similarity does not connect with its keeper; the share of near pairs found."""
    group, lines, near = brute(texts, ids)
    form = {(i, n): f for i, n, f in lines}
    assert {(r.doc_id, r.line) for r in rows} == set(form)
    kept = {}
    for r in rows:
        keeper = (r.keeper_id, r.keeper_line)
        assert group[form[r.doc_id, r.line]] == group[form[keeper]]
        assert r.kept == ((r.doc_id, r.line) == keeper)
        assert (keeper[0] is None, keeper[0] or 0, keeper[1]) <= (r.doc_id is None, r.doc_id or 0, r.line)
        assert kept.setdefault(form[r.doc_id, r.line], keeper) == keeper
    return sum(kept[a] == kept[b] for a, b in near) / len(near)


def make(seed):
    random.seed(seed)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "sigma", "kappa", "théta"]
    bases = [[random.choice(words) for _ in range(random.randint(1, 40))] for _ in range(12)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(random.randint(0, 5)):
            b = list(random.choice(bases))
            for _ in range(random.choice([0, 0, 1, 1, 2])):
                b[random.randrange(len(b))] = random.choice(["alphas", "bet", "zeta", "gamma"])
            lines.append(random.choice([" ", "  ", "\t"]).join(b))
        texts.append("\n".join(lines))
    return texts + [None, "", "\n\n", "x\n\nX", "long " * 4000, "LONG " * 4000]


def test_edit_distance_equals_the_table():
    random.seed(9)
    for _ in range(400):
        a = "".join(random.choice("abcé😀") for _ in range(random.randint(0, 90)))
        b = list(a) if random.random() < 0.7 else [random.choice("abcé") for _ in range(random.randint(0, 90))]
        for _ in range(random.randint(0, 8)):
            at = random.randint(0, len(b))
            b[at:at + random.randint(0, 2)] = random.choice(["", "a", "xy"])
        b = "".join(b)
        d = distance(a, b)
        for most in (0, d - 1, d, d + 1, 100):
            assert line_dedup.edits_within(a, b, most) == (d <= most)


def test_brute_force(documents):
    texts = make(1)
    ids = [*range(len(texts) - 1), None]
    docs = documents(texts, ids, extra=", line bigint, kept bigint, row bigint, id bigint")
    assert hold(line_dedup.line_decisions(docs).collect(), texts, ids) >= 0.9


def test_long_lists_lose_no_link(documents, monkeypatch):
    texts = make(2)
    docs = documents(texts)
    want = sorted(line_dedup.line_decisions(docs).collect())
    hold(want, texts, list(range(len(texts))))
    monkeypatch.setattr(line_dedup, "LIST", 3)
    assert sorted(line_dedup.line_decisions(docs).collect()) == want


def test_recall_on_the_given_table(sample):
    rows = sample.collect()
    got = line_dedup.line_decisions(sample).collect()
    assert hold(got, [r.text for r in rows], [r.doc_id for r in rows]) >= 0.9


def test_layout_keeps_recall_at_any_size():
    for lines in (0, 1, 1000, 10 ** 6, 10 ** 9, 10 ** 12):
        width, tables = line_dedup.layout(lines)
        assert lines / 2 ** width <= 16 and (1 - (1 - line_dedup.APART) ** width) ** tables <= line_dedup.MISS
        assert line_dedup._places(width, tables).shape == (tables, width)


def test_repeated_and_null_ids_have_their_own_lines(documents):
    random.seed(4)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
    one, two = ([" ".join(random.sample(words, 40)) for _ in range(12)] for _ in range(2))
    near = [" ".join(line.split()[:-1] + ["other"]) for line in one]
    docs = documents(["\n".join(x) for x in (one, two, near, near)], ids=[1, 1, 1, None])
    rows = line_dedup.line_summary(docs).collect()
    assert sorted(r.n_dropped for r in rows if r.doc_id == 1) == [0, 0, 12]
    assert [r.n_dropped for r in rows if r.doc_id is None] == [12]
    cleaned = [r.text for r in line_dedup.drop_lines(docs).collect()]
    assert sorted(map(len, cleaned))[:2] == [0, 0]


def test_texts_without_dropped_lines(documents):
    docs = documents(["a b c\n\nd e", "A  b c\nnew line", None, "only"], extra=", gone bigint, __id bigint, __gone bigint")
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "a b c\n\nd e", 1: "new line", 2: None, 3: "only"}
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in line_dedup.line_summary(docs).collect()}
    assert rows == {0: (3, 0, ""), 1: (2, 1, "0"), 2: (1, 0, ""), 3: (1, 0, "")}


def test_repeated_ids_and_empty_table(documents):
    rows = line_dedup.line_summary(documents(["same line", "same line", "same line"], ids=[1, 1, 2])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in rows) == [(1, 0), (1, 0), (2, 1)]
    assert line_dedup.line_summary(documents([])).count() == 0


def test_variants_of_short_and_long_lines_are_one_group(documents):
    random.seed(6)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 9))) for _ in range(3000)]
    long = [" ".join(random.sample(words, 40)) for _ in range(60)]
    near = [" ".join(w if n % 9 else random.choice(words) for n, w in enumerate(line.split())) for line in long]
    short = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in range(5, 15) for _ in range(6)]
    edited = [s[:2] + s[3:] if len(s) < 10 else s[:1] + "é" + s[2:7] + s[8:] for s in short]
    texts = ["\n".join(x) for x in (long, near, short, edited)]
    rows = line_dedup.line_decisions(documents(texts)).collect()
    _, _, pairs = brute(texts, range(4))
    assert len(pairs) >= 100
    assert hold(rows, texts, range(4)) >= 0.99
    kept = {(r.doc_id, r.line): (r.keeper_id, r.keeper_line) for r in rows}
    groups, lines, _ = brute(texts[2:], [2, 3])  # of short lines every link is found
    forms = {}
    for i, n, form in lines:
        forms.setdefault(groups[form], set()).add(kept[i, n])
    assert all(len(keepers) == 1 for keepers in forms.values())


def outlined(forms):
    data, _, _, starts, ends, first, *_ = line_dedup._line_words(pa.array(forms))
    sizes, outlines = line_dedup._outlines(data, starts, ends, first)
    assert sizes.tolist() == [len(f) for f in forms]
    return sizes.astype(np.int64), outlines


def variants():
    random.seed(12)
    words = ["".join(random.choice("abcdefghé😀") for _ in range(random.randint(1, 9))) for _ in range(200)]
    one, two = [], []
    for n in (1, 2, 5, 20, 40, 90, 250) * 60:
        a = " ".join(random.choice(words) for _ in range(n))
        b = list(a) if random.random() < 0.7 else list(" ".join(random.choice(words) for _ in range(n)))
        for _ in range(int(len(b) * random.choice([0, 0.1, 0.18, 0.2, 0.22, 0.3]))):
            at = random.randrange(len(b))
            b[at:at + random.randint(0, 1)] = random.choice(["a", "é", ""])
        one.append(a)
        two.append(" ".join("".join(b).split()) or "a")
    return one, two


def test_outlines_reject_no_link():
    one, two = variants()
    sizes, outlines = outlined(one + two)
    data, offsets = hashing.text_bytes(outlines)
    codes = ((data[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()
    a, b = np.arange(len(one)), np.arange(len(one)) + len(one)
    can = line_dedup._comparable(sizes[a], sizes[b])
    a, b = a[can], b[can]
    far = line_dedup._far(codes, offsets[:-1] * 4, sizes, a, b)
    near = np.array([line_dedup.edits_within(one[x], two[x], int(max(sizes[x], sizes[y])) * 20 // 100) for x, y in zip(a, b)])
    assert near.sum() >= 100 and far.sum() >= 50 and not (far & near).any()


def test_only_lists_with_several_lines_are_dealt_on():
    width, tables = line_dedup.layout(10 ** 5)
    size = -(-width // 8)
    blocks = [np.random.default_rng(k).bytes(tables * size) for k in range(300)]
    blocks[7] = blocks[250]  # the same lists, so one of them is enough
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(300) + (1 << 33)), pa.array(blocks, pa.binary())], names=["node", "blocks"])
    parts = pa.Table.from_batches(line_dedup._dealt(width, tables, 5)(iter([rows])))
    assert sum(len(x) // 4 for x in parts.column("hashes").to_pylist()) == 300 * tables
    got = set()
    for part in range(5):
        shared = line_dedup._shared_lists(parts.filter(pc.equal(parts.column("part"), part)))
        got |= {tuple(x.values()) for x in shared.to_pylist()}
    assert {node for _, node in got} == {(1 << 33) + 7, (1 << 33) + 250} and len({name for name, _ in got}) == 1
