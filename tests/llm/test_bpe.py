import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barlattice.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
POOL = ["a", "aaaa", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "²", "Ⅷ", "٣", "हिन्दी", "中文", "😀", "é", "é",
        "'s", "'S", "'ll", "_", "12", "!!", "<|endoftext|>", "<|endoftext|", "×", "ª", "\x00", "﻿", "the", "ing"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_padding()
    t.no_truncation()
    return t


def test_ids_equal_the_library(spark, library, sample):
    random.seed(3)
    texts = ["".join(random.choice(POOL) for _ in range(random.randint(0, 25))) for _ in range(1500)]
    texts += ["a" * 20_000, "ab" * 20_000, None, "", "x y " * 30_000] + [r.text for r in sample.select("text").collect()]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids bigint")
    found = bpe.decode(bpe.encode(docs, FILE), FILE).collect()
    assert len(found) == len(texts)
    for r in found:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(np.frombuffer(r.ids, "<u4")) == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.decoded == (texts[r.doc_id] or "")


def test_digests(documents, library):
    two = bpe.decode(bpe.encode(documents(["hello", None, "é"]), FILE), FILE).collect()
    assert two == bpe.encode(documents(["hello", None, "é"]), FILE, decoded=True).collect()
    r = bpe.digest_columns(bpe.decode(bpe.encode(documents(["hello"]), FILE), FILE)).first()
    ids = np.array(library.encode("hello", add_special_tokens=False).ids, "<u4")
    assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(b"hello").hexdigest()


def test_small_parts_and_forgetting(library, monkeypatch, sample):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    encoder = bpe.Encoder(bpe.Tokenizer(open(FILE, "rb").read()))
    for row in sample.limit(40).collect():
        assert list(encoder.encode([row.text])[0]) == library.encode(row.text, add_special_tokens=False).ids


def test_broken_bytes_decode(library):
    t = bpe.Tokenizer(open(FILE, "rb").read())
    ids = library.encode("é", add_special_tokens=False).ids + library.encode("😀", add_special_tokens=False).ids[:1]
    assert t.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_empty_table(documents):
    assert bpe.decode(bpe.encode(documents([]), FILE), FILE).count() == 0
