import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from barlattice.llm import mixing, quality
from tests.llm.test_shingle_join import brute


def test_pipeline_equals_plain_version(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    rejected = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 0").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in rejected}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    largest = {}
    for i in sorted(texts):
        largest[lower(texts[i])] = i
    left = sorted(largest.values())
    found = brute([texts[i] for i in left], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.NEAR_PERCENT)
    left = [i for k, i in enumerate(left) if found[k][1] == k]
    copies = {r.doc_id: r.copies for r in mixing.mix(docs.filter(docs.doc_id.isin(left))).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i in left:
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids
        row = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
        want += [row] * copies[i]
    assert got == sorted(want) and len(set(got)) > 20


def test_stages_return_documents(spark, documents):
    docs = documents([None, "", "some words here", "some words here"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
    empty = documents([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
