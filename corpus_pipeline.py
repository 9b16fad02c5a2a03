"""From raw documents to token ids: quality, exact copies, near copies, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlattice.llm import bpe, exact_dedup, mixing, quality, shingle_join
from barlattice.llm.catalog import TOKENIZER_FILE
from barlattice.llm.common import table, written
from barlattice.session import configure

#: Words of a shingle and percent of similarity at which two documents are near copies.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    configure(spark)
    return exact_dedup.drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    configure(spark)
    return shingle_join.drop_near_copies(docs, n=SHINGLE_WORDS, percent=NEAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    configure(spark)
    return mixing.emit(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, one row per copy."""
    configure(spark)
    return bpe.digest_columns(bpe.encode(docs, TOKENIZER_FILE, decoded=True))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can express neither the classifier nor the encoding; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
