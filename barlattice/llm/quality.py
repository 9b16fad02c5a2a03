"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

Documents are counts of hashed letter triples and of byte classes, damped and weighted by how rare
each feature is in the sample. The sample's leading singular directions make the latent space.
The sample's vectors and labels are broadcast: at most ``PER_CLASS`` of each label, with ``DIMS``
numbers each. Every document is compared with all of them, in blocks of documents, and its score is
the mean label of the ``NEIGHBOURS`` most similar ones, weighted by similarity. Sample rows as similar
as the last of these (to five decimals) all vote, so no order among ties matters.

The sample are the labelled rows with the smallest digests of their ids; labels of the rows held out
(crc32 of the id modulo ``FOLDS`` is 0) are never read. The score depends on the text alone.

Defined cases: null and empty texts have the zero vector and get the share of label 1 in the sample's
labelled rows; equal texts get equal scores; rows that repeat an id are scored one by one; of several
labels of one id the least counts, and labels other than 0 and 1 do not; without labelled rows every score is 0.5; an empty table gives an empty result; long texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm import hashing
from barlattice.llm.common import whole_text

#: Labelled rows of each class at most, dimensions, neighbours, hashed features.
PER_CLASS, DIMS, NEIGHBOURS, FEATURES = 2000, 48, 15, 1024
FOLDS, THRESHOLD = 5, 0.3
#: Documents of a block of products.
BLOCK = 512
_CLASSES = np.full(256, 1, np.int64)  # letters beyond ASCII
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 2, 3, 4
_CLASSES[[9, 10, 11, 12, 13, 32]] = 5
_CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = [6 + i % 8 for i in range(32)]


def features(texts: pa.Array) -> np.ndarray:
    """Damped relative counts of hashed byte triples, and of triples of byte classes."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    half = FEATURES // 2
    for a, b in hashing.slices(texts, 1_000_000, BLOCK):
        data, offsets = hashing.text_bytes(texts.slice(a, b - a))
        if len(data) < 3:
            continue
        owner = np.repeat(np.arange(b - a), np.diff(offsets))
        inside = owner[2:] == owner[:-2]
        low = hashing._LOWER[data].astype(np.uint32)
        triple = (low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)
        shape = _CLASSES[data]
        shape = (shape[:-2] * 211 + shape[1:-1] * 17 + shape[2:]) % half
        at = owner[:-2][inside] * FEATURES
        counts = np.bincount(np.concatenate([at + (triple[inside] % np.uint32(half)).astype(np.int64), at + half + shape[inside]]),
                             minlength=(b - a) * FEATURES).reshape(b - a, FEATURES)
        total = np.maximum(counts[:, :half].sum(axis=1, keepdims=True), 1)
        out[a:b] = np.sqrt(counts / total)
    return out


@dataclass(frozen=True)
class Model:
    """What scoring needs: weights, directions, and the sample's unit vectors and labels."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.weights) @ self.directions
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, size, out=np.zeros_like(latent), where=size > 0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(rows), BLOCK):
            # padded to one shape, so that a document's products do not depend on its block
            block = np.zeros((BLOCK, rows.shape[1]), np.float32)
            held = rows[start:start + BLOCK]
            block[:len(held)] = held
            latent = self.embed(block)
            alike = np.round(latent @ self.vectors.T, 5)
            last = np.partition(alike, -k, axis=1)[:, -k, None]
            weight = np.where(alike >= last, np.maximum(alike, 0), 0).astype(np.float64)
            votes = (weight * self.labels).sum(axis=1)
            total = weight.sum(axis=1)
            found = np.divide(votes, total, out=np.full(BLOCK, self.prior), where=total > 0)
            out[start:start + len(held)] = found[:len(held)]
        return np.clip(out, 0.0, 1.0)


def held_out(row_id: str) -> Column:
    return F.crc32(F.col(row_id).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id",
        label: str = "quality") -> Model:
    """Fit on at most PER_CLASS rows of each label; only these come to the driver, as features."""
    usable = (labels.select(F.col(row_id), F.col(label).cast("int").alias("label"))
              .filter(F.col("label").isin(0, 1) & F.col(row_id).isNotNull() & ~held_out(row_id))
              .groupBy(row_id).agg(F.min("label").alias("label")))
    order = F.md5(F.col(row_id).cast("string").cast("binary"))
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy(order, row_id).limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    share = usable.agg(F.avg("label")).first()[0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in hashing.slices(batch.column(2), 1_000_000, BLOCK):
                held = features(batch.column(2).slice(a, b - a)).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.tobytes() for x in held], pa.binary())],
                    names=["id", "label", "held"])

    # at most 2 * PER_CLASS ids of a few bytes each
    kind = docs.schema[row_id].dataType.simpleString()
    sample = (docs.select(row_id, text).join(F.broadcast(chosen), row_id).select(F.col(row_id).alias("id"), "label", whole_text(text).alias("text"))
              .mapInArrow(rows, f"id {kind}, label int, held binary")
              .groupBy("id", "label").agg(F.min("held").alias("held")).toArrow())  # one row where an id repeats
    sample = sample.take(pa.compute.sort_indices(sample, [("label", "ascending"), ("held", "ascending")]))
    if not len(sample):
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32),
                     np.zeros(0), 0.5)
    matrix = np.frombuffer(b"".join(x.as_py() for x in sample.column("held")), np.float16).reshape(-1, FEATURES).astype(np.float32)
    spread = (matrix > 0).sum(axis=0)
    weights = np.log((1 + len(matrix)) / (1 + spread)).astype(np.float32) + 1
    scaled = (matrix * weights).astype(np.float64)
    values, vectors = np.linalg.eigh(scaled.T @ scaled)
    directions = vectors[:, ::-1][:, :DIMS].astype(np.float32)
    model = Model(weights, directions, np.zeros((0, DIMS), np.float32), np.zeros(0), float(share))
    return Model(weights, directions, model.embed(matrix), np.asarray(sample.column("label")).astype(np.float64), float(share))


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the column ``score``, in place of one of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != score]
    docs = docs.select(*names)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            scores = np.concatenate([sent.value.score(features(texts.slice(a, b - a)))
                                     for a, b in hashing.slices(texts, 1_000_000, BLOCK)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, score])
        hashing.give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{score}` double")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: its id, held_out, score and predicted."""
    scored = with_scores(docs.select(row_id, text), fit(docs, labels, text, row_id), text)
    return scored.select(row_id, F.coalesce(held_out(row_id), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The documents that the classifier does not reject."""
    held = "score" + "_" * max(map(len, docs.columns))  # longer than any name of docs
    scored = with_scores(docs, fit(docs, labels, text, row_id), text, held)
    return scored.filter(F.col(held) >= THRESHOLD).select(*docs.columns)
