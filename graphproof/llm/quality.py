"""Quality: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed terms: byte trigrams, trigrams of its character-class runs, and a term for
each share of ``REPEATS`` that its words repeating the word before them reach. Bags are log-scaled, weighted by inverse document
frequency and projected on the leading right singular vectors of a labelled sample (latent
semantic analysis). The sample has at most ``TRAIN_ROWS`` expected rows, so its vectors are a
bounded broadcast. Every document is compared with all of them: blocks of documents by exact cosine
products, and the ``NEIGHBOURS`` nearest vote with their similarity as weight.

All text of a document counts, whatever its length; memory follows one block of bags and one batch
of texts.

Defined cases: null and empty texts have the zero vector, no neighbours, and get the share of label
1 in the sample; without training rows all scores are 0.5; repeated labels of a document count as
1 if one is; repeated rows score alike; empty tables give no rows.
"""

from __future__ import annotations

import dataclasses
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import table
from graphproof.llm.toxicity import training_sample
from graphproof.session import Scratch

TRAIN_ROWS = 3_000
NEIGHBOURS = 15
DIMENSIONS = 64
#: Weights fall with similarity to this power.
SHARPNESS = 4
#: Hash buckets of byte trigrams and of class trigrams; the last terms are the shares of repeated words.
BYTES, CLASSES = 2048, 256
REPEATS = np.array([0.05, 0.15, 0.4, 0.7])
TERMS = BYTES + CLASSES + len(REPEATS)
BLOCK = 512


def _class_table() -> np.ndarray:
    """Class of each byte: letters by case, digits, white space, other scripts, each sign its own."""
    out = np.arange(256, dtype=np.uint32)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", "a"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("0123456789", "0"), (" \t\n\x0b\x0c\r", " ")):
        out[np.frombuffer(chars.encode(), np.uint8)] = ord(kind)
    out[128:] = 128
    return out


_CLASS = _class_table()


def _hashed(x: np.ndarray, buckets: int) -> np.ndarray:
    """Counts of the trigrams of a sequence in so many buckets (a power of two)."""
    if len(x) < 3:
        return np.zeros(buckets, np.float32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets).astype(np.float32)


def bag(text: str) -> np.ndarray:
    """Log-scaled term counts of a text; both kinds of trigrams have norm 1 (or 0)."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(b):
        return np.zeros(TERMS, np.float32)
    kinds = _CLASS[b]
    runs = kinds[np.flatnonzero(np.diff(kinds, prepend=np.uint32(0)))]
    words = text.split()
    again = sum(map(operator.eq, words, words[1:]))
    repeats = np.where(again >= REPEATS * max(1, len(words)), again, 0).astype(np.float32)
    return np.log1p(np.concatenate([_hashed(b.astype(np.uint32), BYTES), _hashed(runs, CLASSES), repeats]))


@dataclasses.dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # of the labelled rows
    labels: np.ndarray
    prior: float

    def weigh(self, bags: np.ndarray) -> np.ndarray:
        x = bags * self.idf
        for part in (slice(0, BYTES), slice(BYTES, TERMS)):
            x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
        return x

    def project(self, bags: np.ndarray) -> np.ndarray:
        x = self.weigh(bags) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vote(self, bags: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(bags), self.prior)
        cosine = self.project(bags) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        share = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
        return np.where(bags.any(axis=1) & (total > 0), share, self.prior)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, scratch: Scratch | None = None) -> Model:
    """A model of ``labels.quality``, learnt from labelled rows for which ``usable`` (of doc_id) holds."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    sample = training_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, TRAIN_ROWS, scratch)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bag": [bag(t).astype(np.float16).tobytes() for t in batch["text"]], "label": batch["label"]})

    rows = sample.mapInPandas(bags, "bag binary, label int").collect()  # the bounded sample, 5 kB a row
    y = np.array([float(r.label) for r in rows])
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x = np.stack([np.frombuffer(r.bag, np.float16) for r in rows]).astype(np.float32)
    idf = np.log((len(x) + 1) / ((x > 0).sum(0) + 1)).astype(np.float32) + np.float32(0.1)
    model = Model(idf, np.zeros((0, 0)), np.zeros((0, 0)), y, float(y.mean()))
    weighed = model.weigh(x)
    _, vectors = np.linalg.eigh(weighed.T @ weighed)
    model = dataclasses.replace(model, axes=np.ascontiguousarray(vectors[:, -DIMENSIONS:], dtype=np.float32))
    return dataclasses.replace(model, vectors=model.project(x))


def quality(spark: SparkSession, model: Model):
    """A column function: text -> score from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [np.zeros(0)]
            for i in range(0, len(texts), BLOCK):
                parts.append(shared.value.vote(np.stack([bag(t or "") for t in texts.iloc[i:i + BLOCK]])))
            yield pd.Series(np.concatenate(parts))

    return score


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs, table(spark, folder, "labels"), remainder != 1)
    scored = docs.select(
        "doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"),
        quality(spark, model)(F.col("text").cast("string")).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
