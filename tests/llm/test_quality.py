"""Neighbour votes against brute force, accuracy on held-out rows, awkward rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphproof.llm import quality
from graphproof.llm.quality import Model, bag, train


def frames(spark):
    rng, docs, labels = random.Random(2), [], []
    for i in range(300):
        words = rng.choices(["river", "stone", "meadow", "cloud", "bridge", "lantern"], k=40)
        if i % 3 == 0:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * 40
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 3 > 0), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_votes_equal_brute_force():
    rng = np.random.default_rng(4)
    axes, vectors = rng.normal(size=(quality.TERMS, 6)), rng.normal(size=(50, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 50).astype(float)
    model = Model(np.ones(quality.TERMS), axes, vectors, labels, 0.3)
    bags = np.stack([bag(t) for t in ("one two", "Three THREE three", "4 five, six!", "")])
    got = model.vote(bags)
    for x, score in zip(model.project(bags)[:3], got[:3], strict=True):
        near = sorted(range(50), key=lambda i: -x @ vectors[i])[: quality.NEIGHBOURS]
        weight = [max(0.0, x @ vectors[i]) ** quality.SHARPNESS for i in near]
        assert np.isclose(score, np.dot(weight, labels[near]) / sum(weight))
    assert got[3] == 0.3


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = frames(spark)
    model = train(docs, labels, F.col("doc_id") % 5 != 0)
    score = quality.quality(spark, model)
    rows = docs.filter("doc_id % 5 = 0").select("doc_id", score("text").alias("s")).collect()
    assert sum((r.s >= 0.5) == (r.doc_id % 3 > 0) for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "river " * 80_000), (4, "😀 a"), (4, "😀 a")], "doc_id long, text string")
    out = [r.s for r in odd.select(score("text").alias("s")).collect()]
    assert len(out) == 5 and all(0 <= s <= 1 for s in out) and out[0] == out[1] == model.prior and out[3] == out[4]
    assert odd.limit(0).select(score("text")).count() == 0


def test_without_labels(spark):
    docs, labels = frames(spark)
    model = train(docs, labels.limit(0))
    assert {r.s for r in docs.select(quality.quality(spark, model)("text").alias("s")).collect()} == {0.5}
