"""Hard negatives against brute force; the tree against all distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphproof.llm import hard_negatives as H
from graphproof.llm.hard_negatives import Mining, Tree, mine_hard_negatives
from graphproof.session import Scratch

VECTORS = "vec_id long, label int, embedding array<double>, score int, leaf string"


def brute(rows, every=10, mining=Mining()):
    sound, anchors = {}, {}
    for vec, label, v in rows:
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * 256) for x in v):
            continue
        q = tuple(math.floor(x * 256) for x in v)
        sound.setdefault((vec, label, q), None)
        if vec % every == 0:
            anchors[vec] = min(anchors.get(vec, (label, q)), (label, q))
    out = set()
    for a, (label, q) in anchors.items():
        def best(same, low, high, k):
            found = {}
            for vec, other, v in sound:  # noqa: B023
                if vec != a and len(v) == len(q) and (other == label) == same:  # noqa: B023
                    s = max(H.LOWEST, min(H.HIGHEST, sum(x * y for x, y in zip(q, v, strict=True))))  # noqa: B023
                    if low <= 100 * s <= high:
                        found[vec] = max(s, found.get(vec, s))
            return sorted(found.items(), key=lambda f: (-f[1], f[0]))[:k]

        for positive, p in best(True, -math.inf, math.inf, mining.positives):
            for rank, (negative, s) in enumerate(best(False, mining.low * p, mining.high * p, mining.negatives), 1):
                out.add((a, positive, rank, negative, p, s))
    return out


def mined(spark, rows, every=10, mining=Mining()):
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], VECTORS)
    found = mine_hard_negatives(frame, F.col("vec_id") % every == 0, mining).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def clustered(n, width, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    v = centres[rng.integers(12, size=n)] + 0.4 * rng.normal(size=(n, width))
    return [(i, int(rng.integers(labels)), [float(x) for x in row]) for i, row in enumerate(v)]


def test_clusters_in_many_leaves_tiles_and_slices(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE_VALUES", 64 * 6)
    monkeypatch.setattr(H, "SLICE_VALUES", 64 * 6)
    rows = clustered(1500, 6, 1)
    rows += [(5000 + i, 1, rows[3][2]) for i in range(300)]  # a large group of equal vectors
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 2]), [rng.choice([-1.0, -0.5, 0.0, 0.3, 1.0]) for _ in range(3)]) for i in range(120)]  # many ties
    rows += [(i, rng.choice([0, 1]), [rng.uniform(-1, 1) for _ in range(5)]) for i in range(200, 260)]  # another length
    rows += [(i, 1, []) for i in range(300, 306)] + [(310, 0, []), (311, 0, [])]
    rows += [(400, None, [1.0, 0.0, 0.0]), (410, 1, None), (420, 1, [1.0, None, 0.0]), (430, 1, [math.nan, 0.0, 0.0]), (440, 0, [math.inf, 0.0, 0.0])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (450, 1, [1e306, 0.0, 0.0])]
    rows += rows[:40] + [(11, 0, [0.3, 0.3, 1.0]), (20, 5, [1.0, 1.0, 1.0])]  # repeated rows, and ids with other vectors
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == set()
    assert mined(spark, rows[:1]) == set()


def test_huge_components(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.choice([1.0, -1.0]) * 10 ** rng.uniform(0, 11) for _ in range(4)]) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_other_settings(spark):
    rows = clustered(300, 4, 7, labels=3)
    mining = Mining(positives=2, negatives=3, low=-50, high=120)
    assert mined(spark, rows, 25, mining) == brute(rows, 25, mining)
    with pytest.raises(ValueError, match="bits"):
        Mining(positives=63)


def test_tree_eliminates_and_loses_nothing(spark):
    rows = clustered(4000, 4, 3)
    frame = spark.createDataFrame([(*r, 1, "") for r in rows], VECTORS)
    scratch = Scratch(spark, "test")
    index = H.build_index(scratch.write(H.quantised_rows(frame, 256.0), "rows"), scratch)
    assert index.rows.count() == 4000
    q = np.floor(256 * np.array([r[2] for r in rows]))
    norms = (q * q).sum(axis=1)
    tree = Tree(q, 4_000_000, norms.max())  # as for many more rows, so that it is split twice
    tree.least[:], tree.most[:] = np.inf, -np.inf
    leaf = tree.route(q, norms, tree.least, tree.most)
    for number, split in enumerate(tree.nodes):
        tree.least[number, len(split.child) :], tree.most[number, len(split.child) :] = -np.inf, np.inf
    assert tree.leaves > 40
    anchors = q[:200]
    scores = anchors @ q.T
    high = np.sort(scores, axis=1)[:, -10]
    low = 0.9 * high
    window, reached = tree.surviving(anchors, norms[:200], np.arange(200), low, high)
    pairs = set(zip(window.tolist(), reached.tolist(), strict=True))
    needed = {(int(a), int(leaf[x])) for a, x in np.argwhere((scores >= low[:, None]) & (scores <= high[:, None]))}
    assert needed <= pairs
    assert len(pairs) < 0.5 * 200 * tree.leaves
