"""The pivot index against brute-force cosines: no false link, recall of at least 0.9."""

import numpy as np
import pandas as pd

from graphproof.llm import pivot_index
from graphproof.llm.pivot_index import vector_links


def made(seed, clusters=40, alone=600, width=32):
    """Unit vectors, some in clusters whose pairs have cosines around 0.9, some equal."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=width) for _ in range(alone)]
    for _ in range(clusters):
        center = rng.normal(size=width)
        center /= np.linalg.norm(center)
        for _ in range(rng.integers(2, 12)):
            rows.append(center + rng.normal(size=width) * rng.choice([0.02, 0.05, 0.06]))
    rows += [rows[k].copy() for k in rng.integers(0, len(rows), 60)]
    rows += [rows[-1].copy() for _ in range(150)]
    return np.array(rows, np.float32)


def brute(x):
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    return linked, pivot_index._components_of(linked)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [None if v is None else float(v) for v in r], 1) for i, r in rows], "vec_id long, embedding array<float>, label int")


def test_recall_and_no_false_links(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "TILE", 60)
    x = made(1)
    linked, component = brute(x)
    rows = {r.vec_id: r for r in vector_links(frame(spark, enumerate(x))).collect()}
    found = np.array([rows[i].n_links for i in range(len(x))])
    assert (found <= linked.sum(1)).all()
    assert found.sum() >= 0.95 * linked.sum()
    same = np.mean([rows[i].component_id == component[i] for i in range(len(x))])
    assert same >= 0.97


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
        (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0]), (13, [3e38, 0.0]),
    ]
    out = sorted((str(r.vec_id), r.n_links, r.component_id) for r in vector_links(frame(spark, rows)).collect())
    lonely = [(str(i), 0, i) for i in (1, 2, 3, 4, 5, 6, 10, 11)]
    linked = [(str(i), 4, 7) for i in (7, 8, 9, 9, 12, 13)]
    assert out == sorted([*lonely, *linked, ("None", 0, None)])
    assert vector_links(frame(spark, rows).limit(0)).count() == 0


def test_cells_of_one_and_of_two_tiles():
    rng = np.random.default_rng(5)
    pivot, n = 20, 90
    centers = rng.normal(size=(30, 16))
    x = np.concatenate([c + rng.normal(size=(3, 16)) * 0.08 for c in centers])
    others = np.array([rng.permutation([p for p in range(18, 60) if p != pivot])[:4] for _ in range(n)])
    prefix = np.concatenate([np.full((n, 1), pivot), np.repeat(others[::3], 3, axis=0)], axis=1)
    prefix[::4, 1:] = others[::4]
    prefix[::9, 1:] = np.arange(21, 25)
    sets, unit = [set(p) for p in prefix.tolist()], x / np.linalg.norm(x, axis=1, keepdims=True)
    for tiles in (1, 2):
        side = rng.integers(0, tiles, n)
        want = np.zeros((n, n), bool)
        for i in range(n):
            for j in range(n):
                shared = sets[i] & sets[j]
                apart = tiles == 1 or side[i] != side[j]
                want[i, j] = i != j and apart and len(shared) >= 2 and min(shared) == pivot and unit[i] @ unit[j] >= 0.9
        assert want.sum() > 20
        order = rng.permutation(n)
        group = pd.DataFrame({"id": np.arange(n) * 3, "n": rng.integers(1, 4, n), "embedding": list(x), "prefix": list(prefix), "pivot": pivot, "side": side})
        got = pivot_index.search(group.iloc[order]).set_index("id")
        links, near = want @ group["n"].to_numpy(), group["id"].to_numpy()[pivot_index._components_of(want)]
        assert {i: (r.links, r.near) for i, r in got.iterrows()} == {i * 3: (links[i], near[i]) for i in range(n) if links[i]}


def test_rows_are_compared_only_where_they_meet_under_another_pivot():
    prefix = np.array([[7, 1], [7, 9], [7, 9], [7, 8]])
    found = pivot_index._candidates(prefix, prefix, 7)
    assert [(i, j) for i, j in zip(*np.nonzero(found), strict=True) if i < j] == [(1, 2)]
    two = pivot_index._candidates(prefix[:1], prefix[1:], 7)
    assert two.shape == (1, 3) and not two.any()  # no cell within a tile
    assert pivot_index._candidates(np.array([[7]]), np.array([[7], [7]]), 7).all()  # a single pivot
