"""Embedding near-dedup: a pivot-permutation index.

1. Equal vectors form one class (its smallest vec_id stands for it); later steps see each class once.
2. Pivots are chosen far from one another among a bounded sample of vectors. Each vector is described
   by its ``PREFIX`` nearest pivots in order.
3. Inverted lists: a vector is in the list of each pivot of its prefix. Vectors of a list are
   candidates of each other if they share at least ``SHARED`` pivots (counted along inverted lists within the list).
   A pair is handled in the list of its smallest shared pivot only, so it counts once.
4. Candidates are verified by their cosine in double precision, block by block. A list longer than
   ``TILE`` is dealt into tiles, and each pair of tiles is a group of its own: every vector is in
   the index and no list is cut, however long.
5. Blocks return link counts per vector and the connections within the block, never all pairs;
   components are found by distributed contraction.

Recall on pairs at cosine 0.9 or more is measured against brute force in the tests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; nor do vectors of different lengths; rows that repeat a vec_id with the same vector
count once as others' links; a null vec_id has no links and a null component; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import table
from graphproof.llm.components import components
from graphproof.session import Scratch

COSINE = 0.9
#: Vectors that pivots are chosen from, and pivots, at most.
SAMPLE, MOST_PIVOTS = 4096, 2048
PREFIX, SHARED = 8, 2
TILE = 1000


def _classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct valid vector: id (smallest vec_id), embedding, n (distinct vec_ids)."""
    valid = vectors.filter(
        "vec_id IS NOT NULL AND size(embedding) > 0 "
        "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    )
    once = valid.select("embedding", "vec_id").distinct()
    return once.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of rows of ``sample`` (unit vectors)."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def _unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)  # so that squares of huge or tiny values stay finite
    rows = rows / np.where(scale == 0, 1, scale)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _pivots(classes: DataFrame) -> np.ndarray:
    """Unit pivots; their number grows with the root of the number of classes, up to the bound."""
    count = min(MOST_PIVOTS, 1 << math.ceil(math.log2(max(PREFIX, 4 * math.sqrt(max(1, classes.count()))))))
    drawn = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
    width = max((len(r.embedding) for r in drawn), default=1)
    rows = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        rows[i, : len(r.embedding)] = r.embedding
    return choose_pivots(_unit(rows), count) if len(drawn) else np.zeros((1, 1))


def _described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """classes with ``prefix``: the numbers of the nearest pivots, nearest first."""
    k = min(PREFIX, len(pivots))

    @F.pandas_udf("array<int>")
    def prefix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = np.zeros((len(vectors), k), np.int32)
            lengths = vectors.map(len).to_numpy()
            for d in np.unique(lengths):  # pivots are cut or filled up with zeros for other lengths
                at = np.flatnonzero(lengths == d)
                own = _unit(np.stack([np.asarray(v, np.float64) for v in vectors.iloc[at]]))
                width = min(d, pivots.shape[1])
                cosine = own[:, :width] @ pivots[:, :width].T
                near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(cosine, near, axis=1), axis=1, kind="stable")
                out[at] = np.take_along_axis(near, order, axis=1)
            yield pd.Series(list(out))

    return classes.withColumn("prefix", prefix("embedding"))


def _components_of(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric boolean matrix is connected with."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _by_pivot(prefix: np.ndarray) -> dict[int, np.ndarray]:
    """The rows that have each pivot in their prefix."""
    order = np.argsort(prefix, axis=None, kind="stable")
    pivots, starts = np.unique(prefix.ravel()[order], return_index=True)
    return dict(zip(pivots.tolist(), np.split(order // prefix.shape[1], starts[1:]), strict=True))


def _candidates(left: np.ndarray, right: np.ndarray, pivot: int) -> np.ndarray:
    """Which rows of ``left`` and ``right``, prefixes with ``pivot``, share enough pivots and none before it. Only rows that meet
    under another pivot are touched."""
    shared = np.ones((len(left), len(right)), np.int8)
    earlier = np.zeros(shared.shape, bool)
    others = _by_pivot(right)
    for other, rows in _by_pivot(left).items():
        if other != pivot and other in others:
            met = rows[:, None], others[other]
            if other < pivot:
                earlier[met] = True
            else:
                shared[met] += 1
    return (shared >= min(SHARED, left.shape[1])) & ~earlier


def search(group: pd.DataFrame) -> pd.DataFrame:
    """Link counts and connections of one pair of tiles (or one tile) of a pivot's list."""
    group = group.sort_values("id", ignore_index=True)
    prefix, side = np.stack(group["prefix"].to_list()), group["side"].to_numpy()
    left = right = np.arange(len(group))
    if side.any():  # two tiles: pairs within one are handled elsewhere
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    candidate = _candidates(prefix[left], prefix[right], int(group["pivot"].iat[0]))
    if not side.any():
        candidate = np.triu(candidate, 1)
    nothing = pd.DataFrame({"id": [], "links": [], "near": []})
    if not candidate.any():
        return nothing
    raw = np.stack([np.asarray(v, np.float64) for v in group["embedding"]])
    unit = _unit(raw)
    rows, columns = np.nonzero(candidate & (unit[left] @ unit[right].T >= COSINE - 1e-6))
    # at the threshold itself the plain formula decides, not the block product's rounding
    linked = [
        (i, j) for i, j in zip(left[rows], right[columns], strict=True)
        if abs(unit[i] @ unit[j] - COSINE) > 1e-6 or raw[i] @ raw[j] / (np.linalg.norm(raw[i]) * np.linalg.norm(raw[j])) >= COSINE
    ]
    if not linked:
        return nothing
    at, place = np.unique(np.array(linked), return_inverse=True)  # most rows have no link
    one, other = place.reshape(-1, 2).T
    matrix = np.zeros((len(at), len(at)), bool)
    matrix[one, other] = matrix[other, one] = True
    ids = group["id"].to_numpy()[at]
    return pd.DataFrame({"id": ids, "links": matrix @ group["n"].to_numpy()[at], "near": ids[_components_of(matrix)]})


def vector_links(vectors: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id of every row of ``vectors`` (vec_id, embedding)."""
    scratch = scratch or Scratch(vectors.sparkSession, "pivots")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    classes = scratch.write(_classes(vectors), "classes")
    pivots = _pivots(classes)
    listed = scratch.write(_described(classes, pivots), "described")

    # lists in tiles; the sizes table has a row per pivot at most
    lists = listed.select("*", F.explode("prefix").alias("pivot"), F.size("embedding").alias("width"))
    sizes = lists.groupBy("pivot", "width").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    lists = lists.join(sizes, ["pivot", "width"]).withColumn("tile", F.expr("CAST(pmod(xxhash64(id), tiles) AS INT)"))
    pairs = lists.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    cells = pairs.select(
        "id", "n", "embedding", "prefix", "pivot", "width",
        F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"),
        F.when(F.col("tile") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    found = cells.groupBy("pivot", "width", "t1", "t2").applyInPandas(search, "id long, links long, near long")
    found = scratch.write(found, "found")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.selectExpr("id AS a", "near AS b"), scratch, "groups").withColumnRenamed("node", "id")
    per_class = classes.join(counts, "id", "left").join(groups, "id", "left").select(
        F.col("embedding").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("least"),
    )
    joined = vectors.join(per_class, (vectors["embedding"] == per_class["of"]) & vectors["vec_id"].isNotNull(), "left")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"),
    )


def op3_pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_links(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs; the index reaches the same links as far as its recall goes.
OP3_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE x = e.vec_id) AS BIGINT) AS n_links,
  least(e.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = e.vec_id), e.vec_id)) AS component_id,
  least(e.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = e.vec_id), e.vec_id)) = e.vec_id AS kept
FROM embeddings e
"""
