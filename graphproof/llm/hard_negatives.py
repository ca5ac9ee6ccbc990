"""Hard-negative mining: a GNAT-style multiway hyperplane tree, searched with windows of scores.

Components are quantised to integers; the score of two vectors is their integer inner product. An anchor's positives are its best
rows of the same label, its negatives the best rows of other labels whose score lies in a window below a positive's.

* **Metric.** With M the largest norm, a row x gets one more coordinate, sqrt(M^2 - |x|^2), and an anchor a zero there.
  Then |a - x|^2 = |a|^2 + M^2 - 2 <a, x>: a window of scores is an annulus of distances around the anchor.
* **Tree.** Split points are chosen farthest-first among a sample (at most ``SAMPLE_ROWS`` rows and ``SAMPLE_VALUES`` components);
  a row goes to its nearest one, down to a leaf. Every row is indexed. Each split point stores the least and greatest
  distance to the rows of each sibling subtree, taken over all rows with map-side combined minima.
* **Search.** A subtree is eliminated if for some split point its stored range misses what the triangle inequality leaves of
  the annulus. Windows are narrowed first: the k-th best fitting score within the sample is a floor for the k-th best of all.
* **Leaves** are exact. Leaves longer than a tile are dealt into tiles, anchors of a leaf into slices, and each pair of
  a tile and a slice is one bounded group that returns the first k per window. No row, tile or partner is left out, so
  the result equals the brute-force one (recall 1, tested).

Defined cases: rows with a null vec_id, label or vector, or with a component that is null, not finite or not finite when scaled, take
no part; vectors of different lengths never meet; empty vectors score 0; a row that repeats a vec_id with equal label and vector counts
once, of differing ones the best-scored counts per window, and the anchor is the one least by (label, vector); scores beyond
a long are held at its ends; an empty table gives no rows. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphproof.llm.common import table
from graphproof.session import Scratch

#: Rows and components of the sample that split points and floors come from, at most.
SAMPLE_ROWS, SAMPLE_VALUES = 8192, 1 << 22
#: Split points of a node, at most.
ARITY = 16
#: Components of a tile of rows and of a slice of anchors, at most (but for 64 rows, which may always be together).
TILE_VALUES, SLICE_VALUES = 1 << 18, 1 << 17
#: Scores that are held at once.
BLOCK = 1 << 22
#: Integers up to here are exact in double precision, sums in any order included.
EXACT = 1 << 53
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
INDEX = "vec_id long, label long, width int, norm double, q binary, leaf int, slot int, ranges array<double>"


@dataclass(frozen=True)
class Mining:
    """``positives`` best rows of an anchor's label; per positive, ``negatives`` rows of other labels that score ``low`` to ``high``
    percent of it; components are multiplied by ``scale`` and rounded down."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: float = 256.0

    def __post_init__(self):
        if not 0 < self.positives < 63:
            raise ValueError("windows of an anchor are named by the bits of a long: 1 to 62 positives")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary vectors of one width as rows."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column) or not width:
        return np.zeros((len(column), width))
    first = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]
    return np.frombuffer(column.buffers()[2], "<f8", len(column) * width, int(first)).reshape(len(column), width)


def _quantiser(scale: float):
    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            ends = lists.offsets.to_numpy()
            q = np.floor(lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).astype("<f8") * scale)
            sizes = np.diff(ends)
            with np.errstate(over="ignore"):
                norms = np.bincount(np.repeat(np.arange(len(sizes)), sizes), q * q, len(sizes)).astype(np.float64)
            places = pa.py_buffer(((ends - ends[0]) * 8).astype(np.int32))
            binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, places, pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(sizes.astype(np.int32)), pa.array(norms), binary],
                ["vec_id", "label", "width", "norm", "q"],
            )

    return quantised


def quantised_rows(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, width, norm (squared), q (components as doubles) of the rows that take part."""
    largest = sys.float_info.max / max(scale, 1.0)
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND "
        f"forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) <= CAST({largest!r} AS DOUBLE))"
    )
    return sound.mapInArrow(_quantiser(scale), "vec_id long, label long, width int, norm double, q binary")


@dataclass
class _Split:
    points: np.ndarray  # split points x components
    lift: np.ndarray  # their added coordinates
    child: list[int] = field(default_factory=list)  # a node, or ~leaf


class Tree:
    """Splits of the sample, and the distance ranges of all rows."""

    def __init__(self, sample: np.ndarray, rows: int, top: float):
        """``rows`` in all, of squared norm ``top`` at most."""
        self.top, self.nodes, self.leaves = top, [], 0
        width = sample.shape[1]
        self.lift_of = lambda norms: np.sqrt(np.maximum(self.top - norms, 0))
        self.tile = max(64, TILE_VALUES // max(width, 1))
        self._lift = self.lift_of((sample * sample).sum(axis=1))
        self._share = rows / max(1, len(sample))
        self.root = self._grow(sample, np.arange(len(sample)))
        self.least = np.full((len(self.nodes), ARITY, ARITY), -np.inf)  # node, split point, subtree
        self.most = np.full((len(self.nodes), ARITY, ARITY), np.inf)
        del self.lift_of, self._lift

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def _grow(self, sample: np.ndarray, at: np.ndarray) -> int:
        if len(at) < 2 * ARITY or len(at) * self._share <= self.tile:
            return self._leaf()
        own, lift = sample[at], self._lift[at]
        chosen, near = [0], None
        while len(chosen) < ARITY:  # farthest first
            d = self.distances(own, lift, own[chosen[-1:]], lift[chosen[-1:]])[:, 0]
            near = d if near is None else np.minimum(near, d)
            if not near.max() > 1e-6 * np.sqrt(self.top):
                break
            chosen.append(int(near.argmax()))
        if len(chosen) < 2:
            return self._leaf()
        split, number = _Split(own[chosen], lift[chosen]), len(self.nodes)
        self.nodes.append(split)
        home = self.distances(own, lift, split.points, split.lift).argmin(axis=1)
        split.child = [self._grow(sample, at[home == j]) for j in range(len(chosen))]
        return number

    def distances(self, rows: np.ndarray, lift: np.ndarray, points: np.ndarray, lifts: np.ndarray) -> np.ndarray:
        """Between rows and split points; all have the norm M with the added coordinate."""
        width = min(rows.shape[1], points.shape[1])
        cross = rows[:, :width] @ points[:, :width].T + np.outer(lift, lifts)
        return np.sqrt(np.maximum(2 * self.top - 2 * cross, 0))

    def route(self, rows: np.ndarray, norms: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The leaf of each row; widens ``least`` and ``most`` by the distances seen."""
        lift, leaf = np.sqrt(np.maximum(self.top - norms, 0)), np.zeros(len(rows), np.int32)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            number, at = todo.pop()
            if number < 0:
                leaf[at] = ~number
                continue
            split = self.nodes[number]
            d = self.distances(rows[at], lift[at], split.points, split.lift)
            home, m = np.nan_to_num(d, nan=np.inf).argmin(axis=1), len(split.child)
            for j in np.unique(home):
                members = d[home == j]
                unknown = np.isnan(members).any(axis=0)
                least[number, :m, j] = np.minimum(least[number, :m, j], np.where(unknown, -np.inf, members.min(axis=0)))
                most[number, :m, j] = np.maximum(most[number, :m, j], np.where(unknown, np.inf, members.max(axis=0)))
                todo.append((split.child[j], at[home == j]))
        return leaf

    def surviving(self, anchors: np.ndarray, norms: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Pairs (window, leaf) that may hold a score of the window; window i is ``low[i]`` to ``high[i]`` around ``anchors[owner[i]]``."""
        base = norms[owner] + self.top
        inner, outer = np.sqrt(np.maximum(base - 2 * high, 0)), np.sqrt(np.maximum(base - 2 * low, 0))
        slack = 1e-5 * (np.sqrt(self.top) + np.sqrt(norms[owner]) + 1)  # far above the rounding of distances
        found, todo = [], [(self.root, np.arange(len(owner)))]
        while todo:
            number, at = todo.pop()
            if number < 0:
                found.append((at, np.full(len(at), ~number, np.int32)))
                continue
            split = self.nodes[number]
            m, width = len(split.child), min(anchors.shape[1], split.points.shape[1])
            cross = anchors[owner[at], :width] @ split.points[:, :width].T  # the anchor's added coordinate is zero
            d = np.sqrt(np.maximum(base[at, None] - 2 * cross, 0))
            nearest = np.maximum(d - outer[at, None], inner[at, None] - d) - slack[at, None]
            farthest = d + outer[at, None] + slack[at, None]
            for j in range(m):
                # written so that an unknown distance (NaN) eliminates nothing
                out = (self.most[number, :m, j] < nearest) | (self.least[number, :m, j] > farthest)
                rest = at[~out.any(axis=1)]
                if len(rest):
                    todo.append((split.child[j], rest))
        pairs = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pairs or [np.zeros(0, np.int64), np.zeros(0, np.int32)]


def _indexer(tree: Tree):
    """Rows with their leaf, and at the end of a task its distance ranges, one row per (node, subtree)."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "label", "width", "norm", "q", "leaf", "slot", "ranges"]
        least, most = np.full_like(tree.least, np.inf), np.full_like(tree.most, -np.inf)
        for batch in batches:
            widths, norms = batch.column("width").to_numpy(), batch.column("norm").to_numpy()
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                part = batch.take(pa.array(at)) if len(at) < len(widths) else batch
                leaf = tree.route(_matrix(part.column("q"), int(width)), norms[at], least, most)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64()))], names)
        node, subtree = np.nonzero((least < np.inf).any(axis=1) | (most > -np.inf).any(axis=1))
        if len(node):
            # minima of both, so that one kind of aggregate merges them
            ranges = np.concatenate([least[node, :, subtree], -most[node, :, subtree]], axis=1)
            empty = [pa.nulls(len(node), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())]
            slots = pa.array((node * ARITY + subtree).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(len(node), -1, np.int32)), slots, pa.array(list(ranges), pa.list_(pa.float64()))], names)

    return indexed


@dataclass
class Index:
    """The indexed rows (a written table), the tree with its ranges, and the sample."""

    rows: DataFrame
    tree: Tree
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray


def build_index(rows: DataFrame, scratch: Scratch) -> Index:
    """Index ``rows`` as :func:`quantised_rows` gives them (a written table)."""
    n, top, width = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max("width")).first()
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(width or 1, 1)))
    # twice the rows wanted by hash, so that few rows are sorted; then the first of them
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, (wanted << 31) // max(n, 1) + 1))
    drawn = rows.filter(spread).orderBy(F.xxhash64("vec_id"), "vec_id", "label", "q").limit(wanted).select("vec_id", "label", "q").collect()
    sample = np.zeros((len(drawn), max((len(r.q) // 8 for r in drawn), default=0)))
    for i, r in enumerate(drawn):
        sample[i, : len(r.q) // 8] = np.frombuffer(r.q, "<f8")
    tree = Tree(sample, n, top or 0.0)
    table_ = scratch.write(rows.mapInArrow(_indexer(tree), INDEX), "index")
    ends = table_.filter("leaf = -1").groupBy("slot").agg(*(F.min(F.col("ranges")[i]).alias(f"r{i}") for i in range(2 * ARITY)))
    tree.least[:], tree.most[:] = np.inf, -np.inf  # subtrees without rows are out at once
    for slot, *ranges in ends.collect():  # at most ARITY rows per node of the tree
        tree.least[slot // ARITY, :, slot % ARITY] = ranges[:ARITY]
        tree.most[slot // ARITY, :, slot % ARITY] = -np.array(ranges[ARITY:])
    for number, split in enumerate(tree.nodes):  # unused split points
        tree.least[number, len(split.child) :], tree.most[number, len(split.child) :] = -np.inf, np.inf
    keep = np.unique([r.vec_id for r in drawn], return_index=True)[1]
    return Index(
        table_.filter("leaf >= 0").drop("slot", "ranges"), tree, np.array([drawn[i].vec_id for i in keep], np.int64),
        np.array([drawn[i].label for i in keep], np.int64), sample[keep],
    )


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by id."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bound)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def _asker(index: Index, k: int, same: bool):
    """anchors with windows -> (anchor_id, width, leaf, mask): the leaves to look into, and for which windows."""
    tree, sample_ids, sample_labels, sample = index.tree, index.ids, index.labels, index.sample  # all bounded; sent to the tasks
    norm_bound = np.sqrt(tree.top)

    def floors(anchors, norms, own_ids, own_labels, owner, low, high):
        """``low`` raised to the k-th best fitting score of the sample, where scores are exact."""
        low = low.copy()
        width = min(anchors.shape[1], sample.shape[1])
        if anchors.shape[1] != sample.shape[1]:
            return low
        step = max(1, BLOCK // max(1, len(sample_ids)))
        for a in range(0, len(owner), step):
            at = owner[a : a + step]
            scores = anchors[at, :width] @ sample[:, :width].T
            fits = (sample_labels[None, :] == own_labels[at, None]) == same
            fits &= (sample_ids[None, :] != own_ids[at, None]) & (scores >= low[a : a + step, None]) & (scores <= high[a : a + step, None])
            scores[~fits] = -np.inf
            if scores.shape[1] >= k:
                kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                exact = np.sqrt(norms[at]) * norm_bound < EXACT
                low[a : a + step] = np.where(exact, np.maximum(low[a : a + step], kth), low[a : a + step])
        return low

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "label", "width", "norm")}
            bounds = [batch.column("lows").to_pylist(), batch.column("highs").to_pylist()]
            for width in np.unique(columns["width"]):
                at = np.flatnonzero(columns["width"] == width)
                anchors = _matrix(batch.column("q").take(pa.array(at)), int(width))
                norms, ids = columns["norm"][at], columns["anchor_id"][at]
                windows = [(i, j, low, high) for i, row in enumerate(at) for j, (low, high) in enumerate(zip(bounds[0][row], bounds[1][row], strict=True))]
                windows = [w for w in windows if w[2] <= w[3]]
                if not windows:
                    continue
                owner, bit = np.array([w[0] for w in windows]), np.array([w[1] for w in windows])
                low = np.array([-np.inf if w[2] == LOWEST else float(w[2]) for w in windows])
                high = np.array([np.inf if w[3] == HIGHEST else float(w[3]) for w in windows])
                low = floors(anchors, norms, ids, columns["label"][at], owner, low, high)
                window, leaf = tree.surviving(anchors, norms, owner, low, high)
                key = owner[window].astype(np.int64) * tree.leaves + leaf
                pairs, place = np.unique(key, return_inverse=True)
                mask = np.zeros(len(pairs), np.int64)
                np.bitwise_or.at(mask, place, np.int64(1) << bit[window])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[pairs // tree.leaves]), pa.array(np.full(len(pairs), width, np.int32)),
                     pa.array((pairs % tree.leaves).astype(np.int32)), pa.array(mask)],
                    ["anchor_id", "width", "leaf", "mask"],
                )

    return asked


FOUND = "anchor_id long, window int, vec_id long, score long"


def _searcher(k: int, same: bool):
    """The first k rows of one tile for each window of each anchor of one slice."""
    schema = pa.schema([("anchor_id", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return schema.empty_table()
        width = rows.column("width")[0].as_py()
        vectors, ids, labels = _matrix(rows.column("q"), width), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        if len(np.unique(ids)) < len(ids):  # equal rows count once
            once = {(i, label, v.tobytes()): n for n, (i, label, v) in enumerate(zip(ids, labels, vectors, strict=True))}
            keep = np.array(sorted(once.values()))
            vectors, ids, labels = vectors[keep], ids[keep], labels[keep]
        anchors, names, own = _matrix(asks.column("q"), width), asks.column("anchor_id").to_numpy(), asks.column("label").to_numpy()
        masks, lows, highs = asks.column("mask").to_pylist(), asks.column("lows").to_pylist(), asks.column("highs").to_pylist()
        biggest = np.sqrt(rows.column("norm").to_numpy().max()) * np.sqrt(asks.column("norm").to_numpy().max())
        exact = bool(biggest < EXACT)
        if not exact:  # components of absurd size: whole numbers of Python
            vectors, anchors = ([[int(x) for x in v] for v in m] for m in (vectors, anchors))
        out, step = [], max(1, BLOCK // len(ids))
        for a in range(0, len(names), step):
            if exact:
                block = anchors[a : a + step] @ vectors.T
            for n in range(a, min(len(names), a + step)):
                scores = block[n - a] if exact else np.array([max(LOWEST, min(HIGHEST, sum(x * y for x, y in zip(anchors[n], v, strict=True)))) for v in vectors])
                usable = ((labels == own[n]) == same) & (ids != names[n])
                for w in range(len(lows[n])):
                    if masks[n] >> w & 1:
                        at = np.flatnonzero(usable & (scores >= lows[n][w]) & (scores <= highs[n][w]))
                        at = at[_first(scores[at], ids[at], k)] if exact else np.array(sorted(at, key=lambda i: (-int(scores[i]), ids[i]))[:k], np.int64)  # noqa: B023
                        out.append((np.full(len(at), names[n]), np.full(len(at), w, np.int32), ids[at], scores[at].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)

    return search


def best_in_windows(index: Index, anchors: DataFrame, k: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    """anchor_id, window, vec_id, score, rank: the first k rows of each window of scores of each anchor.

    ``anchors`` (a written table): anchor_id, label, width, norm, q, lows, highs; window i is ``lows[i]`` to ``highs[i]``. Rows of
    the anchor's own label are searched if ``same``, all others if not.
    """
    asks = scratch.write(anchors.mapInArrow(_asker(index, k, same), "anchor_id long, width int, leaf int, mask long"), f"{name}-asks")
    count = lambda df, values, out: df.groupBy("leaf", "width").agg(
        F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(64), F.lit(values) / F.greatest(F.col("width"), F.lit(1)))).cast("int").alias(out)
    )
    sizes = count(index.rows, TILE_VALUES, "tiles").join(count(asks, SLICE_VALUES, "slices"), ["leaf", "width"])
    sizes = scratch.write(sizes, f"{name}-sizes")  # a row per leaf and width
    dealt = lambda df, by, own, other: df.join(sizes, ["leaf", "width"]).select(
        *df.columns, F.expr(f"CAST(pmod(xxhash64({by}), {own}s) AS INT) AS {own}"), F.expr(f"explode(sequence(0, {other}s - 1)) AS {other}")
    )
    rows = dealt(index.rows, "vec_id", "tile", "slice")
    asking = dealt(asks, "anchor_id", "slice", "tile").join(anchors.select("anchor_id", "label", "norm", "q", "lows", "highs"), "anchor_id")
    group = ["leaf", "width", "tile", "slice"]
    found = rows.groupBy(*group).cogroup(asking.groupBy(*group)).applyInArrow(_searcher(k, same), FOUND)
    # one shuffle: both keys below begin with the anchor
    best = found.repartition("anchor_id").groupBy("anchor_id", "window", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, anchors: Column, mining: Mining = Mining(), scratch: Scratch | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors`` (vec_id, label,
    embedding) that ``anchors`` (a condition on vec_id) takes as anchors."""
    scratch = scratch or Scratch(vectors.sparkSession, "negatives")
    index = build_index(scratch.write(quantised_rows(vectors, mining.scale), "rows"), scratch)
    chosen = index.rows.filter(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "q", "width", "norm")).alias("r"))
    chosen = scratch.write(chosen.select("anchor_id", "r.label", "r.width", "r.norm", "r.q"), "anchors")

    whole = chosen.selectExpr("*", f"array(CAST('{LOWEST}' AS BIGINT)) AS lows", f"array(CAST('{HIGHEST}' AS BIGINT)) AS highs")
    positives = best_in_windows(index, whole, mining.positives, True, scratch, "positives")
    positives = scratch.write(positives.select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # decimals, so that a hundredfold score stays in range
    window = "CAST(ceil(CAST({p} AS DECIMAL(9)) * p.s / 100) AS BIGINT)", "CAST(floor(CAST({p} AS DECIMAL(9)) * p.s / 100) AS BIGINT)"
    windows = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("positive_score").cast("decimal(19)").alias("s")))).alias("ps"))
    windows = windows.selectExpr(
        "anchor_id", f"transform(ps, p -> {window[0].format(p=mining.low)}) AS lows", f"transform(ps, p -> {window[1].format(p=mining.high)}) AS highs"
    )
    ranged = scratch.write(chosen.join(windows, "anchor_id"), "windows")
    negatives = best_in_windows(index, ranged, mining.negatives, False, scratch, "negatives")
    return negatives.withColumnRenamed("rank", "place").join(
        positives.withColumn("window", F.col("rank") - 1).drop("rank"), ["anchor_id", "window"]
    ).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding"
    )
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS same, CAST(list_dot_product(a.q, x.q) AS BIGINT) AS score
  FROM valid a JOIN valid x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id AND len(a.q) = len(x.q)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""
