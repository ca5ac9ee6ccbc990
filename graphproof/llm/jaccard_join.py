"""N-gram Jaccard join: documents whose shingle sets reach a Jaccard similarity, by T-occurrence search.

Candidates, exactly. Two sets of at most ``hi`` shingles that reach the threshold differ in at most
``d = 2 hi (1 - t) / (1 + t)`` shingles. Shingles are dealt by hash into ``d + 1 + slack`` segments; at
most d segments see a difference, so the contents of ``slack + 1`` are equal, and unless more than
``slack`` segments are empty one of these has content. Each set therefore emits the hash of every
non-empty segment, for the size class of its own and for the next one if a partner may be in it. Sets
with more empty segments emit those of another dealing as well, and so on; after ``DEALINGS`` they
meet by size class alone. No pair at or above the threshold is missed, and a passage that very many
documents share makes no candidates, since a segment holds shingles from all over the document.

Documents that only share a common passage meet now and then where a segment holds nothing else. Each
set has a parity sketch: every shingle flips one bit, so sketches differ in no more bits than the sets in
shingles. Pairs whose sketches differ in more bits than the threshold allows are no candidates. Tasks
combine their own rows first: sets with the same segment and near sketches are represented by one of them,
with the largest distance to it as a radius that later comparisons grant (distances obey the triangle inequality, so
nothing is lost). So a group of near copies costs a row per segment and task chunk. The components of
candidate pairs are blocks: every link lies in one. A segment whose documents are not all near its first
one has all of them compared, in cells of at most two tiles of documents.

Search. Within a block each document, by size, is a query against inverted lists of the smaller ones.
DivideSkip: the longest lists are set aside, the short ones are merged with a heap for documents that
reach the count that is then still needed, and these are probed in the long lists by binary search.
Links inside a cluster that is already connected aren't searched again: cluster leaders are asked
first, members only of clusters without link to the query. Blocks of over ``TILE`` documents are dealt into
tiles that share the block's first document. If that leaves several clusters, the documents
outside the largest one are searched against all tiles. Nothing is sampled, cut or dropped.

Defined cases: null and empty texts have no shingles and link with nothing; rows that share a doc_id
are one document with the links of all its rows; a row with a null doc_id links with nothing
and has component null; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import lean, listed, table, within
from graphproof.llm.components import components
from graphproof.llm.shingles import U64, chunks, mix, shingle_sets
from graphproof.session import Scratch

#: Growth of size classes, and dealings before sets with many empty segments meet by class alone.
CLASS_GROWTH = 1.4
DEALINGS = 4
#: Segment rows that a task combines at once.
CHUNK_ROWS = 1_500_000
#: Rows of an Arrow batch; the executor holds as many of a batch as its worker, outside its heap.
SENT_ROWS = 50_000
#: Documents of a block that one group searches.
TILE = 500
#: Weight of DivideSkip's choice how many lists are long.
LONG_LISTS = 0.02
ROWS = "kind byte, key long, doc long, other long, radius int, sketch binary"
SEGMENT, PAIR, LINK, SIZE = range(4)


@dataclasses.dataclass(frozen=True)
class Rule:
    """Sets x, y of shingles of ``words`` words link if 100 |x and y| >= percent |x or y|."""

    words: int = 5
    percent: int = 80

    def links(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def least_common(self, larger: int) -> int:
        """The overlap that any partner of at most the same size needs."""
        return -(-self.percent * larger // 100)

    def most_different(self, a: int, b: int) -> int:
        """The most shingles that linked sets of these sizes don't share."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def sketch_bits(self, n: int) -> int:
        """Length of the sketch of a set of n: a power of two of over four times its differences."""
        return min(1 << 13, max(64, 1 << (4 * self.most_different(n, n)).bit_length()))

    def classes(self, largest: int) -> np.ndarray:
        """The smallest set sizes of the size classes, up to beyond ``largest``."""
        lows = [1]
        while lows[-1] <= largest + 1:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * CLASS_GROWTH)))
        return np.array(lows + [math.ceil(lows[-1] * CLASS_GROWTH)])

    def segments(self, low: int, high: int) -> tuple[int, int]:
        """Segments for the size class from ``low`` to ``high``, and how many of them may be empty.

        They are as many as the smallest partner of the class is expected to leave empty, and a deviation.
        """
        differences, smallest = self.most_different(high, high), -(-self.percent * low // 100)
        least = slack = 1 + differences // 24
        while slack <= differences + least:
            count = differences + 1 + slack
            empty = count * (1 - 1 / count) ** smallest
            needed = math.ceil(empty + math.sqrt(empty))
            if needed <= slack:
                return count, slack
            slack = needed
        # at low thresholds sets of many sizes share a class, and most segments of the small ones are empty
        return differences + 1 + least, least


def segment_hashes(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The segment hashes of the sets, and the index of the set of each."""
    sizes = np.array([len(s) for s in sets])
    lows = rule.classes(int(sizes.max(initial=1)))
    own = np.searchsorted(lows, sizes, side="right") - 1
    found = []
    for ahead in (0, 1):
        size_class = own + ahead
        fits = sizes > 0
        if ahead:
            fits &= 100 * sizes >= rule.percent * lows[size_class]
        todo = np.flatnonzero(fits)
        for dealing in range(DEALINGS):
            if not len(todo):
                break
            plans = {c: rule.segments(int(lows[c]), int(lows[c + 1]) - 1) for c in set(size_class[todo].tolist())}
            count, slack = np.array([plans[c] for c in size_class[todo].tolist()]).T
            base = np.cumsum(count) - count
            values = np.concatenate([sets[i] for i in todo])
            of = np.repeat(np.arange(len(todo)), sizes[todo])
            dealt = mix(values + U64(dealing + 1)) >> U64(32)
            segment = ((dealt * count[of].astype(U64)) >> U64(32)).astype(np.int64)
            sums = np.zeros(int(count.sum()), U64)
            np.add.at(sums, base[of] + segment, mix(values ^ U64(0xA5A5A5A5)))
            seat = np.arange(len(sums)) - np.repeat(base, count)
            place = (np.repeat(size_class[todo], count).astype(U64) << U64(40)) + (U64(dealing) << U64(32)) + seat.astype(U64)
            full = sums != 0
            keys = mix(sums + mix(place))
            holder = np.repeat(todo, count)
            found.append((keys[full], holder[full]))
            empty = np.add.reduceat((~full).astype(np.int64), base)
            todo = todo[empty > slack]
        if len(todo):
            found.append((mix(size_class[todo].astype(U64) + U64(1 << 60)), todo))
    keys = np.concatenate([np.zeros(0, U64), *(k for k, _ in found)])
    return keys, np.concatenate([np.zeros(0, np.int64), *(h for _, h in found)])


def sketch_of(values: np.ndarray, bits: int) -> bytes:
    """Parity sketch: bit i tells whether an odd number of the values belongs to it."""
    seats = (mix(values ^ U64(0x5C)) & U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(seats, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(sketch: int, bits: int, to: int) -> int:
    """The sketch at a shorter length: its halves added, again and again."""
    while bits > to:
        bits //= 2
        sketch = (sketch >> bits) ^ (sketch & ((1 << bits) - 1))
    return sketch


_NAMES = ["kind", "key", "doc", "other", "radius", "sketch"]


def arrow_rows(kind: int, key: np.ndarray, doc: np.ndarray, other: np.ndarray, radius: np.ndarray | None = None) -> pa.RecordBatch:
    radius = np.zeros(len(doc)) if radius is None else radius
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(doc), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(doc, pa.int64()),
            pa.array(other, pa.int64()), pa.array(radius.astype(np.int32)), pa.nulls(len(doc), pa.binary()),
        ],
        _NAMES,
    )


class _Chunk:
    """The segment rows of a task that wait to be combined."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.sketches: list[tuple[int, int]] = []
        self.keys: list[np.ndarray] = []
        self.holders: list[np.ndarray] = []
        self.rows = 0

    def add(self, docs: list[int], sets: list[np.ndarray], sketches: list[bytes]) -> None:
        keys, holder = segment_hashes(sets, self.rule)
        self.keys.append(keys)
        self.holders.append((holder + len(self.docs)).astype(np.int32))
        self.rows += len(keys)
        self.docs += docs
        self.sizes += [len(s) for s in sets]
        self.sketches += [(int.from_bytes(s, "little"), 8 * len(s)) for s in sketches]

    def distance(self, i: int, j: int) -> int:
        (x, a), (y, b) = self.sketches[i], self.sketches[j]
        to = min(a, b)
        return (_folded(x, a, to) ^ _folded(y, b, to)).bit_count()

    def combined(self) -> Iterator[pa.RecordBatch]:
        """One row per segment and group of near sketches, and the pairs that were combined."""
        if not self.rows:
            return
        keys, holder = np.concatenate(self.keys), np.concatenate(self.holders)
        self.keys, self.holders = [], []
        order = np.lexsort((holder, keys))
        keys, holder = keys[order], holder[order]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        alone = np.diff(edges) == 1
        docs = np.array(self.docs, np.int64)
        single = edges[:-1][alone]
        for i in range(0, len(single), SENT_ROWS):
            part = single[i : i + SENT_ROWS]
            own = docs[holder[part]]
            yield arrow_rows(SEGMENT, keys[part], own, own)
        known: dict[tuple[int, int], int] = {}
        pairs: set[tuple[int, int]] = set()
        out_keys, out_docs, out_radius = [], [], []
        for start, end in zip(edges[:-1][~alone].tolist(), edges[1:][~alone].tolist(), strict=True):
            hubs: dict[int, int] = {}
            # short sketches first: a distance to the hub holds at the length of any later comparison with it
            for i in sorted(holder[start:end].tolist(), key=lambda i: self.sketches[i][1]):
                for hub in hubs:
                    d = known.get((i, hub))
                    if d is None:
                        d = known[i, hub] = self.distance(i, hub)
                    if d <= self.rule.most_different(self.sizes[i], self.sizes[hub]):
                        # a larger set than its hub may differ in more from others than the hub may
                        larger = max(0, self.sizes[i] - self.sizes[hub])
                        grown = -(-larger * (100 - self.rule.percent) // (100 + self.rule.percent))
                        hubs[hub] = max(hubs[hub], d + grown)
                        pairs.add((i, hub))
                        break
                else:
                    hubs[i] = 0
            out_keys += [keys[start]] * len(hubs)
            out_docs += hubs
            out_radius += hubs.values()
        if out_keys:
            yield arrow_rows(SEGMENT, np.array(out_keys, U64), docs[out_docs], docs[out_docs], np.array(out_radius))
        if pairs:
            a, b = docs[np.array(sorted(pairs))].T
            yield arrow_rows(PAIR, mix(a.copy().view(U64)), a, b)


def _emitter(rule: Rule):
    """(doc_id, text) batches -> segment rows, candidate pairs, links of equal sets, set sizes and sketches."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = _Chunk(rule)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, run in chunks(listed(batch.column("text"))):
                sets = shingle_sets(run, rule.words)
                docs = ids[start : start + len(run)]
                sketches = [sketch_of(s, rule.sketch_bits(len(s))) for s in sets]
                keys = mix(np.array([d or 0 for d in docs], np.int64).view(U64) + U64(7))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(docs), SIZE, np.int8)), pa.array(keys.view(np.int64)), pa.array(docs, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array(np.zeros(len(docs), np.int32)), pa.array(sketches, pa.binary()),
                    ],
                    _NAMES,
                )
                # of equal sets in the chunk only the first is dealt into segments
                leader: dict[bytes, int] = {}
                equal, dealt = [], []
                for i, (doc, own) in enumerate(zip(docs, sets, strict=True)):
                    if doc is None or not len(own):
                        continue
                    first = leader.setdefault(own.tobytes(), doc)
                    if first != doc:
                        equal.append((doc, first))
                    else:
                        dealt.append(i)
                if equal:
                    a, b = np.unique(np.array(equal, np.int64), axis=0).T
                    yield arrow_rows(LINK, mix(a.copy().view(U64)), a, b)
                if dealt:
                    waiting.add([docs[i] for i in dealt], [sets[i] for i in dealt], [sketches[i] for i in dealt])
                if waiting.rows > CHUNK_ROWS:
                    yield from waiting.combined()
                    waiting = _Chunk(rule)
        yield from waiting.combined()

    return emit


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, key, doc): of the segments of one key, all but the first with it as ``other``.

    Their radius is that of both; other rows pass.
    """
    last, hub, hub_radius = None, None, None
    for batch in batches:
        n = int(np.searchsorted(batch.column("kind").to_numpy(), SEGMENT, side="right"))
        if n:
            keys, docs, radius = (batch.column(c).slice(0, n).to_numpy() for c in ("key", "doc", "radius"))
            first = np.ones(n, bool)
            first[1:] = keys[1:] != keys[:-1]
            at = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            hubs, radii = docs[at], radius[at]
            if last == keys[0]:
                more = keys == last
                hubs, radii, first = np.where(more, hub, hubs), np.where(more, hub_radius, radii), first & ~more
            last, hub, hub_radius = keys[-1], hubs[-1], radii[-1]
            met = ~first & (docs != hubs)
            yield arrow_rows(SEGMENT, keys[met], docs[met], hubs[met], (radius + radii)[met])
        yield batch.slice(n)


def _near_pairs(rule: Rule):
    """Pairs with both sizes and sketches -> the same with ``near``: whether the sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "radius", "sketch_a", "sketch_b"))
            near = []
            for n_a, n_b, radius, x, y in zip(*columns, strict=True):
                to = 8 * min(len(x), len(y))
                x, y = (_folded(int.from_bytes(s, "little"), 8 * len(s), to) for s in (x, y))
                near.append((x ^ y).bit_count() <= rule.most_different(n_a, n_b) + radius)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    return run


def _compatible(rule: Rule):
    """Documents with sketches, sorted by cell -> pairs that connect near sketches of a cell."""

    def pairs(docs: np.ndarray, sizes: np.ndarray, radius: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        to = 8 * min(map(len, sketches))
        words = np.stack([
            np.frombuffer(_folded(int.from_bytes(s, "little"), 8 * len(s), to).to_bytes(to // 8, "little"), np.uint64) for s in sketches
        ])
        near = np.empty((len(docs), len(docs)), bool)
        block = max(1, 4_000_000 // (len(docs) * words.shape[1]))
        for i in range(0, len(docs), block):
            part = slice(i, i + block)
            distance = np.bitwise_count(words[part, None] ^ words[None]).sum(axis=2, dtype=np.int64)
            allowed = (sizes[part, None] + sizes[None]) * (100 - rule.percent) // (100 + rule.percent)
            near[part] = distance <= allowed + radius[part, None] + radius[None]
        label = np.arange(len(docs))
        while True:
            new = np.minimum(label, np.where(near, label[None], len(docs)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        rest = label != np.arange(len(docs))
        return np.stack([docs[rest], docs[label[rest]]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None

        def take(rows: pa.RecordBatch) -> pa.RecordBatch:
            keys = rows.column("cell").to_numpy()
            docs, sizes, radius = (rows.column(c).to_numpy() for c in ("doc", "n", "radius"))
            sketches = rows.column("sketch").to_pylist()
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]).tolist()
            found = [pairs(docs[a:b], sizes[a:b], radius[a:b], sketches[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            a, b = np.unique(np.concatenate([*found, np.zeros((0, 2), np.int64)]), axis=0).T
            return pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], ["a", "b"])

        for batch in batches:
            if carried is not None:
                batch = pa.concat_batches([carried, batch])
            if len(batch):
                keys = batch.column("cell").to_numpy()
                start = int(np.searchsorted(keys, keys[-1]))  # the last cell may go on
                if start:
                    yield take(batch.slice(0, start))
                carried = batch.slice(start)
        if carried is not None:
            yield take(carried)

    return run


class _Lists:
    """Inverted lists of sets that are added in order of their numbers."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}

    def add(self, number: int, values: list[int]) -> None:
        for v in values:
            self.lists.setdefault(v, []).append(number)

    def search(self, values: list[int], needed: int) -> Iterator[tuple[int, int]]:
        """(number, overlap) of the sets that share at least ``needed`` values, by DivideSkip."""
        lists = [x for x in map(self.lists.get, values) if x]
        if len(lists) < needed:
            return
        lists.sort(key=len)
        longest = len(lists[-1])
        aside = min(needed - 1, int(needed / (LONG_LISTS * math.log2(longest) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        for number, same in itertools.groupby(heapq.merge(*short)):
            overlap = sum(1 for _ in same)
            if overlap < needed - aside:
                continue
            for x in long:
                i = bisect_left(x, number)
                overlap += i < len(x) and x[i] == number
            if overlap >= needed:
                yield number, overlap


def find_links(sets: list[np.ndarray], rule: Rule, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among the sets (by index) that connect all that links connect.

    ``known`` gives clusters that are connected already; links within them are left out.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    firsts: dict[int, int] = {}
    for i, cluster in enumerate(known or []):
        parent[i] = firsts.setdefault(cluster, i)
    values = [s.tolist() for s in sets]
    order = sorted((i for i in range(len(sets)) if values[i]), key=lambda i: len(values[i]))
    leaders, members = _Lists(), _Lists()
    followed: set[int] = set()  # roots of clusters that have indexed members besides their leaders
    led: set[int] = set()
    found = []
    for at, i in enumerate(order):
        own = values[i]
        for lists in (leaders, members):
            if lists is members and not any(root(r) != root(i) for r in followed):
                break
            for j, common in lists.search(own, rule.least_common(len(own))):
                j = order[j]
                if root(i) != root(j) and rule.links(common, len(own), len(values[j])):
                    found.append((i, j))
                    parent[root(i)] = root(j)
        # the first of a cluster leads it; clusters that merge later keep all their leaders
        if root(i) in {root(r) for r in led}:
            members.add(at, own)
            followed = {root(r) for r in followed} | {root(i)}
        else:
            leaders.add(at, own)
            led.add(i)
    return found


def find_missing(sets: list[np.ndarray], rule: Rule, known: list[int], minor: list[bool]) -> list[tuple[int, int]]:
    """Links that connect minor sets with the others as all links do; the others are one cluster.

    ``known`` gives clusters that are connected already. A query asks all other minors, and the large
    cluster until one of it answers.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    firsts: dict[int, int] = {}
    for i, cluster in enumerate(known):
        parent[i] = firsts.setdefault(cluster, i)
    values = [s.tolist() for s in sets]
    majors, minors, found = _Lists(), _Lists(), []
    for i, own in enumerate(values):
        (minors if minor[i] else majors).add(i, own)
    for i, own in enumerate(values):
        if minor[i] and own:
            for lists in (minors, majors):
                for j, common in lists.search(own, rule.least_common(len(own))):
                    if root(i) != root(j) and rule.links(common, len(own), len(values[j])):
                        found.append((i, j))
                        parent[root(i)] = root(j)
                        if lists is majors:
                            break
                    elif lists is majors and root(i) == root(j):
                        break
    return found


#: Batches of rows (cell, doc_id, text, cluster, minor) sorted by cell -> batches of links (a, b) within the cells.
Search = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def searcher(rule: Rule) -> Search:
    """Rows sorted by group -> links; one group of texts is held at a time."""

    def links(rows: list[tuple]) -> pa.RecordBatch | None:
        sets = [s for _, run in chunks([r[2] for r in rows]) for s in shingle_sets(run, rule.words)]
        known, minor = [r[3] for r in rows], [r[4] for r in rows]
        found = find_missing(sets, rule, known, minor) if minor[0] is not None else find_links(sets, rule, known)
        if not found:
            return None
        a, b = (np.array([rows[p[k]][1] for p in found], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for row in zip(*(listed(batch.column(c)) for c in ("cell", "doc_id", "text", "cluster", "minor")), strict=True):
                if row[0] != group and rows:
                    if (out := links(rows)) is not None:
                        yield out
                    rows = []
                group = row[0]
                rows.append(row)
        if rows and (out := links(rows)) is not None:
            yield out

    return search


def _search(rows: DataFrame, search: Search) -> DataFrame:
    """Links within each ``cell`` of rows (cell, doc_id, text, cluster, minor)."""
    # cells are few and costly, so small partitions are not put together
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "cell").sortWithinPartitions("cell", "doc_id")
    return dealt.mapInArrow(lean(search), "a long, b long")


def _cells(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (cell, doc, n, radius, sketch) by cell; any two members of a key share a cell of at most two tiles."""
    members = scratch.write(members.withColumn("at", F.xxhash64("doc", "sketch", "n", "key")), "members")
    sized = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    wide = sized.filter("tiles > 1")
    whole = members.join(wide, "key", "left_anti").select(F.col("key").alias("cell"), "doc", "n", "radius", "sketch")
    tiled = members.join(wide, "key").withColumn("t", F.expr("CAST(pmod(at, tiles) AS INT)"))
    tiled = tiled.withColumn("u", F.explode(F.expr("sequence(0, tiles - 1)")))
    tiled = tiled.select(F.xxhash64("key", F.least("t", "u"), F.greatest("t", "u")).alias("cell"), "doc", "n", "radius", "sketch")
    return whole.union(tiled).repartition("cell").sortWithinPartitions("cell")


def _candidates(docs: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a, b), links of equal sets (a, b) and set sizes (doc, other) of the documents."""
    rows = docs.mapInArrow(lean(_emitter(rule)), ROWS)
    met = rows.repartition("key").sortWithinPartitions("kind", "key", "doc").mapInArrow(lean(_meet), ROWS)
    met = scratch.write(met, "met")
    kind = lambda k: met.filter(F.col("kind") == k)
    ends = [F.col("doc").alias("a"), F.col("other").alias("b")]
    # rows that share a doc_id have several sketches; each of them stands for the document
    sketches = kind(SIZE).filter("doc IS NOT NULL AND other > 0").select("doc", F.col("other").alias("n"), "sketch")

    # documents and the first one of their segments: a pair that meets in many segments is looked at once
    stars = kind(SEGMENT).select("key", *ends, "radius")
    distinct = stars.groupBy("a", "b").agg(F.max("radius").alias("radius"))
    for end in ("a", "b"):
        distinct = distinct.join(sketches.toDF(end, f"n_{end}", f"sketch_{end}"), end)
    judged = scratch.write(distinct.mapInArrow(lean(_near_pairs(rule)), "a long, b long, near boolean"), "judged")

    # segments with a document that is far from the first one: all their documents are compared
    far = judged.groupBy("a", "b").agg(F.max("near").alias("near")).filter("NOT near").select("a", "b")
    far = stars.join(far, ["a", "b"]).select("key").distinct()
    far = scratch.write(far, "far")
    mixed = stars.join(far, "key")
    members = mixed.select("key", F.explode(F.array("a", "b")).alias("doc"), "radius").groupBy("key", "doc").agg(F.max("radius").alias("radius"))
    more = _cells(members.join(sketches, "doc"), scratch).mapInArrow(lean(_compatible(rule)), "a long, b long")
    pairs = kind(PAIR).select(*ends).union(judged.filter("near").select("a", "b")).union(more)
    return pairs, kind(LINK).select(*ends), kind(SIZE).select("doc", "other")


def connected(
    pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], search: Search, scratch: Scratch, equal: DataFrame | None = None,
) -> DataFrame:
    """node, component of all that links within the components of the candidate pairs connect.

    ``fetch`` gets the candidates (doc_id, block, tiles, tile) and returns them with their ``text``;
    ``equal`` are links that are known before.
    """
    blocks = components(pairs, scratch, "blocks").withColumnRenamed("component", "block")
    sized = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    placed = blocks.join(sized, "block").select(
        F.col("node").alias("doc_id"), "block", "tiles", F.expr("CAST(pmod(xxhash64(node), tiles) AS INT)").alias("tile"),
    )
    placed = scratch.write(placed, "placed")
    texts = scratch.write(fetch(placed), "texts")

    # the first document of a block is in each of its tiles
    tiles = F.when(F.col("doc_id") == F.col("block"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    cells = texts.select("doc_id", "text", "block", F.explode(tiles).alias("t"))
    cells = cells.select(
        F.xxhash64("block", "t").alias("cell"), "doc_id", "text", F.col("doc_id").alias("cluster"), F.lit(None).cast("boolean").alias("minor"),
    )
    links = _search(cells, search)
    links = scratch.write(links if equal is None else links.union(equal), "links")

    groups = components(links, scratch, "groups")
    wide = placed.filter("tiles > 1")
    if wide.isEmpty():
        return groups
    # what connects the tiles' groups is a graph of its own, over groups
    across = scratch.write(_across_tiles(texts, wide, groups, search, scratch), "tile-links")
    for end in ("a", "b"):
        own = groups.select(F.col("node").alias(end), F.col("component").alias("of"))
        across = across.join(own, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    more = components(across, scratch, "tile-groups")
    alone = more.join(groups, "node", "left_anti")
    merged = more.select(F.col("node").alias("component"), F.col("component").alias("least"))
    groups = groups.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return groups.union(alone)


def jaccard_groups(docs: DataFrame, rule: Rule, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs, equal, sizes = _candidates(docs, rule, scratch)

    def fetch(placed: DataFrame) -> DataFrame:
        return within(docs.filter("doc_id IS NOT NULL"), ["doc_id"], placed).join(placed.hint("shuffle_hash"), "doc_id")

    groups = connected(pairs, fetch, searcher(rule), scratch, equal)
    sizes = sizes.select(F.col("doc").alias("doc_id"), F.col("other").alias("n_shingles"))
    found = sizes.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _across_tiles(texts: DataFrame, wide: DataFrame, groups: DataFrame, search: Search, scratch: Scratch) -> DataFrame:
    """Links between the clusters that the links within tiles leave in wide blocks.

    Two documents of the largest cluster are connected already, so one end of a missing link is
    outside it: those documents, in tiles of their own, meet every tile of the block.
    """
    clusters = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    placed = wide.join(clusters, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id"))
    counts = placed.groupBy("block", "cluster").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("block").agg(
        F.max(F.struct("n", "cluster"))["cluster"].alias("largest"),
        F.ceil((F.sum("n") - F.max("n")) / TILE).cast("int").alias("minor_tiles"),
    )
    rows = placed.join(largest.filter("minor_tiles > 0"), "block")
    rows = rows.withColumn("minor", F.col("cluster") != F.col("largest"))
    rows = scratch.write(rows.select("doc_id", "cluster", "minor", "minor_tiles"), "open")
    texts = texts.join(rows, "doc_id")
    as_index = texts.select("*", F.explode(F.expr("sequence(0, minor_tiles - 1)")).alias("m"), F.col("tile").alias("t"))
    own = F.expr("CAST(pmod(xxhash64(doc_id, 'minor'), minor_tiles) AS INT)")
    as_query = texts.filter("minor").select("*", own.alias("m"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("t"))
    cells = as_index.unionByName(as_query)
    cells = cells.select(F.xxhash64("block", "m", "t").alias("cell"), "doc_id", "text", "cluster", "minor")
    # a minor one of the tile itself is there twice; rows that share a doc_id have texts of their own
    cells = cells.dropDuplicates(["cell", "doc_id", "text"])
    return _search(cells, search)


def near_dedup(docs: DataFrame, rule: Rule, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each group of near copies; same columns."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    groups = jaccard_groups(docs, rule, scratch).filter("component_id <> doc_id").select(F.col("doc_id").alias("_llm_id")).distinct()
    dropped = scratch.write(groups, "dropped")
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_llm_id"], "left_anti")


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(table(spark, folder, "documents"), Rule(words=4, percent=85))


#: All pairs by their common shingles; for tables that a single process can join.
OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
"""
