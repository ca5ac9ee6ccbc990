"""The n-gram join against brute force over all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphproof.llm import jaccard_join
from graphproof.llm.components import components
from graphproof.llm.jaccard_join import Rule, find_links, jaccard_groups, near_dedup, segment_hashes
from graphproof.llm.shingles import shingle_sets
from graphproof.session import Scratch


def plain_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if len(words) >= k else frozenset([tuple(words)])


def brute(texts, rule):
    sets = [plain_set(t, rule.words) for t in texts]
    parent = list(range(len(texts)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= rule.percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:  # a copy with some edits, at about the threshold
            words = (rng.choice(texts) or "").split()
            for _ in range(rng.randrange(1 + len(words) // 30)):
                i = rng.randrange(len(words) + 1)
                words[i:i + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(3))
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 8, 12, 30, 90, 300]))
            if kind > 0.8:
                words += passage
        texts.append(" ".join(words))
    return texts + ["", None, "One two", "one  TWO", "a", "A", "é É", "x " * 30_000, "x " * 30_001 + "y"]


def groups(spark, texts, rule):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(frame, rule).collect()}


@pytest.mark.parametrize("rule", [Rule(4, 85), Rule(5, 80)])
def test_groups_equal_brute_force(spark, rule):
    texts = corpus(rule.words)
    assert groups(spark, texts, rule) == dict(enumerate(brute(texts, rule)))


def test_tiles_and_small_chunks_change_nothing(spark, monkeypatch):
    """Blocks over a tiny tile size; everything meets by class alone, so blocks are large and mixed."""
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    monkeypatch.setattr(jaccard_join, "sketch_of", lambda values, bits: bytes(bits // 8))
    monkeypatch.setattr(jaccard_join, "segment_hashes", lambda sets, rule: (
        np.array([5] * len(sets), np.uint64), np.arange(len(sets))))
    texts = corpus(9, 120)
    assert groups(spark, texts, Rule(4, 85)) == dict(enumerate(brute(texts, Rule(4, 85))))


def test_every_linked_pair_shares_a_segment():
    """Also where nearly all segments are empty."""
    rng = np.random.default_rng(1)
    for rule in (Rule(4, 85), Rule(5, 80), Rule(5, 30)):
        for _ in range(300):
            n = int(rng.choice([1, 2, 3, 6, 7, 13, 20, 60, 200]))
            a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            out = rng.integers(0, 1 + n // 6)
            b = np.unique(np.r_[a[out:], rng.integers(1, 1 << 62, rng.integers(0, 1 + n // 8)).astype(np.uint64)])
            if rule.links(len(np.intersect1d(a, b)), len(a), len(b)):
                keys, holder = segment_hashes([a, b], rule)
                assert set(keys[holder == 0].tolist()) & set(keys[holder == 1].tolist())


def test_find_links_connects_what_links_connect():
    texts = corpus(3, 150)
    rule = Rule(4, 85)
    sets = shingle_sets([(t or "").encode() for t in texts], 4)
    parent = list(range(len(texts)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in find_links(sets, rule):
        assert rule.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert [root(i) for i in range(len(texts))] == [c for _, c in brute(texts, rule)]


def test_awkward_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "g h i j k"), (7, "G H I J K"), (9, "a b c d e f"), (9, "a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("cell", F.lit(2))
    out = sorted((str(r.doc_id), r.component_id) for r in jaccard_groups(frame, Rule(4, 85)).collect())
    assert out == [("3", 3), ("3", 3), ("7", 3), ("9", 3), ("9", 3), ("None", None)]
    kept = near_dedup(frame, Rule())
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "None"]
    assert jaccard_groups(frame.limit(0), Rule()).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "t").collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}


def test_sketches_never_differ_in_more_bits_than_sets(spark):
    rng, rule = np.random.default_rng(2), Rule(4, 85)
    for _ in range(300):
        a = np.unique(rng.integers(1, 1 << 62, int(rng.integers(1, 400))).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.8], rng.integers(1, 1 << 62, 30).astype(np.uint64)])
        chunk = jaccard_join._Chunk(rule)
        chunk.add([1, 2], [a, b], [jaccard_join.sketch_of(x, rule.sketch_bits(len(x))) for x in (a, b)])
        assert chunk.distance(0, 1) <= len(np.setxor1d(a, b))


def radii(chunk):
    """(key, hub) -> the radius that a combined chunk grants."""
    rows = [r for b in chunk.combined() for r in b.to_pylist() if r["kind"] == jaccard_join.SEGMENT]
    return {(r["key"], r["doc"]): r["radius"] for r in rows}


@pytest.mark.parametrize("rule", [Rule(4, 85), Rule(5, 80)])
def test_radius_keeps_the_links_of_the_represented(rule):
    """A hub is as near to whatever its members link with as its radius grants; also where sketch lengths change."""
    rng, seen = np.random.default_rng(4), 0
    edges = [n for n in range(20, 700) if rule.sketch_bits(n) != rule.sketch_bits(n + 1)]
    fresh = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    for turn in range(400):
        n = int(rng.choice([1, 2, 8, 50, 100, 300])) if turn % 2 else int(rng.choice(edges)) + int(rng.integers(-2, 1))
        i = np.unique(fresh(n))
        few = lambda n: int(rng.integers(0, 2 + n // 8))
        hub = np.unique(np.r_[i[few(n):], fresh(few(n))])
        x = np.unique(np.r_[i[: len(i) - few(n)], fresh(few(n))])
        if turn % 4 == 0:  # i alone has a short sketch, and both others are as far from it as links go
            i = np.unique(fresh(int(rng.choice(edges))))
            k = (rule.most_different(len(i), len(i) + 1) - 1) // 2
            hub, x = np.unique(np.r_[i[k:], fresh(k + 1)]), np.unique(np.r_[i[: len(i) - k], fresh(k + 1)])
        if not len(hub) or not rule.links(len(np.intersect1d(i, x)), len(i), len(x)):
            continue
        sets = [hub, i, x]
        chunk = jaccard_join._Chunk(rule)
        chunk.add([0, 1, 2], sets, [jaccard_join.sketch_of(s, rule.sketch_bits(len(s))) for s in sets])
        pair = jaccard_join._Chunk(rule)
        pair.docs, pair.sizes, pair.sketches = chunk.docs[:2], chunk.sizes[:2], chunk.sketches[:2]
        pair.keys, pair.holders, pair.rows = [np.array([5, 5], np.uint64)], [np.array([0, 1])], 2
        granted = radii(pair)
        if len(granted) == 1:
            (_, at), radius = granted.popitem()
            seen += 1
            assert chunk.distance(at, 2) <= rule.most_different(len(sets[at]), len(x)) + radius
    assert seen > 50


def test_link_of_a_represented_text_is_found():
    """Texts of the review: i without its last word, i, and, in another partition, i with an inner word replaced."""
    words = [f"w{k}" for k in range(53)]
    found = []
    for inner in range(10, 44):
        texts = [" ".join(words[:-1]), " ".join(words), " ".join([*words[:inner], "new", *words[inner + 1:]])]
        rule = Rule(4, 85)
        sets = shingle_sets([t.encode() for t in texts], rule.words)
        chunk = jaccard_join._Chunk(rule)
        chunk.add([0, 1], sets[:2], [jaccard_join.sketch_of(s, rule.sketch_bits(len(s))) for s in sets[:2]])
        other = jaccard_join._Chunk(rule)
        other.add([2], sets[2:], [jaccard_join.sketch_of(sets[2], rule.sketch_bits(len(sets[2])))])
        assert rule.links(len(np.intersect1d(sets[1], sets[2])), len(sets[1]), len(sets[2]))
        whole = jaccard_join._Chunk(rule)
        whole.sizes = [len(s) for s in sets]
        whole.sketches = chunk.sketches + other.sketches
        allowed = {key: whole.distance(hub, 2) <= rule.most_different(len(sets[hub]), len(sets[2])) + radius
                   for (key, hub), radius in radii(chunk).items()}
        shared = {key for key, _ in radii(other)}
        found.append(any(near for key, near in allowed.items() if key in shared))
    assert all(found)


@pytest.mark.parametrize("rule", [Rule(4, 85), Rule(5, 80)])
def test_meeting_by_class_alone_is_an_exception(rule):
    """Also for the smallest partners that a size class takes."""
    rng = np.random.default_rng(6)
    lows = rule.classes(3000)
    for size in [250, 300, 400, 500, 700, 1000, 1500, 2000, 3000]:
        sets = [np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64)) for _ in range(60)]
        keys, _ = segment_hashes(sets, rule)
        alone = np.isin(keys, jaccard_join.mix(np.arange(len(lows), dtype=np.uint64) + np.uint64(1 << 60)))
        assert alone.sum() <= 6, size


def test_members_of_a_far_key_are_dealt_into_cells(spark, monkeypatch):
    """Everything meets by class alone and most of it is far: no group holds much more than two tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", 20)
    monkeypatch.setattr(jaccard_join, "segment_hashes", lambda sets, rule: (
        np.array([5] * len(sets), np.uint64), np.arange(len(sets))))
    whole = jaccard_join._compatible
    def spied(rule):
        run = whole(rule)
        def both(batches):
            for batch in batches:
                counts = np.unique(batch.column("cell").to_numpy(), return_counts=True)[1]
                assert counts.max(initial=0) <= 80
                yield from run(iter([batch]))
        return both
    monkeypatch.setattr(jaccard_join, "_compatible", spied)
    texts, rule = corpus(12, 200), Rule(5, 80)
    assert groups(spark, texts, rule) == dict(enumerate(brute(texts, rule)))


def test_tasks_hold_and_send_little_at_once(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"word{i}" for i in range(3000)], k=250)).encode() for _ in range(900)]
    tracemalloc.start()
    sets = shingle_sets(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(map(len, texts))
    assert all((a == b).all() for a, b in zip(sets, (shingle_sets([t], 5)[0] for t in texts), strict=True))

    def segments():
        chunk = jaccard_join._Chunk(Rule())
        chunk.add(list(range(50)), sets[:50], [jaccard_join.sketch_of(s, 512) for s in sets[:50]])
        return [b for b in chunk.combined()]

    whole = segments()
    monkeypatch.setattr(jaccard_join, "SENT_ROWS", 1000)
    parts = segments()
    assert max(len(b) for b in parts) <= 1000
    assert [r for b in parts for r in b.to_pylist()] == [r for b in whole for r in b.to_pylist()]
