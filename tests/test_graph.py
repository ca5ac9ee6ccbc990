"""Graph operators against small plain-Python models."""

import random
from collections import deque

import pytest
from pyspark.errors import AnalysisException

from graphproof import Scratch, lookup, neighborhood, shortest_paths
from graphproof.operators.cycles import cycle_nodes, cycle_verdicts, relation_edges, residue
from graphproof.operators import frontier
from graphproof.operators.frontier import Search, places
from graphproof.operators.neighborhood import distances, neighborhood_connections, neighborhood_nodes
from graphproof.operators.paths import _between, _Request
from graphproof.skew import hot_buckets, lookup_join
from graphproof.sources.schema import (
    RELATIONS_TABLE,
    SHAPES_TABLE,
    TYPES_TABLE,
    schema_from_tables,
)

EDGE = (
    "src string, relation string, dst string, declaration string, decl_ordinal bigint, "
    "evidence array<string>"
)
ENTITY = "id string, kind string, title string, aliases array<string>, document string"


def make_schema(spark, relations):
    return schema_from_tables(
        spark.createDataFrame([("T", None)], TYPES_TABLE),
        spark.createDataFrame(
            [(n, None, ["*"], ["*"], s, a) for n, s, a in relations], RELATIONS_TABLE
        ),
        spark.createDataFrame([], SHAPES_TABLE),
    )


def make_edges(spark, arcs):
    rows = [(a, r, b, f"{a}.md", i, []) for i, (a, r, b) in enumerate(arcs)]
    return spark.createDataFrame(rows, EDGE)


def make_entities(spark, ids):
    return spark.createDataFrame([(i, "T", i, [], f"{i}.md") for i in ids], ENTITY)


def random_arcs(rng, nodes, relations, n):
    return [(rng.choice(nodes), rng.choice(relations), rng.choice(nodes)) for _ in range(n)]


def bfs_path(arcs, symmetric, start, goal):
    """First discovery in breadth-first order with neighbours by (id, relation, declaration)."""
    ways = {}
    for a, r, b in arcs:
        ways.setdefault(a, []).append((b, r, f"{a}.md"))
        if r in symmetric:
            ways.setdefault(b, []).append((a, r, f"{a}.md"))
    came, queue = {start: None}, deque([start])
    while queue:
        here = queue.popleft()
        for there, relation, declaration in sorted(ways.get(here, [])):
            if there in came:
                continue
            came[there] = (here, relation, declaration)
            if there == goal:
                hops = []
                while came[there] is not None:
                    back, relation, declaration = came[there]
                    hops.append((back, relation, there, declaration))
                    there = back
                return hops[::-1]
            queue.append(there)
    return None


@pytest.mark.parametrize("seed", [3, 4])
def test_shortest_paths_match_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(14)]
    arcs = random_arcs(rng, nodes, ["r", "s", "both"], 26)
    pairs = [(f"{a}>{b}", a, b) for a in nodes for b in nodes] + [("?", "n00", "nope")]
    schema = make_schema(spark, [("r", False, False), ("s", False, False), ("both", True, False)])
    asked = spark.createDataFrame(pairs, "request_id string, from string, to string")
    results, steps = shortest_paths(
        schema, make_entities(spark, nodes), make_edges(spark, arcs), asked
    )
    found = {r["request_id"]: r for r in results.collect()}
    assert found["?"]["error"] == "unknown entity 'nope'" and found["?"]["found"] is None
    walked = {}
    for row in sorted(steps.collect(), key=lambda r: r["hop"]):
        walked.setdefault(row["request_id"], []).append(
            (row["src"], row["relation"], row["dst"], row["declaration"])
        )
    for name, start, goal in pairs[:-1]:
        want = [] if start == goal else bfs_path(arcs, {"both"}, start, goal)
        assert found[name]["found"] == (want is not None), name
        assert found[name]["hops"] == (None if want is None else len(want)), name
        assert walked.get(name, []) == (want or []), name


def dfs_cycle(arcs):
    ways = {}
    for a, b in arcs:
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set())
    state, stack = {}, []

    def visit(node):
        state[node] = 1
        stack.append(node)
        for there in sorted(ways[node]):
            if state.get(there, 0) == 0:
                loop = visit(there)
                if loop:
                    return loop
            elif state[there] == 1:
                return stack[stack.index(there):] + [there]
        stack.pop()
        state[node] = 2
        return None

    for node in sorted(ways):
        if state.get(node, 0) == 0:
            loop = visit(node)
            if loop:
                return loop
    return None


def test_cycle_witness_matches_depth_first_search(spark):
    rng = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(9)]
    names = [f"r{i:02d}" for i in range(30)]
    arcs = [
        (a, name, b)
        for name in names
        for a, _, b in random_arcs(rng, nodes, ["x"], rng.randint(0, 11))
    ]
    chain = [(f"c{i:03d}", "chain", f"c{i + 1:03d}") for i in range(20)]
    long_loop = [(f"c{i:03d}", "loop", f"c{(i + 1) if i < 29 else 7:03d}") for i in range(30)]
    arcs += chain + long_loop + [("z", "self", "z")]
    names += ["chain", "loop", "self"]
    schema = make_schema(spark, [(n, False, True) for n in names])
    scratch = Scratch(spark, "test-cycles")
    residual = residue(relation_edges(schema, make_edges(spark, arcs)), scratch)
    codes = {
        r["subject"][len("relation:"):]: r["code"]
        for r in cycle_verdicts(schema, residual).collect()
    }
    loops = {}
    for row in sorted(cycle_nodes(residual, scratch).collect(), key=lambda r: r["position"]):
        loops.setdefault(row["relation"], []).append(row["node"])
    for name in names:
        want = dfs_cycle([(a, b) for a, r, b in arcs if r == name])
        assert codes[name] == ("relation.cycle" if want else "relation.acyclic"), name
        assert loops.get(name) == want, name


def test_neighborhood(spark):
    arcs = [("a", "r", "b"), ("b", "r", "ghost"), ("ghost", "r", "c"), ("d", "r", "a"),
            ("a", "r", "a"), ("a", "r", "b")]
    entities = make_entities(spark, ["a", "b", "c", "d", "lone"]).unionByName(
        spark.createDataFrame([("b", "T", "later", [], "z.md")], ENTITY)
    )
    asked = [("0", "a", 0), ("1", "a", 1), ("3", "a", 3), ("lone", "lone", 2), ("no", "no", 1)]
    requests = spark.createDataFrame(asked, "request_id string, root string, depth int")
    nodes, connections, errors = neighborhood(entities, make_edges(spark, arcs), requests)
    got = {}
    for row in nodes.collect():
        got.setdefault(row["request_id"], set()).add((row["id"], row["title"]))
    later = ("b", "later")
    assert got == {
        "0": {("a", "a")},
        "1": {("a", "a"), later, ("d", "d")},
        "3": {("a", "a"), later, ("d", "d"), ("c", "c")},
        "lone": {("lone", "lone")},
    }
    counts = {}
    for row in connections.collect():
        counts[row["request_id"]] = counts.get(row["request_id"], 0) + 1
    assert counts == {"0": 1, "1": 4, "3": 6}
    assert [r["error"] for r in errors.collect()] == ["unknown entity 'no'"]


@pytest.mark.parametrize("limit", [None, 3])
def test_lookup_matches_brute_force(spark, limit):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abC é") for _ in range(rng.randint(1, 9)))
    rows = [(f"e{i}", "T", word(), [word() for _ in range(rng.randint(0, 3))], "d") for i in range(80)]
    needles = [word() for _ in range(150)] + ["e1", " E7 ", "", "  ", "zzz"]
    asked = spark.createDataFrame(list(enumerate(needles)), "query_id bigint, text string")
    got = {}
    for r in lookup(spark.createDataFrame(rows, ENTITY), asked, limit).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for number, needle in enumerate(needles):
        key, want = needle.strip().lower(), []
        for ident, _, title, aliases, _ in rows:
            title, aliases = title.strip().lower(), [a.strip().lower() for a in aliases]
            if not key:
                continue
            if ident == key:
                want.append((0, ident))
            elif title == key:
                want.append((1, ident))
            elif key in aliases:
                want.append((2, ident))
            elif key in ident or key in title or any(key in a for a in aliases):
                want.append((3, ident))
        assert sorted(got.get(number, [])) == sorted(want)[:limit], needle


def test_lookup_join_splits_hot_keys_and_keeps_every_row(spark):
    fact = spark.range(40000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS row")
    dim = spark.range(0, 30000).selectExpr("id AS k", "id * 2 AS twice")
    hot = hot_buckets(fact, ["k"])
    assert 1 <= hot.count() <= 2048
    assert hot.agg({"hot_salts": "max"}).first()[0] > 300
    for how in ("left", "inner", "left_semi"):
        got = lookup_join(fact, dim, ["k"], spread=["row"], how=how)
        want = fact.join(dim, "k", how)
        assert got.count() == want.count()
        assert got.exceptAll(want.select(got.columns)).isEmpty()


def test_many_roots_share_their_levels(spark):
    """Roots around a few hubs: far fewer level rows than reached pairs of root and node."""
    arcs = [(f"leaf{i:03d}", "r", f"hub{i % 3}") for i in range(384)] + [("hub0", "r", "hub1"), ("hub1", "r", "hub2")]
    starts = spark.createDataFrame([(f"leaf{i:03d}", 1 + i % 3) for i in range(384)], "start string, depth int")
    levels, placed = distances(make_edges(spark, arcs), starts, Scratch(spark, "test"))
    rows = levels.count()
    reached = {}
    for r in places(levels, "node", "level").join(placed, ["grp", "place"]).collect():
        reached.setdefault(r["start"], {})[r["node"]] = r["level"]
    near = {}
    for a, _, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in range(384):
        at, seen = {f"leaf{i:03d}"}, {}
        for level in range(4):
            for node in at:
                seen.setdefault(node, level)
            at = {n for node in at for n in near[node]} - set(seen)
        got = reached[f"leaf{i:03d}"]
        # shorter depths are cut off later, by request; a start may go on while others of its group do
        assert {n: d for n, d in got.items() if d <= 1 + i % 3} == {n: d for n, d in seen.items() if d <= 1 + i % 3}
    assert rows * 10 <= sum(map(len, reached.values()))


def test_a_lonely_goal_ends_the_flood(spark):
    """The side with the smaller frontier goes first, so a goal that nothing leads to costs its own row only."""
    arcs = [(f"a{i:02d}", "r", f"a{j:02d}") for i in range(40) for j in range(40) if i != j] + [("far", "r", "a00"), ("a39", "r", "end")]
    nodes = sorted({n for a, _, b in arcs for n in (a, b)} | {"lonely"})
    schema = make_schema(spark, [("r", False, False)])
    pairs = [(f"{n}>lonely", n, "lonely") for n in nodes if n != "lonely"]
    scratch = Scratch(spark, "test")
    asked = lambda rows: spark.createDataFrame(rows, "request_id string, from string, to string")
    request = _Request(schema, make_entities(spark, nodes), make_edges(spark, arcs), asked(pairs), scratch)
    assert {r["found"] for r in request.results().collect()} == {False}
    assert request.ends.forward.level == 0 and request.ends.backward.levels().count() == 1
    assert request.steps().count() == 0
    results, steps = shortest_paths(schema, make_entities(spark, nodes), make_edges(spark, arcs), asked([("x", "far", "end"), *pairs[:2]]))
    assert {r["request_id"]: r["hops"] for r in results.collect()} == {"x": 3, pairs[0][0]: None, pairs[1][0]: None}
    assert [(r["src"], r["dst"]) for r in steps.orderBy("hop").collect()] == [("far", "a00"), ("a00", "a39"), ("a39", "end")]


def plain_residue(arcs):
    alive = {a for a, _ in arcs}
    while True:
        left = {a for a, b in arcs if a in alive and b in alive}
        if left == alive:
            return {(a, b) for a, b in arcs if a in alive and b in alive}
        alive = left


def counted(scratch):
    names, write = [], scratch.write
    scratch.write = lambda df, name: (names.append(name), write(df, name))[1]
    return names


def residue_of(spark, arcs):
    scratch = Scratch(spark, "test")
    names = counted(scratch)
    rows = residue(spark.createDataFrame(arcs, "relation string, src string, dst string"), scratch).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}, len(names)


def test_residue_of_chains_cycles_and_random_graphs(spark):
    rng = random.Random(12)
    graphs = {
        "chain": [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)],
        "into a loop": [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("040", "030")],
        "loop with a tail": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")],
        "self": [("a", "a"), ("b", "a"), ("a", "c")],
        "ladder": [(f"{i:02d}", f"{i + k:02d}") for i in range(9) for k in (1, 2)],
        "tree": [(f"{i}", f"{i // 2}") for i in range(1, 60)],
        "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")],
    }
    for n in range(12):
        nodes = [f"n{i}" for i in range(rng.randint(2, 14))]
        graphs[f"random {n}"] = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randint(1, 16))})
    found, _ = residue_of(spark, [(name, a, b) for name, arcs in graphs.items() for a, b in arcs])
    for name, arcs in graphs.items():
        assert {(a, b) for r, a, b in found if r == name} == plain_residue(arcs), name


def test_rounds_grow_with_the_logarithm_of_a_chain(spark):
    chain = lambda n: [("r", f"{i:05d}", f"{i + 1:05d}") for i in range(n)]
    (short, few), (long, more) = residue_of(spark, chain(16)), residue_of(spark, chain(2048))
    assert not short and not long
    assert more - few <= 7 + 1  # 128 times as long


def test_connections_are_compared_for_all_roots_of_a_group_at_once(spark):
    roots = [f"r{i:02}" for i in range(40)]
    arcs = [("a", "r", "b")] + [(root, "r", end) for root in roots for end in "ab"]
    requests = spark.createDataFrame(
        [(f"{root}-{depth}", root, depth) for root in roots for depth in (0, 1)], "request_id string, root string, depth int"
    )
    scratch = Scratch(spark, "test")
    _, connections, _ = neighborhood(make_entities(spark, [*roots, "a", "b"]), make_edges(spark, arcs), requests, scratch)
    got = {}
    for row in connections.collect():
        got.setdefault(row["request_id"], set()).add((row["src"], row["dst"]))
    assert got == {f"{root}-1": {("a", "b"), (root, "a"), (root, "b")} for root in roots}
    groups = scratch.read("starts").select("grp").distinct().count()
    assert scratch.read("inside").filter("src = 'a' AND dst = 'b'").count() == groups < len(roots)


def test_places_of_all_bits(spark):
    rows = spark.createDataFrame([(1, -1, "all"), (2, -(2**63) + 256, "two"), (3, 0, "none")], "grp long, bits long, name string")
    got = sorted(tuple(r) for r in places(rows, "name").collect())
    assert got == [(1, "all", i) for i in range(64)] + [(2, "two", 8), (2, "two", 63)]


def test_nodes_and_connections_are_found_apart(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"n{i:02}" for i in range(30)]
    entities, edges = make_entities(spark, names), make_edges(spark, random_arcs(rng, names, ["r"], 60) + [("n00", "r", "n01")] * 5)
    requests = spark.createDataFrame([(n, n, i % 4) for i, n in enumerate(names)], "request_id string, root string, depth int")
    nodes, connections, _ = neighborhood(entities, edges, requests)
    monkeypatch.setattr(frontier, "FEW_ROWS", 0)  # from here on arcs are thinned and shuffle files freed in each step
    of_nodes, of_edges = Scratch(spark, "nodes"), Scratch(spark, "edges")
    alone = neighborhood_nodes(entities, edges, requests, of_nodes)
    assert sorted(alone.collect()) == sorted(nodes.collect())
    alone = neighborhood_connections(entities, edges, requests, of_edges)
    assert sorted(alone.collect()) == sorted(connections.collect())
    with pytest.raises(AnalysisException):
        of_nodes.read("inside")
    for gone in ("members", "ends"):
        with pytest.raises(AnalysisException):
            of_edges.read(gone)


def test_a_step_shuffles_the_arcs_of_its_frontier_alone(spark, monkeypatch):
    monkeypatch.setattr(frontier, "FEW_ROWS", 0)
    arcs = spark.range(5000).selectExpr("CAST(id AS STRING) AS node", "CAST(id + 1 AS STRING) AS next")
    starts = spark.createDataFrame([("7", 0, 0), ("9", 0, 1)], "start string, grp long, place int")
    met, join = [], frontier.two_sided_join
    monkeypatch.setattr(frontier, "two_sided_join", lambda left, *rest, **more: met.append(left.count()) or join(left, *rest, **more))
    search = Search(Scratch(spark, "test"), "near", arcs, starts)
    search.step()
    assert {(r.node, r.bits) for r in search.frontier.collect()} == {("8", 1), ("10", 2)}
    assert met[0] < 10


def test_lookup_carries_row_numbers_and_fetches_few_rows(spark):
    rows = [(f"e{i}", "T", f"name {i % 3}", [f"alias{i}"], "d") for i in range(60)] + [("e5", "T", "name again", [], "d")]
    asked = spark.createDataFrame([(1, "name"), (2, "e5"), (3, "alias7")], "query_id bigint, text string")
    for limit, many in ((None, 61), (4, 4)):
        scratch = Scratch(spark, "test")
        found = lookup(spark.createDataFrame(rows, ENTITY), asked, limit, scratch)
        got = [(r.query_id, r.rank, r.id, r.title) for r in found.collect()]
        assert len(got) == len(set(got)) and len([g for g in got if g[0] == 1]) == many
        # both rows of one identity, each once
        assert {g for g in got if g[:2] == (2, 0)} == {(2, 0, "e5", "name 2"), (2, 0, "e5", "name again")}
        assert {g for g in got if g[0] == 3} == {(3, 2, "e7", "name 1")}
    assert scratch.read("pairs").columns == ["needle", "row"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    ranked = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Window [" in line]
    assert ranked and not any("title" in line or "aliases" in line for line in ranked)


def test_path_joins_see_only_arcs_between_their_two_sides(spark):
    arcs = spark.range(5000).selectExpr("CAST(id AS STRING) AS node", "CAST(id + 1 AS STRING) AS next", "'r' AS relation", "'d' AS declaration")
    nodes = spark.createDataFrame([("7",), ("9",)], "node string")
    nexts = spark.createDataFrame([("8",), ("20",)], "node string")
    left = _between(arcs, nodes, nexts)
    assert left.columns == arcs.columns
    assert left.filter("node = '7' AND next = '8'").count() == 1 and left.count() < 10


def test_the_hops_of_a_level_are_joined_once(spark):
    names = [f"n{i}" for i in range(8)]
    arcs = [(a, "r", b) for a, b in zip(names, names[1:], strict=False)]
    scratch = Scratch(spark, "test")
    schema, pairs = make_schema(spark, [("r", False, False)]), spark.createDataFrame([("q", "n0", "n7")], "request_id string, from string, to string")
    _, steps = shortest_paths(schema, make_entities(spark, names), make_edges(spark, arcs), pairs, scratch)
    assert [(r.src, r.dst) for r in sorted(steps.collect(), key=lambda r: r.hop)] == [(a, b) for a, _, b in arcs]
    # written before its crowded keys are counted, and only with arcs that lead on
    assert scratch.read("leading-1").select("node", "next").collect() == [("n0", "n1")]
