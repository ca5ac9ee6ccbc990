"""Workspaces on disk: a small museum register, compiled, validated and queried."""

import pytest

from graphproof import compile_workspace, lookup, neighborhood, resolve_evidence, selectors_of
from graphproof import shortest_paths, summarize, write_report

REGISTER = """version: 1
types:
  Painting: {constraints: {hangs_in: {min: 1, max: 1}}}
  Room: {}
  Keeper: {}
relations:
  hangs_in: {from: [Painting], to: [Room], acyclic: true}
  watched_by: {from: [Room], to: [Keeper]}
  adjoins: {from: [Room], to: [Room], symmetric: true}
"""


def page(id_, kind, relations=(), aliases=(), body=""):
    """A document; relations are (relation, target, selector lines)."""
    lines = ["---", f"id: {id_}", f"type: {kind}"]
    if aliases:
        lines.append(f"aliases: [{', '.join(aliases)}]")
    if relations:
        lines.append("relations:")
    for relation, target, *selectors in relations:
        lines.append(f"  - {{relation: {relation}, target: {target}, evidence: [{', '.join(selectors)}]}}")
    return "\n".join([*lines, "---", body, ""])


MUSEUM = {
    "rooms/north.md": page(
        "room:north", "Room", [("watched_by", "keeper:ines", '{exact: "Ines holds the keys."}'), ("adjoins", "room:south", '{exact: "A door leads south."}')],
        body="Ines holds the keys.\nA door leads south.",
    ),
    "rooms/south.md": page("room:south", "Room", aliases=["Südsaal"], body="Empty since spring."),
    "harbour.md": page(
        "painting:harbour", "Painting", [("hangs_in", "room:north", '{exact: "Shown in the north room.", hint: {start: 1, end: 1}}')], aliases=["Boats at dusk"],
        body="Oil on wood.\n\nShown in the north room.",
    ),
    "keepers/ines.md": page("keeper:ines", "Keeper"),
}


def register(spark, folder, pages, schema=REGISTER, **options):
    for name, content in {"schema.yaml": schema, **{f"knowledge/{n}": c for n, c in pages.items()}}.items():
        target = folder / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
    return compile_workspace(spark, str(folder), **options)


def found_codes(ws):
    verdicts = ws.validate().verdicts.select("status", "code", "subject").collect()
    return {(r["status"], r["code"], r["subject"]) for r in verdicts}


def test_register_compiles_and_validates_whole(spark, tmp_path):
    ws = register(spark, tmp_path, MUSEUM)
    ids = {r["id"]: r["document"] for r in ws.graph.entities.collect()}
    assert ids == {
        "room:north": "knowledge/rooms/north.md", "room:south": "knowledge/rooms/south.md",
        "painting:harbour": "knowledge/harbour.md", "keeper:ines": "knowledge/keepers/ines.md",
    }
    report = ws.validate()
    assert summarize(report.verdicts).first()["is_complete"]
    states = {r["src"] + ">" + r["dst"]: (r["state"], r["start_line"]) for r in resolve_evidence(selectors_of(ws.graph.edges), ws.sources).collect()}
    assert states == {
        "room:north>keeper:ines": ("valid", 8), "room:north>room:south": ("valid", 9),
        "painting:harbour>room:north": ("relocated", 10),
    }


def test_queries_over_the_register(spark, tmp_path):
    ws = register(spark, tmp_path, MUSEUM)
    asked = spark.createDataFrame([(1, "boats AT dusk "), (2, "Südsaal"), (3, "room:")], "query_id bigint, text string")
    hits = sorted((r["query_id"], r["match"], r["id"]) for r in lookup(ws.graph.entities, asked).collect())
    assert hits == [(1, "alias", "painting:harbour"), (2, "alias", "room:south"), (3, "contains", "room:north"), (3, "contains", "room:south")]
    pairs = spark.createDataFrame(
        [(1, "painting:harbour", "keeper:ines"), (2, "room:south", "keeper:ines"), (3, "keeper:ines", "room:north")],
        "request_id bigint, from string, to string",
    )
    results, steps = shortest_paths(ws.schema, ws.graph.entities, ws.graph.edges, pairs)
    assert {r["request_id"]: r["hops"] for r in results.collect()} == {1: 2, 2: 2, 3: None}
    taken = sorted((r["request_id"], r["hop"], r["src"], r["relation"], r["dst"]) for r in steps.collect())
    assert taken[2:] == [(2, 0, "room:south", "adjoins", "room:north"), (2, 1, "room:north", "watched_by", "keeper:ines")]
    roots = spark.createDataFrame([(1, "keeper:ines", 1)], "request_id bigint, root string, depth int")
    nodes, _, _ = neighborhood(ws.graph.entities, ws.graph.edges, roots)
    assert {r["id"] for r in nodes.collect()} == {"keeper:ines", "room:north"}


def test_faults_of_one_register_and_its_report(spark, tmp_path):
    pages = dict(MUSEUM)
    pages["lost.md"] = page("painting:lost", "Painting")
    pages["rooms/south.md"] = page(
        "room:south", "Room", [("watched_by", "keeper:ines", '{exact: "Ines looks in.", prefix: "Today "}')], body="Yesterday Ines looks in.",
    )
    pages["harbour.md"] = pages["harbour.md"].replace("\n\nShown in the north room.", "\n\nOn loan.")
    schema = REGISTER + "  lent_to: {from: [Painting], to: [Room], symmetric: true}\n"
    ws = register(spark, tmp_path, pages, schema)
    report = ws.validate()
    codes = found_codes(ws)
    assert {(s, c) for s, c, _ in codes} >= {
        ("violated", "shape.cardinality"), ("violated", "relation.symmetric_type_mismatch"), ("unknown", "evidence.unresolved"),
    }
    assert sum(c == "evidence.unresolved" for _, c, _ in codes) == 2
    totals = summarize(report.verdicts).first()
    assert totals["violated"] == 2 and not totals["can_query"]
    folder = str(tmp_path / "out")
    write_report(report.verdicts, folder)
    assert spark.read.json(folder).count() == report.verdicts.count()


def test_unreadable_documents_fail_or_stay_with_their_error(spark, tmp_path):
    pages = {"plain.md": "only prose", "binary.md": b"---\nid: \xfe\n---\n", "keepers/ines.md": MUSEUM["keepers/ines.md"]}
    with pytest.raises(Exception, match="must start with YAML frontmatter|valid UTF-8"):
        register(spark, tmp_path, pages)
    ws = register(spark, tmp_path, pages, strict=False)
    errors = {r["document"]: r["error"] for r in ws.documents.collect()}
    assert errors == {
        "knowledge/plain.md": "knowledge/plain.md: knowledge document must start with YAML frontmatter",
        "knowledge/binary.md": "stream did not contain valid UTF-8", "knowledge/keepers/ines.md": None,
    }
    assert [r["id"] for r in ws.graph.entities.collect()] == ["keeper:ines"]


def test_roots_are_resolved_by_the_file_system(spark, tmp_path, monkeypatch):
    """Dots, ``..`` and a name that occurs in the path before don't change the documents' keys."""
    inner = tmp_path / "ws" / "x" / "ws"
    register(spark, inner, MUSEUM)
    want = {f"knowledge/{n}" for n in MUSEUM}
    # relative roots count from the JVM's working folder
    import os
    relative = os.path.relpath(inner, spark._jvm.java.lang.System.getProperty("user.dir"))
    for root in (f"{inner}/", f"{tmp_path}/ws/x/../x/./ws", relative, f"./{relative}", f"file://{inner}"):
        ws = compile_workspace(spark, root)
        assert {r["document"] for r in ws.graph.entities.collect()} == want, root
        assert summarize(ws.validate().verdicts).first()["is_complete"]
