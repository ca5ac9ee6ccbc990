"""One small graph per group of rules; each code is checked by subject."""

from graphproof import Graph, GraphSchema, ordered, require_valid, summarize, validate
from graphproof.model import SELECTOR
from graphproof.operators.schema_rules import schema_rules
from graphproof.operators.summary import GraphInvalid
from graphproof.sources.schema import schema_from_yaml

import pytest
from pyspark.errors import AnalysisException

EDGE = (
    "src string, relation string, dst string, declaration string, decl_ordinal bigint, "
    f"evidence array<{SELECTOR}>"
)
ENTITY = "id string, kind string, title string, aliases array<string>, document string"


def by_code(verdicts):
    out = {}
    for row in verdicts.collect():
        out.setdefault(row["code"], []).append(row["subject"])
    return {code: sorted(subjects) for code, subjects in out.items()}


def test_schema_rules(spark):
    schema = schema_from_yaml(
        spark,
        """
version: 2
types: {A: {constraints: {good: {min: 1, max: 2}, none: {min: 1}, open: {}, wrong: {max: 1}}},
        "b c": {constraints: {good: {min: 3, max: 1}}}, B: {constraints: {good: {min: 1}}}}
relations:
  good: {from: [A], to: ['*']}
  open: {from: ['*'], to: [A], symmetric: true}
  wrong: {from: [B], to: [X, A, X]}
  "bad name": {from: [A], to: [A]}
  bare: {}
  both: {from: [A, B, A], to: [B, A], symmetric: true, acyclic: true}
""",
    )
    verdicts = schema_rules(schema)
    assert by_code(verdicts) == {
        "schema.version": ["schema"],
        "type.invalid_name": ["type:b c"],
        "relation.invalid_name": ["relation:bad name"],
        "relation.missing_domain": ["relation:bare"],
        "relation.missing_range": ["relation:bare"],
        "relation.invalid_policy": ["relation:both"],
        "relation.symmetric_type_mismatch": ["relation:open"],
        "relation.unknown_type": ["relation:wrong"] * 2,
        "relation.contract": ["relation:good"],
        "shape.unknown_relation": ["shape:A.none"],
        "shape.empty": ["shape:A.open"],
        "shape.invalid_range": ["shape:b c.good"],
        "shape.invalid_domain": ["shape:A.wrong", "shape:B.good"],
        "shape.contract": ["shape:A.good"],
    }
    version = verdicts.filter("code = 'schema.version'").first()
    assert version["message"] == "unsupported schema version 2; expected 1"
    first = ordered(verdicts).first()
    assert first["code"] == "schema.version"


SCHEMA = """
version: 1
types:
  A: {constraints: {needs: {min: 1, max: 1}, free: {max: 1}}}
  B: {}
relations:
  needs: {from: [A], to: [B]}
  free: {from: [A], to: ['*']}
  same: {from: [A, B], to: [A, B], symmetric: true}
  line: {from: ['*'], to: ['*'], acyclic: true}
"""


def graph(spark, entities, edges):
    rows = [(s, r, d, f"{s}.md", i, ev) for i, (s, r, d, ev) in enumerate(edges)]
    listed = [(i, k, i, [], doc) for i, k, doc in entities]
    return Graph(spark.createDataFrame(listed, ENTITY), spark.createDataFrame(rows, EDGE))


def test_entity_and_edge_rules(spark):
    quote = [("t.txt", "found", None, None, None)]
    entities = [
        ("a1", "A", "1.md"), ("a2", "A", "2.md"), ("b1", "B", "3.md"), ("bad id", "B", "4.md"),
        ("x", "Z", "5.md"), ("twice", "A", "6.md"), ("twice", "B", "7.md"), ("twice", "B", "8.md"),
    ]
    edges = [
        ("a1", "needs", "b1", quote),
        ("a1", "needs", "b1", quote),  # repeated: neither counted nor resolved
        ("a1", "needs", "twice", []),  # the last declaration of twice is a B
        ("a2", "same", "b1", quote),
        ("b1", "same", "a2", quote),  # repeated by symmetry
        ("b1", "needs", "a1", [("t.txt", "gone", None, None, None)]),  # both ends wrong
        ("nobody", "needs", "b1", []),
        ("a1", "needs", "nobody", []),
        ("a1", "unheard", "b1", []),
        ("a1", "line", "a2", quote), ("a2", "line", "b1", quote), ("b1", "line", "a1", quote),
    ]
    sources = spark.createDataFrame([("t.txt", "found")], "path string, content string")
    report = validate(
        schema_from_yaml(spark, SCHEMA), graph(spark, entities, edges), sources
    )
    codes = by_code(report.verdicts)
    assert codes["entity.invalid_id"] == ["bad id"]
    assert codes["entity.duplicate_id"] == ["twice", "twice"]
    assert codes["entity.type"] == ["a1", "a2", "b1", "bad id", "twice"]
    assert codes["entity.unknown_type"] == ["x"]
    assert codes["edge.missing_source"] == ["nobody --needs--> b1"]
    assert codes["edge.missing_target"] == ["a1 --needs--> nobody"]
    assert codes["edge.unknown_relation"] == ["a1 --unheard--> b1"]
    assert codes["edge.duplicate_assertion"] == ["a1 --needs--> b1", "b1 --same--> a2"]
    assert codes["edge.domain_mismatch"] == ["b1 --needs--> a1"]
    assert codes["edge.range_mismatch"] == ["b1 --needs--> a1"]
    assert len(codes["edge.structure"]) == 6
    assert codes["edge.evidence"] == ["a1 --needs--> twice"]
    assert len(codes["evidence.resolved"]) == 5
    assert codes["evidence.unresolved"] == ["b1 --needs--> a1"]
    assert codes["relation.cycle"] == ["relation:line"]
    counts = {
        (r["subject"], r["status"]): r["message"]
        for r in report.verdicts.filter("code = 'shape.cardinality'").collect()
    }
    assert counts == {
        ("a1:needs", "violated"): "relation 'needs' count is 2; expected 1..=1",
        ("a1:free", "satisfied"): "relation 'free' count 0 satisfies shape",
        ("a2:needs", "violated"): "relation 'needs' count is 0; expected 1..=1",
        ("a2:free", "satisfied"): "relation 'free' count 0 satisfies shape",
        ("twice:needs", "violated"): "relation 'needs' count is 0; expected 1..=1",
        ("twice:free", "satisfied"): "relation 'free' count 0 satisfies shape",
    }
    loop = sorted((r["position"], r["node"]) for r in report.cycle_nodes.collect())
    assert [node for _, node in loop] == ["a1", "a2", "b1", "a1"]
    counted = {(r["subject"], r["dst"]) for r in report.cardinality_assertions.collect()}
    assert counted == {("a1:needs", "b1"), ("a1:needs", "twice")}
    assert not summarize(report.verdicts).first()["can_query"]
    with pytest.raises(GraphInvalid, match="structural violation"):
        require_valid(report.verdicts)


def test_many_copies_of_one_assertion_keep_one_leader(spark):
    rows = spark.range(5000).selectExpr(
        "'a1' AS src", "'needs' AS relation", "'b1' AS dst", "'1.md' AS declaration",
        "id AS decl_ordinal", f"CAST(array() AS array<{SELECTOR}>) AS evidence",
    )
    listed = [("a1", "A", "a1", [], "1.md"), ("b1", "B", "b1", [], "2.md")]
    entities = spark.createDataFrame(listed, ENTITY)
    sources = spark.createDataFrame([], "path string, content string")
    schema: GraphSchema = schema_from_yaml(spark, SCHEMA)
    report = validate(schema, Graph(entities, rows), sources)
    codes = by_code(report.verdicts)
    assert len(codes["edge.duplicate_assertion"]) == 4999
    assert len(codes["edge.structure"]) == len(codes["edge.evidence"]) == 1


def test_long_chains_beside_a_cycle_keep_only_the_cycle(spark):
    """A relation leaves the rounds when it stands still; a chain is contracted to nothing in the first one."""
    from graphproof.operators.cycles import residue
    from graphproof.session import Scratch

    chain = [("chain", f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    loop = [("loop", "a", "b"), ("loop", "b", "a"), ("loop", "z", "a"), ("loop", "a", "end")]
    edges = spark.createDataFrame(chain + loop, "relation string, src string, dst string")
    scratch = Scratch(spark, "chain")
    kept = {tuple(r) for r in residue(edges, scratch).select("relation", "src", "dst").collect()}
    assert kept == {("loop", "a", "b"), ("loop", "b", "a"), ("loop", "z", "a")}
    rounds = [scratch.read(f"arcs-{i}").select("relation").distinct() for i in (1, 2)]
    assert [r[0] for r in rounds[0].collect()] == ["loop"] and rounds[1].isEmpty()
    scratch.close()


def test_edges_without_copies_are_marked_without_a_join(spark, monkeypatch):
    from graphproof.operators import edge_rules
    from graphproof.session import Scratch

    schema = schema_from_yaml(spark, SCHEMA)
    names = [(f"a{i}", "A", f"a{i}", [], "1.md") for i in range(40)] + [("b1", "B", "b1", [], "2.md")]
    edges = spark.range(400).selectExpr(
        "concat('a', id % 40) AS src", "IF(id < 40 OR id = 47, 'needs', concat('r', id)) AS relation", "'b1' AS dst",
        "'1.md' AS declaration", "id AS decl_ordinal", f"CAST(array() AS array<{SELECTOR}>) AS evidence",
    )
    met, join = [], edge_rules.lookup_join

    def watched(fact, lookup, on, **more):
        if on == edge_rules.SEMANTIC_KEY:
            met.append(fact.count())
        return join(fact, lookup, on, **more)

    monkeypatch.setattr(edge_rules, "lookup_join", watched)
    scratch = Scratch(spark, "test")
    judged = edge_rules.judge_edges(schema, spark.createDataFrame(names, ENTITY), edges, scratch)
    assert [(r.src, r.decl_ordinal) for r in judged.filter("repeated").collect()] == [("a7", 47)]
    assert judged.count() == 400 and judged.filter("valid").count() == 40
    assert len(met) == 2 and max(met) < 40
    assert "end_a" not in scratch.read("linked_edges").columns
    with pytest.raises(AnalysisException):
        scratch.read("linked_sources")
