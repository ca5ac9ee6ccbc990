"""Positions, and reports as files."""

import json
import random

from pyspark.sql import functions as F

from graphproof import Graph, Scratch, validate
from graphproof.model import SELECTOR
from graphproof.operators.compile import ordered_edges, ordered_entities
from graphproof.operators.order import with_position
from graphproof.sources.report import decision_json, report_rows, write_validation
from graphproof.sources.schema import schema_from_yaml

SCHEMA = """
version: 1
types: {A: {constraints: {next: {min: 1}}}}
relations: {next: {from: [A], to: [A], acyclic: true}}
"""
ENTITY = "id string, kind string, title string, aliases array<string>, document string"
EDGE = f"src string, relation string, dst string, declaration string, decl_ordinal bigint, evidence array<{SELECTOR}>"


def test_positions_equal_a_sorted_list(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "ü", "Z"]), rng.randint(0, 400), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "part string, _number int, id int").repartition(7)
    placed = with_position(frame.withColumnRenamed("_number", "n"), ["part", "n", "id"], Scratch(spark, "test"))
    got = [tuple(r)[:3] for r in sorted(placed.collect(), key=lambda r: r["position"])]
    assert sorted(r["position"] for r in placed.collect()) == list(range(1, 3001))
    # bytes order, nulls first
    assert got == sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1], r[2]))
    assert with_position(frame.limit(0), ["id"], Scratch(spark, "test")).count() == 0


def test_entities_and_edges_in_canonical_order(spark):
    entities = spark.createDataFrame([(i, "A", i, [], d) for i, d in (("b", "2"), ("a", "9"), ("a", "1"), ("B", "1"))], ENTITY)
    got = sorted(ordered_entities(entities).collect(), key=lambda r: r["position"])
    assert [(r["id"], r["document"]) for r in got] == [("B", "1"), ("a", "1"), ("a", "9"), ("b", "2")]
    keys = [("b", "r", "a", "x", 0), ("a", "r", "b", "x", 1), ("a", "r", "b", "x", 0), ("a", "q", "z", "x", 2)]
    edges = spark.createDataFrame([(*k, []) for k in keys], EDGE)
    got = sorted(ordered_edges(edges).collect(), key=lambda r: r["position"])
    assert [tuple(r)[:5] for r in got] == sorted(keys)


def test_decision_json_keeps_a_null_entity(spark):
    rows = [("e", "A", "t", "d.md", 0.5), (None, None, None, None, None), ("e", "A", "t", "d.md", None), (None, None, None, None, 0.25)]
    frame = spark.createDataFrame(rows, "entity_id string, kind string, title string, document string, confidence double")
    entity = {"id": "e", "kind": "A", "title": "t", "document": "d.md"}
    got = [json.loads(r[0]) for r in frame.select(decision_json()).collect()]
    assert got == [{"entity": entity, "confidence": 0.5}, {"entity": None}, {"entity": entity}, {"entity": None, "confidence": 0.25}]


def test_a_written_report_is_whole_and_in_order(spark, tmp_path):
    entities = spark.createDataFrame([(i, k, i, [], f"{i}.md") for i, k in (("b", "A"), ("a", "A"), ("odd", "X"))], ENTITY)
    quote = ("t.txt", "owl", None, None, None)
    edges = spark.createDataFrame(
        [("a", "next", "b", "a.md", 0, [quote]), ("b", "next", "a", "b.md", 0, [])], EDGE
    )
    sources = spark.createDataFrame([("t.txt", "an owl")], "path string, content string")
    report = validate(schema_from_yaml(spark, SCHEMA), Graph(entities, edges), sources)
    rows = sorted(report_rows(report.verdicts).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["code"] for r in rows] == [
        "schema.version", "relation.contract", "shape.contract", "entity.type", "entity.type", "entity.unknown_type", "edge.structure",
        "evidence.resolved", "edge.structure", "edge.evidence", "shape.cardinality", "shape.cardinality", "relation.cycle",
    ]
    assert [json.loads(r["json"])["subject"] for r in rows][3:6] == ["a", "b", "odd"]
    for fmt in ("json", "parquet"):
        write_validation(report, f"{tmp_path}/{fmt}", fmt)
        read = getattr(spark.read, fmt)
        back = sorted(read(f"{tmp_path}/{fmt}/verdicts").collect(), key=lambda r: r["position"])
        assert [(r["position"], r["code"], r["subject"]) for r in back] == [(r["position"], r["code"], r["subject"]) for r in rows]
        assert read(f"{tmp_path}/{fmt}/cardinality_assertions").count() == 2
        loop = read(f"{tmp_path}/{fmt}/cycle_nodes").orderBy(F.col("position")).collect()
        assert [r["node"] for r in loop] == ["a", "b", "a"]
