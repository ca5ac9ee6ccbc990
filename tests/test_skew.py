"""Joins that split crowded keys give the rows of plain joins, and split them."""

import re
from collections import Counter

from pyspark.sql import functions as F

from graphproof import skew
from graphproof.operators.adjacency import directed
from graphproof.operators.cardinality import cardinality_rules
from graphproof.operators.entity_rules import entity_rules
from graphproof.operators.lookup import _maybe_among
from graphproof.skew import two_sided_join
from graphproof.sources.schema import RELATIONS_TABLE, schema_from_tables


def test_both_sides_may_crowd(spark):
    left = spark.createDataFrame(
        [("hub", i) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(200)], "key string, a int"
    )
    right = spark.createDataFrame(
        [("hub", i) for i in range(300)] + [("k1", 1), ("k2", 2), ("k2", 3), ("none", 4)], "key string, b int"
    )
    joined = two_sided_join(left, right, ["key"], ["a"], ["b"])
    assert joined.columns == ["key", "a", "b"]
    want = left.join(right, "key")
    assert joined.count() == joined.distinct().count() == want.count()
    assert joined.exceptAll(want).count() == 0


def test_a_next_node_shared_by_all_starts_is_split(spark):
    """20,000 starts wait on one node with one arc: no task joins more than a few shares of them."""
    arcs = spark.createDataFrame([("hub", "next")], "node string, next string")
    frontier = spark.range(20_000).select(F.col("id").cast("string").alias("start"), F.lit("hub").alias("node"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = two_sided_join(arcs, frontier, ["node"], ["next"], ["start"])
        per_task = Counter(r[0] for r in joined.select(F.spark_partition_id()).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(per_task.values()) == 20_000
    assert len(per_task) > 40 and max(per_task.values()) < 5 * 20_000 / 64


def test_rows_of_one_relation_are_not_dealt_by_it(spark, monkeypatch):
    """A schema has few keys: dealt by them, the rows of a relation would meet in one task."""
    many = spark.range(20_000).selectExpr("CAST(id AS STRING) AS src", "'r' AS relation", "id AS number").repartition(8, "number")
    declared = spark.createDataFrame([("r", True), ("unused", False)], "relation string, acyclic boolean")
    for how in ("left", "left_semi", "inner"):
        want = many.join(declared, ["relation"], how)
        joined = skew.schema_join(many, declared, ["relation"], spread=["src"], how=how)
        assert joined.columns == want.columns
        assert joined.exceptAll(want).count() == 0 and joined.count() == 20_000
        assert joined.select(F.spark_partition_id()).distinct().count() == 8
    monkeypatch.setattr(skew, "FEW_KEYS", 1)  # a schema too large to be broadcast
    large = skew.schema_join(many, declared, ["relation"], spread=["src"])
    assert large.exceptAll(many.join(declared, ["relation"], "left")).count() == 0 and large.count() == 20_000


def test_entities_of_one_type_are_not_dealt_by_it(spark):
    entities = spark.range(20_000).selectExpr(
        "concat('e', id) AS id", "'T' AS kind", "'t' AS title", "array('') AS aliases", "concat(id, '.md') AS document"
    )
    schema = schema_from_tables(
        spark.createDataFrame([("T", None)], "type string, description string"),
        spark.createDataFrame([("r", None, ["*"], ["*"], False, True)], RELATIONS_TABLE),
        spark.createDataFrame([("T", "r", 1, 2)], "type string, relation string, min bigint, max bigint"),
    )
    edges = entities.selectExpr(
        "id AS src", "'r' AS relation", "id AS dst", "document AS declaration", "CAST(0 AS BIGINT) AS decl_ordinal", "aliases AS evidence"
    )
    keys = {"kind": (cardinality_rules(schema, entities, edges), entity_rules(schema, entities)), "relation": (directed(schema, edges),)}
    for key, frames in keys.items():
        for frame in frames:  # not by the key alone
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert not re.search(rf"hashpartitioning\({key}#\d+, \d", plan)
            assert frame.count() == 20_000


def test_grams_that_are_no_anchor_are_dropped_before_the_join(spark):
    grams = spark.range(50_000).selectExpr("CAST(id AS STRING) AS id", "concat('g', id) AS gram")
    wanted = spark.range(100).selectExpr("concat('g', id * 7) AS gram", "id AS needle")
    left = _maybe_among(grams, wanted, "gram")
    assert left.columns == grams.columns
    assert left.join(wanted, "gram").count() == 100
    assert left.count() < 200
