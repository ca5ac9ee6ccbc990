"""Cardinality shapes: outgoing valid edges per entity and constrained relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.fixed_values import (
    MESSAGES,
    PATH_SHAPE,
    STATUS_SATISFIED,
    STATUS_VIOLATED,
    SUBJECT_COUNT,
)
from graphproof.model import GraphSchema
from graphproof.model import fill as fill_column
from graphproof.skew import lookup_join, schema_join
from graphproof.verdicts import Rule, emit, fill, text, when

PHASE = 6


def _constraints(schema: GraphSchema) -> DataFrame:
    declared = schema.relations.select("relation")
    return schema.shapes.join(declared, "relation", "left_semi").select(
        F.col("type").alias("kind"), "relation", "min", "max"
    )


def degree_counts(valid_edges: DataFrame) -> DataFrame:
    """Outgoing valid edges per ``(src, relation)``."""
    return valid_edges.groupBy("src", "relation").agg(F.count(F.lit(1)).alias("degree"))


def cardinality_rules(
    schema: GraphSchema, entities: DataFrame, valid_edges: DataFrame
) -> DataFrame:
    """One verdict per entity row and constraint of its type, also with no edge at all.

    The witness holds the constraint; the counted assertions, which may be any number, are
    the rows of :func:`cardinality_assertions`.
    """
    checks = schema_join(
        entities.select("id", "kind", "document"), _constraints(schema), ["kind"], spread=["id", "document"], how="inner"
    )
    counts = degree_counts(valid_edges).withColumnRenamed("src", "id")
    counted = (
        lookup_join(checks, counts, ["id", "relation"], spread=["document"])
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("broken", F.expr("coalesce(degree < min, false) OR coalesce(degree > max, false)"))
    )
    expected = (
        f"CASE WHEN min IS NOT NULL AND max IS NOT NULL THEN {fill('{}..={}', 'min', 'max')}"
        f" WHEN min IS NOT NULL THEN {fill('>={}', 'min')} ELSE {fill('<={}', 'max')} END"
    )
    message = when(
        "broken",
        fill(MESSAGES["shape.cardinality.violated"], "relation", "degree", expected),
        fill(MESSAGES["shape.cardinality.satisfied"], "relation", "degree"),
    )
    rule = Rule(
        "true", when("broken", text(STATUS_VIOLATED), text(STATUS_SATISFIED)),
        "'shape.cardinality'", message, fill(PATH_SHAPE, "kind", "relation"),
    )
    subject = fill(SUBJECT_COUNT, "id", "relation")
    return emit(counted, [rule], subject, [], PHASE, ["id", "document", "relation"])


def cardinality_assertions(
    schema: GraphSchema, entities: DataFrame, valid_edges: DataFrame
) -> DataFrame:
    """The counted assertions of each cardinality verdict, one row each, keyed by subject and
    by the constrained type.

    Long form on purpose: a hub may have any number of edges, which no single row should hold.
    """
    shaped = schema_join(
        entities.select(F.col("id").alias("src"), "kind").distinct(), _constraints(schema).select("kind", "relation"),
        ["kind"], spread=["src"], how="inner",
    )
    matched = lookup_join(
        valid_edges.select("src", "relation", "dst", "declaration", "decl_ordinal"),
        shaped,
        ["src", "relation"],
        spread=["declaration", "decl_ordinal"],
        how="inner",
    )
    return matched.select(
        fill_column(SUBJECT_COUNT, "src", "relation").alias("subject"),
        "kind", "src", "relation", "dst", "declaration", "decl_ordinal",
    )
