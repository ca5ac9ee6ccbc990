"""Rules over the declared schema itself.

The schema tables are joined without hints: a schema read from YAML has an exact small size
and is broadcast by the optimizer, a schema derived from large tables is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.fixed_values import (
    MESSAGES,
    PATH_RELATION,
    PATH_RELATION_FROM,
    PATH_RELATION_TO,
    PATH_SHAPE,
    PATH_TYPE,
    PATH_VERSION,
    SCHEMA_VERSION,
    STATUS_SATISFIED,
    STATUS_VIOLATED,
    SUBJECT_RELATION,
    SUBJECT_SCHEMA,
    SUBJECT_SHAPE,
    SUBJECT_TYPE,
)
from graphproof.functions.text import accepts, is_machine_key, same_members
from graphproof.model import GraphSchema
from graphproof.verdicts import Rule, emit, fill, text, when

PHASE_VERSION, PHASE_TYPES, PHASE_RELATIONS, PHASE_SHAPES = 0, 1, 2, 3
SATISFIED, VIOLATED = text(STATUS_SATISFIED), text(STATUS_VIOLATED)


def version_rule(schema: GraphSchema) -> DataFrame:
    supported = f"version = {SCHEMA_VERSION}"
    message = when(
        supported,
        fill(MESSAGES["schema.version"], "version"),
        fill(MESSAGES["schema.version.unsupported"], "version", str(SCHEMA_VERSION)),
    )
    rule = Rule(
        "true", when(supported, SATISFIED, VIOLATED), "'schema.version'", message,
        text(PATH_VERSION),
    )
    return emit(schema.meta, [rule], text(SUBJECT_SCHEMA), [], PHASE_VERSION, [])


def type_rules(schema: GraphSchema) -> DataFrame:
    rule = Rule(
        "true", VIOLATED, "'type.invalid_name'", text(MESSAGES["type.invalid_name"]),
        fill(PATH_TYPE, "type"),
    )
    bad = schema.types.filter(~is_machine_key(F.col("type")))
    return emit(bad, [rule], fill(SUBJECT_TYPE, "type"), [], PHASE_TYPES, ["type"])


def _undeclared(schema: GraphSchema) -> DataFrame:
    """Undeclared type names in the lists of each relation, kept with their position."""
    listed = schema.relations.select(
        "relation", F.posexplode(F.concat("from", "to")).alias("place", "type")
    ).filter(F.col("type") != "*")
    return listed.join(schema.types.select("type"), "type", "left_anti")


def relation_rules(schema: GraphSchema) -> DataFrame:
    subject = fill(SUBJECT_RELATION, "relation")
    here = fill(PATH_RELATION, "relation")
    checks = {
        "relation.invalid_name": here,
        "relation.missing_domain": fill(PATH_RELATION_FROM, "relation"),
        "relation.missing_range": fill(PATH_RELATION_TO, "relation"),
        "relation.invalid_policy": here,
        "relation.symmetric_type_mismatch": here,
    }
    no_from, no_to = F.size("from") == 0, F.size("to") == 0
    flags = [
        ~is_machine_key(F.col("relation")),
        no_from,
        no_to,
        F.col("symmetric") & F.col("acyclic"),
        F.col("symmetric") & ~no_from & ~no_to & ~same_members(F.col("from"), F.col("to")),
    ]
    unknown = _undeclared(schema)
    with_unknown = unknown.select("relation").distinct().withColumn("has_unknown", F.lit(True))
    flagged = schema.relations.select(
        "relation", *[flag.alias(f"broken_{i}") for i, flag in enumerate(flags)]
    ).join(with_unknown, "relation", "left")

    rules = [
        Rule(f"broken_{i}", VIOLATED, text(code), text(MESSAGES[code]), path, i)
        for i, (code, path) in enumerate(checks.items())
    ]
    sound = " AND ".join(["has_unknown IS NULL", *[f"NOT broken_{i}" for i in range(len(checks))]])
    rules.append(
        Rule(
            sound, SATISFIED, "'relation.contract'", text(MESSAGES["relation.contract"]), here,
            len(checks) + 1,
        )
    )
    per_type = Rule(
        "true", VIOLATED, "'relation.unknown_type'", fill(MESSAGES["relation.unknown_type"], "type"),
        here, len(checks),
    )
    return emit(flagged, rules, subject, [], PHASE_RELATIONS, ["relation"]).unionByName(
        emit(unknown, [per_type], subject, [], PHASE_RELATIONS, ["relation"], sub="place")
    )


def shape_rules(schema: GraphSchema) -> DataFrame:
    known = schema.relations.select("relation", "from", F.lit(True).alias("declared"))
    coded = schema.shapes.join(known, "relation", "left").withColumn(
        "shape_code",
        F.when(F.col("declared").isNull(), F.lit("shape.unknown_relation"))
        .when(F.col("min").isNull() & F.col("max").isNull(), F.lit("shape.empty"))
        .when(F.col("min") > F.col("max"), F.lit("shape.invalid_range"))
        .when(~accepts(F.col("from"), F.col("type")), F.lit("shape.invalid_domain"))
        .otherwise(F.lit("shape.contract")),
    )
    values = {"shape.unknown_relation": ["relation"], "shape.invalid_domain": ["type", "relation"]}
    branches = " ".join(
        f"WHEN {text(code)} THEN {fill(MESSAGES[code], *values.get(code, []))}"
        for code in (
            "shape.unknown_relation", "shape.empty", "shape.invalid_range", "shape.invalid_domain",
            "shape.contract",
        )
    )
    rule = Rule(
        "true", when("shape_code = 'shape.contract'", SATISFIED, VIOLATED), "shape_code",
        f"CASE shape_code {branches} END", fill(PATH_SHAPE, "type", "relation"),
    )
    subject = fill(SUBJECT_SHAPE, "type", "relation")
    return emit(coded, [rule], subject, [], PHASE_SHAPES, ["type", "relation"])


def schema_rules(schema: GraphSchema) -> DataFrame:
    """All schema verdicts."""
    return (
        version_rule(schema)
        .unionByName(type_rules(schema))
        .unionByName(relation_rules(schema))
        .unionByName(shape_rules(schema))
    )
