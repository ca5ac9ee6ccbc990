"""The full validation plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphproof.model import Graph, GraphSchema
from graphproof.operators.cardinality import cardinality_assertions, cardinality_rules
from graphproof.operators.cycles import find_cycles
from graphproof.operators.edge_rules import edge_verdicts, evidence_verdicts, judge_edges
from graphproof.operators.entity_rules import entity_rules
from graphproof.operators.schema_rules import schema_rules
from graphproof.session import Scratch


@dataclass(frozen=True)
class ValidationReport:
    """``verdicts`` holds every verdict. The two witnesses that may be of any length are kept in
    long form: the assertions counted by ``shape.cardinality`` and the loops of
    ``relation.cycle``."""

    verdicts: DataFrame
    cardinality_assertions: DataFrame
    cycle_nodes: DataFrame


def validate(
    schema: GraphSchema, graph: Graph, sources: DataFrame, scratch: Scratch | None = None
) -> ValidationReport:
    """Validate a graph against its schema and its evidence sources ``(path, content)``."""
    entities, edges = graph.entities, graph.edges
    scratch = scratch or Scratch(edges.sparkSession, "validate")
    # Judged edges feed four branches, so they are written once.
    judged = scratch.write(judge_edges(schema, entities, edges, scratch), "judged_edges")
    scratch.drop("linked_edges")
    valid = judged.filter("valid")
    cycle_rows, cycle_nodes = find_cycles(schema, valid, scratch)
    verdicts = (
        schema_rules(schema)
        .unionByName(entity_rules(schema, entities))
        .unionByName(edge_verdicts(judged))
        .unionByName(evidence_verdicts(judged, sources))
        .unionByName(cardinality_rules(schema, entities, valid))
        .unionByName(cycle_rows)
    )
    return ValidationReport(
        verdicts, cardinality_assertions(schema, entities, valid), cycle_nodes
    )
