"""Neighbourhoods together with the evidence of their connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.operators.adjacency import CONNECTION
from graphproof.operators.compile import selectors_of
from graphproof.operators.evidence import resolve_evidence
from graphproof.operators.neighborhood import neighborhood
from graphproof.session import Scratch
from graphproof.skew import lookup_join

EVIDENCE = ["state", "source", "exact", "start_line", "end_line", "message"]


def explain(
    entities: DataFrame,
    edges: DataFrame,
    sources: DataFrame,
    requests: DataFrame,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, explained, errors)`` for requests ``(request_id, root, depth)``.

    ``explained`` has one row per connection and selector: the connection, ``sel_ordinal`` and
    the resolved evidence; a connection without selectors has one row with nulls there. Equal
    connections show the evidence of the first of them. Each selector is resolved once, however
    many requests show it.
    """
    scratch = scratch or Scratch(edges.sparkSession, "explain")
    nodes, connections, errors = neighborhood(entities, edges, requests, scratch)
    connections = scratch.write(connections, "connections")
    shown = (
        connections.groupBy(*CONNECTION)
        .agg(F.min("decl_ordinal").alias("decl_ordinal"))
    )
    quoted = edges.join(shown, [*CONNECTION, "decl_ordinal"], "left_semi")
    resolved = scratch.write(resolve_evidence(selectors_of(quoted), sources), "resolved")
    evidence = resolved.select(*CONNECTION, "sel_ordinal", *EVIDENCE)
    explained = lookup_join(
        connections, evidence, CONNECTION, spread=["request_id", "decl_ordinal"]
    ).select("request_id", *CONNECTION, "decl_ordinal", "sel_ordinal", *EVIDENCE)
    return nodes, explained, errors
