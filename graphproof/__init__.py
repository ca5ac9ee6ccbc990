"""Typed knowledge graphs with quoted evidence: compile, validate and query them on Spark."""

import sys

from pyspark import cloudpickle

from graphproof.model import Graph, GraphSchema
from graphproof.operators.compile import compile_graph, selectors_of
from graphproof.operators.decide import build_requests, check_answers, decide, decide_with_tables, escalate
from graphproof.operators.evidence import resolve_evidence
from graphproof.operators.explain import explain
from graphproof.operators.lookup import lookup
from graphproof.operators.neighborhood import neighborhood
from graphproof.operators.paths import shortest_lengths, shortest_paths
from graphproof.operators.summary import open_verdicts, require_valid, summarize
from graphproof.plans.validation import ValidationReport, validate
from graphproof.plans.workspace import Workspace, compile_workspace
from graphproof.session import Scratch
from graphproof.sources.corpus import read_corpus, read_sources
from graphproof.sources.frontmatter import parse_documents
from graphproof.sources.report import decision_json, to_json_rows, write_report, write_validation
from graphproof.sources.schema import read_schema, schema_from_tables, schema_from_yaml
from graphproof.verdicts import ordered

__all__ = [
    "Graph", "GraphSchema", "Scratch", "ValidationReport", "Workspace", "build_requests", "decide_with_tables",
    "check_answers", "compile_graph", "compile_workspace", "decide", "escalate", "explain",
    "lookup", "neighborhood", "open_verdicts", "ordered", "parse_documents", "read_corpus",
    "read_schema", "read_sources", "require_valid", "resolve_evidence", "schema_from_tables",
    "schema_from_yaml", "selectors_of", "shortest_lengths", "shortest_paths", "summarize", "to_json_rows",
    "decision_json", "validate", "write_report", "write_validation",
]

# Executors need not have this package installed: its task functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
