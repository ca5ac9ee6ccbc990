"""A workspace folder as a graph: schema file, Markdown documents and evidence sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from graphproof.model import Graph, GraphSchema
from graphproof.operators.compile import compile_graph
from graphproof.plans.validation import ValidationReport, validate
from graphproof.session import Scratch
from graphproof.sources.corpus import read_corpus, read_sources
from graphproof.sources.frontmatter import parse_documents
from graphproof.sources.schema import read_schema


@dataclass(frozen=True)
class Workspace:
    schema: GraphSchema
    graph: Graph
    sources: DataFrame
    documents: DataFrame

    def validate(self) -> ValidationReport:
        return validate(self.schema, self.graph, self.sources)


def compile_workspace(
    spark: SparkSession,
    path: str,
    schema: str = "schema.yaml",
    knowledge: str = "knowledge",
    strict: bool = True,
) -> Workspace:
    """Read and compile a workspace. With ``strict``, an unreadable document fails the call;
    without, such documents keep an ``error`` in ``documents``. Documents are parsed once and written to
    the shared scratch folder, since every later step reads the graph tables more than once."""
    parsed = parse_documents(read_corpus(spark, path, knowledge), strict)
    documents = Scratch(spark, "workspace").write(parsed, "documents")
    return Workspace(
        schema=read_schema(spark, f"{path.rstrip('/')}/{schema}"),
        graph=compile_graph(documents),
        sources=read_sources(spark, path),
        documents=documents,
    )
