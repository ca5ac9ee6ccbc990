"""Documents to graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.model import Graph
from graphproof.operators.order import with_position
from graphproof.session import Scratch


def entities_of(docs_meta: DataFrame) -> DataFrame:
    """One entity row per readable document; the title defaults to the id."""
    meta = docs_meta.filter(F.col("meta").isNotNull())
    return meta.select(
        F.col("meta.id").alias("id"),
        F.col("meta.type").alias("kind"),
        F.coalesce("meta.title", "meta.id").alias("title"),
        F.coalesce("meta.aliases", F.array().cast("array<string>")).alias("aliases"),
        "document",
    )


def edges_of(docs_meta: DataFrame) -> DataFrame:
    """One edge row per declared relation, numbered in declaration order."""
    meta = docs_meta.filter(F.col("meta").isNotNull())
    exploded = meta.select(
        F.col("meta.id").alias("src"),
        F.col("document").alias("declaration"),
        F.posexplode("meta.relations").alias("decl_ordinal", "decl"),
    )
    return exploded.select(
        "src",
        F.col("decl.relation").alias("relation"),
        F.col("decl.target").alias("dst"),
        "declaration",
        F.col("decl_ordinal").cast("bigint").alias("decl_ordinal"),
        F.col("decl.evidence").alias("evidence"),
    )


def compile_graph(docs_meta: DataFrame) -> Graph:
    return Graph(entities_of(docs_meta), edges_of(docs_meta))


def ordered_entities(entities: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Entities with their ``position`` in canonical order."""
    scratch = scratch or Scratch(entities.sparkSession, "order")
    return with_position(entities, ["id", "document"], scratch, "entities")


def ordered_edges(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Edges with their ``position`` in canonical order; the place in the declaration decides between equal connections."""
    scratch = scratch or Scratch(edges.sparkSession, "order")
    return with_position(edges, ["src", "relation", "dst", "declaration", "decl_ordinal"], scratch, "edges")


def selectors_of(edges: DataFrame) -> DataFrame:
    """One row per evidence selector of an edge, in order; edges without any give no row."""
    return edges.select(
        "src",
        "relation",
        "dst",
        "declaration",
        "decl_ordinal",
        F.posexplode("evidence").alias("sel_ordinal", "selector"),
    )
