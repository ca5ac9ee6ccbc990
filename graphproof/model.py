"""Record layouts of the graph tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HINT = "struct<start:bigint,end:bigint>"
SELECTOR = f"struct<source:string,exact:string,prefix:string,suffix:string,hint:{HINT}>"
RELATION_DECL = f"struct<relation:string,target:string,evidence:array<{SELECTOR}>>"
META = (
    "struct<id:string,type:string,title:string,aliases:array<string>,"
    f"relations:array<{RELATION_DECL}>>"
)
EDGE_KEY = ["src", "relation", "dst", "declaration", "decl_ordinal"]

@dataclass(frozen=True)
class GraphSchema:
    """The declared schema as four tables (see README for their columns)."""

    meta: DataFrame
    types: DataFrame
    relations: DataFrame
    shapes: DataFrame


@dataclass(frozen=True)
class Graph:
    """A compiled graph: one row per entity declaration, one row per assertion."""

    entities: DataFrame
    edges: DataFrame


def fill(template: str, *values: Column | str) -> Column:
    """``template`` with each ``{}`` replaced by the next value, as one concat expression."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"{template!r} takes {len(pieces) - 1} values, got {len(values)}")
    out: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            out.append(F.lit(piece))
        if i < len(values):
            value = values[i]
            out.append((F.col(value) if isinstance(value, str) else value).cast("string"))
    return F.concat(*out) if len(out) > 1 else out[0]
