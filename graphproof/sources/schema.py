"""The declared schema: from YAML text or from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.model import GraphSchema
from graphproof.sources.frontmatter import load_yaml

META_TABLE = "version bigint"
TYPES_TABLE = "type string, description string"
RELATIONS_TABLE = (
    "relation string, description string, from array<string>, to array<string>, "
    "symmetric boolean, acyclic boolean"
)
SHAPES_TABLE = "type string, relation string, min bigint, max bigint"

_CARDINALITY = {"min": ("count?", False), "max": ("count?", False)}
_TYPE = {"description": ("text?", False), "constraints": (("map", _CARDINALITY), False)}
_RELATION = {
    "description": ("text?", False),
    "from": (("list", "text"), False),
    "to": (("list", "text"), False),
    "symmetric": ("flag", False),
    "acyclic": ("flag", False),
}
SCHEMA_LAYOUT = {
    "version": ("count", True),
    "types": (("map", _TYPE), False),
    "relations": (("map", _RELATION), False),
}


def schema_from_yaml(spark: SparkSession, text: str) -> GraphSchema:
    """Decode a schema document; unknown fields are errors."""
    loaded = load_yaml(text, SCHEMA_LAYOUT)
    types, relations = loaded["types"], loaded["relations"]
    return GraphSchema(
        meta=spark.createDataFrame([(loaded["version"],)], META_TABLE),
        types=spark.createDataFrame(
            [(name, spec["description"]) for name, spec in types.items()], TYPES_TABLE
        ),
        relations=spark.createDataFrame(
            [
                (n, s["description"], s["from"], s["to"], s["symmetric"], s["acyclic"])
                for n, s in relations.items()
            ],
            RELATIONS_TABLE,
        ),
        shapes=spark.createDataFrame(
            [
                (name, relation, bounds["min"], bounds["max"])
                for name, spec in types.items()
                for relation, bounds in spec["constraints"].items()
            ],
            SHAPES_TABLE,
        ),
    )


def read_schema(spark: SparkSession, path: str) -> GraphSchema:
    """Read one YAML schema file through Spark's file systems."""
    row = spark.read.text(path, wholetext=True).first()
    return schema_from_yaml(spark, row["value"] if row else "")


def schema_from_tables(
    types: DataFrame, relations: DataFrame, shapes: DataFrame, version: int | DataFrame = 1
) -> GraphSchema:
    """A schema held in tables, for instance read from Parquet."""
    meta = (
        version
        if isinstance(version, DataFrame)
        else types.sparkSession.createDataFrame([(version,)], META_TABLE)
    )
    return GraphSchema(
        meta=meta,
        types=types.select("type", "description"),
        relations=relations.select(
            "relation",
            "description",
            F.coalesce("from", F.array()).cast("array<string>").alias("from"),
            F.coalesce("to", F.array()).cast("array<string>").alias("to"),
            F.coalesce("symmetric", F.lit(False)).alias("symmetric"),
            F.coalesce("acyclic", F.lit(False)).alias("acyclic"),
        ),
        shapes=shapes.select(
            "type", "relation", F.col("min").cast("bigint"), F.col("max").cast("bigint")
        ),
    )
