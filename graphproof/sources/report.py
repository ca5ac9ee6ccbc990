"""Report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphproof.operators.order import with_position
from graphproof.session import Scratch


def verdict_json(keep_nulls: bool = False) -> Column:
    """One verdict as a JSON object; absent values and an empty witness list are left out."""
    witness = F.when(F.size("witness") > 0, F.col("witness"))
    fields = F.struct("status", "code", "subject", "message", witness.alias("witness"))
    return F.to_json(fields, {"ignoreNullFields": "false" if keep_nulls else "true"})


def to_json_rows(df: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """Each row of ``df`` as one JSON object in the column ``json``."""
    option = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return df.select(F.to_json(F.struct(*df.columns), option).alias("json"))


def write_report(df: DataFrame, path: str, fmt: str = "json", keep_nulls: bool = False) -> None:
    """Write verdicts, paths, matches or any other result as JSON lines or Parquet."""
    if fmt == "json":
        df.write.option("ignoreNullFields", not keep_nulls).json(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def decision_json() -> Column:
    """One decision as a JSON object: ``entity`` stays when it is null, ``confidence`` is left out."""
    entity = F.when(
        F.col("entity_id").isNotNull(),
        F.struct(F.col("entity_id").alias("id"), "kind", "title", "document"),
    )
    kept = F.to_json(F.struct(entity.alias("entity")), {"ignoreNullFields": "false"})
    confidence = F.regexp_replace(F.to_json(F.struct("confidence")), r"\A\{", ",")
    return F.when(F.col("confidence").isNull(), kept).otherwise(
        F.concat(F.regexp_replace(kept, r"\}\z", ""), confidence)
    )


def report_rows(verdicts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Verdicts with their ``position`` in the canonical order of the report, and as ``json``."""
    scratch = scratch or Scratch(verdicts.sparkSession, "report")
    placed = with_position(verdicts, ["sort_key", "code"], scratch, "report").drop("sort_key")
    return placed.withColumn("json", verdict_json())


def write_validation(report, path: str, fmt: str = "json") -> None:
    """Write a validation report whole: its verdicts with their positions in canonical order, and the witnesses of any length.

    The long witnesses are tables of their own: ``cardinality_assertions`` and ``cycle_nodes``.
    """
    write_report(report_rows(report.verdicts).drop("json"), f"{path}/verdicts", fmt)
    write_report(report.cardinality_assertions, f"{path}/cardinality_assertions", fmt)
    write_report(report.cycle_nodes, f"{path}/cycle_nodes", fmt)
