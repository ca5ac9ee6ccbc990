"""File sources: knowledge documents and evidence texts, as tables keyed by relative path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.functions.text import (
    front_end,
    newlines,
    normalize_text,
    path_key,
    path_parts,
)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as the file system names it: with scheme, absolute, without ``.`` and ``..``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def relative_path(path: Column, root: str) -> Column:
    """The part of a file path below the qualified ``root``, with ``/`` between components.

    A path outside the root is an error, since ids and evidence would point nowhere.
    """
    inside = F.startswith(path, F.lit(f"{root}/"))
    below = F.substr(path, F.lit(len(root) + 2))
    outside = F.raise_error(F.concat(path, F.lit(f" is not below {root}")))
    return F.when(inside, F.replace(below, F.lit("\\"), F.lit("/"))).otherwise(outside)


def _read_files(spark: SparkSession, folder: str, root: str, glob: str | None) -> DataFrame:
    root = qualified(spark, root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = F.col("content").cast("string")
    return reader.load(folder).select(
        relative_path(F.col("path"), root).alias("path"),
        F.when(F.is_valid_utf8(text), text).alias("content"),
    )


def read_corpus(spark: SparkSession, workspace: str, knowledge: str = "knowledge") -> DataFrame:
    """Every Markdown file below ``workspace/knowledge`` as ``(document, content)``.

    ``content`` is null where a file is not UTF-8. Spark skips names that start with ``_``
    or ``.``.
    """
    files = _read_files(spark, f"{workspace.rstrip('/')}/{knowledge}", workspace, "*.[mM][dD]")
    return files.withColumnRenamed("path", "document")


def read_sources(spark: SparkSession, workspace: str) -> DataFrame:
    """Every file of the workspace as ``(path, content)``; content null if not UTF-8."""
    return _read_files(spark, workspace, workspace, None)


def searchable(sources: DataFrame) -> DataFrame:
    """Prepare texts once per source: ``(path_key, readable, region, region_line)``.

    ``region`` is the normalized text after any frontmatter and ``region_line`` the number of
    lines before it, so that line numbers refer to the whole file.
    """
    text = sources.select(
        path_key(F.col("path")).alias("path_key"), normalize_text(F.col("content")).alias("text")
    ).withColumn("front", front_end(F.col("text")))
    return text.select(
        "path_key",
        F.col("text").isNotNull().alias("readable"),
        F.substr(F.col("text"), F.col("front") + 1).alias("region"),
        newlines(F.substr(F.col("text"), F.lit(1), F.col("front"))).alias("region_line"),
    )


def folders(sources: DataFrame) -> DataFrame:
    """Distinct folders that the source paths imply, the root (empty key) included."""
    parts = path_parts(F.col("path"))
    depth = F.sequence(F.lit(0), F.size("parts") - 1)
    return (
        sources.select(parts.alias("parts"))
        .filter(F.size("parts") > 0)
        .select(F.explode(F.transform(depth, lambda n: F.slice("parts", 1, n))).alias("head"))
        .select(F.array_join("head", "/").alias("path_key"))
        .distinct()
    )
