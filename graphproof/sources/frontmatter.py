"""Frontmatter split and the strict decode of its YAML, run as a Spark job over documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.fixed_values import DOCUMENT_ERRORS, FRONT_CLOSE, FRONT_OPEN
from graphproof.functions.text import front_end, normalize_newlines, trim_unicode
from graphproof.model import META, fill

try:  # optional: only documents and schemas written as YAML need it
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

_NULLS = {"", "~", "null", "Null", "NULL"}
_BOOLS = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


class DecodeError(ValueError):
    """A document or schema that does not have the declared layout."""


# Layouts are plain data: field name -> (kind, required). A kind is a scalar name, a layout
# for a nested mapping, ("list", kind) or ("map", kind).
HINT_LAYOUT = {"start": ("count", True), "end": ("count", True)}
SELECTOR_LAYOUT = {
    "source": ("text?", False),
    "exact": ("text", True),
    "prefix": ("text?", False),
    "suffix": ("text?", False),
    "hint": (HINT_LAYOUT, False),
}
RELATION_LAYOUT = {
    "relation": ("text", True),
    "target": ("text", True),
    "evidence": (("list", SELECTOR_LAYOUT), False),
}
META_LAYOUT = {
    "id": ("text", True),
    "type": ("text", True),
    "title": ("text?", False),
    "aliases": (("list", "text"), False),
    "relations": (("list", RELATION_LAYOUT), False),
}


def load_yaml(text: str, layout: dict) -> dict:
    """Decode ``text`` against ``layout``; unknown, missing and repeated fields are errors.

    Scalars are taken by their text, so an id such as ``017`` or ``yes`` stays as written.
    """
    if yaml is None:
        raise RuntimeError("reading YAML needs the PyYAML package")
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        node = yaml.compose(text, Loader=loader)
    except yaml.YAMLError as error:
        raise DecodeError(re.sub(r"\s+", " ", str(error))) from None
    return _decode(node, layout, "document")


def _is_plain(node) -> bool:
    return isinstance(node, yaml.ScalarNode) and not node.style


def _is_null(node) -> bool:
    return _is_plain(node) and node.value in _NULLS


def _decode(node, kind, where: str):
    if isinstance(kind, dict):
        return _decode_fields(node, kind, where)
    if isinstance(kind, tuple):
        shape, inner = kind
        if node is None or (_is_null(node) and node.value == ""):
            return [] if shape == "list" else {}
        if shape == "list":
            if not isinstance(node, yaml.SequenceNode):
                raise DecodeError(f"{where}: expected a sequence")
            return [_decode(item, inner, f"{where}[{i}]") for i, item in enumerate(node.value)]
        return {key: _decode(value, inner, f"{where}.{key}") for key, value in _pairs(node, where)}
    if kind.endswith("?"):
        return None if _is_null(node) else _decode(node, kind[:-1], where)
    if not isinstance(node, yaml.ScalarNode):
        raise DecodeError(f"{where}: expected a scalar")
    if kind == "text":
        return node.value
    if kind == "flag":
        if not _is_plain(node) or node.value not in _BOOLS:
            raise DecodeError(f"{where}: expected true or false")
        return _BOOLS[node.value]
    if not _is_plain(node) or not re.fullmatch(r"\+?(0|[1-9][0-9]*)", node.value):
        raise DecodeError(f"{where}: expected a non-negative integer")
    return int(node.value)


def _pairs(node, where: str):
    if not isinstance(node, yaml.MappingNode):
        raise DecodeError(f"{where}: expected a mapping")
    seen = set()
    for key, value in node.value:
        if not isinstance(key, yaml.ScalarNode):
            raise DecodeError(f"{where}: field names must be scalars")
        if key.value in seen:
            raise DecodeError(f"{where}: duplicate field `{key.value}`")
        seen.add(key.value)
        yield key.value, value


def _decode_fields(node, layout: dict, where: str) -> dict | None:
    pairs = {} if node is None else dict(_pairs(node, where))
    for name in pairs:
        if name not in layout:
            raise DecodeError(f"{where}: unknown field `{name}`")
    out = {}
    for name, (kind, required) in layout.items():
        at = name if where == "document" else f"{where}.{name}"
        if name in pairs:
            optional_group = isinstance(kind, dict) and not required and _is_null(pairs[name])
            out[name] = None if optional_group else _decode(pairs[name], kind, at)
        elif required:
            raise DecodeError(f"{where}: missing field `{name}`")
        else:
            out[name] = [] if isinstance(kind, tuple) and kind[0] == "list" else (
                {} if isinstance(kind, tuple) else False if kind == "flag" else None
            )
    return out


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        metas, problems = [], []
        for text in batch["yaml"]:
            meta = problem = None
            if text is not None:
                try:
                    meta = load_yaml(text, META_LAYOUT)
                except DecodeError as error:
                    problem = str(error)
            metas.append(meta)
            problems.append(problem)
        yield pd.DataFrame(
            {
                "document": batch["document"],
                "split_error": batch["split_error"],
                "meta": metas,
                "problem": problems,
            }
        )


def split_frontmatter(documents: DataFrame) -> DataFrame:
    """``(document, content)`` to ``(document, yaml, body, split_error)``."""
    text = normalize_newlines(F.col("content"))
    name = F.col("document")
    opened = F.startswith(F.col("text"), F.lit(FRONT_OPEN))
    return (
        documents.select("document", text.alias("text"))
        .withColumn("front", front_end(F.col("text")))
        .select(
            "document",
            F.when(
                F.col("front") > 0,
                F.substr(
                    F.col("text"),
                    F.lit(len(FRONT_OPEN) + 1),
                    F.col("front") - len(FRONT_OPEN) - len(FRONT_CLOSE),
                ),
            ).alias("yaml"),
            F.when(F.col("front") > 0, F.substr(F.col("text"), F.col("front") + 1)).alias("body"),
            F.when(F.col("text").isNull(), F.lit(DOCUMENT_ERRORS["not_utf8"]))
            .when(~opened, fill(DOCUMENT_ERRORS["no_frontmatter"], name))
            .when(F.col("front") == 0, fill(DOCUMENT_ERRORS["no_close"], name))
            .alias("split_error"),
        )
    )


def parse_documents(documents: DataFrame, strict: bool = False) -> DataFrame:
    """``(document, content)`` to ``(document, meta, error)``.

    A document that cannot be read keeps its row with ``meta`` null and ``error`` set; with
    ``strict`` the job fails on the first such row instead.
    """
    split = split_frontmatter(documents).select("document", "yaml", "split_error")
    decoded = split.mapInPandas(
        _decode_batches,
        f"document string, split_error string, meta {META}, problem string",
    )
    blank = lambda c: trim_unicode(F.col(c)) == ""
    name = F.col("document")
    error = (
        F.when(F.col("split_error").isNotNull(), F.col("split_error"))
        .when(
            F.col("problem").isNotNull(),
            fill(DOCUMENT_ERRORS["invalid"], name, F.col("problem")),
        )
        .when(blank("meta.id"), fill(DOCUMENT_ERRORS["blank_id"], name))
        .when(blank("meta.type"), fill(DOCUMENT_ERRORS["blank_type"], name))
    )
    checked = decoded.select("document", "meta", error.alias("error"))
    if strict:
        checked = checked.withColumn(
            "error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string"))
        )
    return checked.withColumn("meta", F.when(F.col("error").isNull(), F.col("meta")))
