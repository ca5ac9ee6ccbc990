"""Shared expressions and plan pieces of the corpus operators.

Every operator selects the columns that it needs by name at once, so extra columns of its input,
whatever their names, never meet its own. Operators that hand documents on keep all columns and use
working names with a leading ``_llm_``, which they drop again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.session import Scratch
from graphproof.skew import within, without  # noqa: F401 - for the operators here

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACES = "\t\n\x0b\x0c\r"
#: Texts of a batch that are Python's at once.
LISTED = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def give_back() -> None:
    """Memory that earlier work of this worker left unused goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; workers wait for later tasks, so unused memory goes back before and after it."""

    def task(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return task


def listed(column: pa.Array) -> Iterator:
    """The values of a column of texts, few at a time; a whole batch of Python texts takes several times its column."""
    for i in range(0, len(column), LISTED):
        yield from column.slice(i, LISTED).to_pylist()


def only_spaces(text: Column) -> Column:
    """``text`` (null: empty) with every white-space character turned into a space."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def single_spaced(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space; the regex only sees runs."""
    text = only_spaces(text)
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def word_count(text: Column) -> Column:
    """Words (runs without white space) of ``text``: single spaces, trimmed, plus one."""
    text = F.trim(single_spaced(text))
    gaps = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def located(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with its content locator: the Parquet file and the row within it.

    A frame that is no plain file scan is written to scratch first; then its rows have locators too.
    """
    places = [
        F.col("_metadata.file_path").alias("_llm_file"),
        F.col("_metadata.row_index").alias("_llm_row"),
    ]
    try:
        return docs.select("*", *places)
    except AnalysisException:
        return scratch.write(docs, "located").select("*", *places)


def fetch_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (with ``_llm_file``, ``_llm_row``) beside the ``text`` found at their locators.

    Locators are unique, so the join has no hot key however often a text repeats; the narrow side
    is built into the hash table and the texts are not sorted.
    """
    place = ["_llm_file", "_llm_row"]
    texts = within(docs.select(*place, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), place, wanted)
    return texts.join(wanted.hint("shuffle_hash"), place)
