"""Column expressions for text preparation and predicates. All of them stay in the JVM,
except Unicode normalization, which hands only the texts that may need it to Python."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphproof.fixed_values import FRONT_CLOSE, FRONT_OPEN, KEY_PATTERN

# Characters that canonical composition neither changes nor combines with a neighbour.
# Texts made of these alone are already composed (checked against unicodedata in the tests).
_COMPOSED_RANGES = (
    r"\x{0000}-\x{02FF}"  # Latin
    r"\x{0400}-\x{0482}\x{048A}-\x{052F}"  # Cyrillic
    r"\x{2010}-\x{205F}"  # general punctuation
    r"\x{20A0}-\x{20C0}"  # currency
    r"\x{3001}-\x{3029}\x{3041}-\x{3096}\x{309D}-\x{30FF}"  # CJK punctuation, kana
    r"\x{4E00}-\x{9FFF}"  # CJK ideographs
    r"\x{AC00}-\x{D7A3}"  # Hangul syllables
    r"\x{FF01}-\x{FFEE}"  # full-width forms
    r"\x{1F300}-\x{1FAFF}"  # pictographs
)
NEEDS_COMPOSING = f"[^{_COMPOSED_RANGES}]"
#: Texts that a worker composes at once.
COMPOSED = 64
#: All characters with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _composed(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):  # nothing in this batch needs composing
        return texts
    # few texts at a time are Python's; a whole batch of them takes several times the memory of its Arrow column
    parts = [
        pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.slice(i, COMPOSED).to_pylist()], texts.type)
        for i in range(0, len(texts), COMPOSED)
    ]
    return pa.concat_arrays(parts)


_compose = F.arrow_udf(_composed, T.StringType())


@F.pandas_udf(T.StringType())
def _compose_each(lists: pd.Series) -> pd.Series:
    """Lists of texts as JSON: Spark weighs an Arrow list column anew after each row, which takes the square of a batch."""
    if lists.isna().all():
        return lists
    return lists.map(
        lambda texts: json.dumps([None if t is None else unicodedata.normalize("NFC", t) for t in json.loads(texts)], ensure_ascii=False),
        na_action="ignore",
    )


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _suspicious(text: Column) -> Column:
    """Whether composing may change the text; ASCII is told by its length."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(NEEDS_COMPOSING)


def compose(text: Column) -> Column:
    """Unicode NFC. Texts that are composed already pass by without leaving the JVM."""
    return F.coalesce(_compose(F.when(_suspicious(text), text)), text)


def normalize_text(text: Column) -> Column:
    """Newline normalization, then NFC."""
    return compose(normalize_newlines(text))


def trim_unicode(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    # only characters at the ends are looked at; a pattern would be tried at each character of each row
    return F.btrim(text, F.lit(WHITE_SPACE))


def lookup_key(text: Column) -> Column:
    """The form in which lookup keys are compared: trimmed, composed, lower case."""
    return F.lower(compose(trim_unicode(text)))


def lookup_keys(texts: Column) -> Column:
    """:func:`lookup_key` of every element of an array."""
    trimmed = F.transform(texts, trim_unicode)
    suspicious = F.when(F.exists(trimmed, _suspicious), F.to_json(trimmed))
    composed = F.from_json(_compose_each(suspicious), T.ArrayType(T.StringType()))
    return F.transform(F.coalesce(composed, trimmed), F.lower)


def is_machine_key(text: Column) -> Column:
    return text.rlike(KEY_PATTERN)


def front_end(text: Column) -> Column:
    """Length of the frontmatter block with both delimiters, 0 where there is none."""
    close = F.locate(FRONT_CLOSE, text, len(FRONT_OPEN) + 1)
    return F.when(
        F.startswith(text, F.lit(FRONT_OPEN)) & (close > 0), close + len(FRONT_CLOSE) - 1
    ).otherwise(F.lit(0))


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_at(text: Column, offset: Column) -> Column:
    """One-based line of the character after ``offset`` characters."""
    return newlines(F.substr(text, F.lit(1), offset)) + 1


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part`` in ``text``, counted from the left."""
    rest = F.octet_length(text) - F.octet_length(F.replace(text, part, F.lit("")))
    return F.try_divide(rest, F.octet_length(part)).cast("bigint")


def path_parts(path: Column) -> Column:
    """Path components without empty and ``.`` parts."""
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def path_key(path: Column) -> Column:
    return F.array_join(path_parts(path), "/")


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def leaves_root(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "..")


def accepts(allowed: Column, kind: Column) -> Column:
    """Type acceptance: listed, or the list holds the wildcard."""
    return F.array_contains(allowed, "*") | F.array_contains(allowed, kind)


def same_members(left: Column, right: Column) -> Column:
    """Set equality of two arrays."""
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))
