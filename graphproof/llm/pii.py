"""Personal data: regular expressions propose spans, checksums confirm them, context scores them.

Everything is a column expression. ``split`` and ``regexp_extract_all`` walk a text by the same
leftmost non-overlapping matches, so the offsets of matches are running sums over gaps and matches,
in code points. Repeats are possessive and starts are bound to the start of a run, which
leaves the matches as they are but takes linear time on very long runs.

Kinds: email, ip (parts at most 255), card (14 to 19 digits passing Luhn), phone (10 to 15 digits);
the method adds iban (15 to 34 letters and digits with mod-97 remainder 1). A match that fails its
check is dropped without another try.

Every span has a score: the base of its kind, plus ``BOOST`` if a context word of its kind is
within ``WINDOW`` characters before or after it.

Defined cases: null and empty texts have no spans and counts of 0; spans of different kinds may
overlap; rows are judged one by one, so repeated rows repeat their result; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import table

WINDOW = 40
BOOST = 0.25
#: kind: pattern, characters that every match holds, base score, context words.
KINDS = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(text, '@')", 0.7, "mail|e-mail|contact|write|contacto|kontakt|courriel|correo",
    ),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "contains(text, '.') AND text RLIKE '[0-9][.][0-9]'", 0.5, "ip|host|server|address|login|adresse|servidor|serveur",
    ),
    "card": (
        r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
        "text RLIKE '[0-9][ -]?[0-9]'", 0.6, "card|credit|visa|mastercard|karte|carte|tarjeta|payment",
    ),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "contains(text, '+')", 0.5, "phone|call|tel|mobile|fax|telefon|telefono|portable",
    ),
    "iban": (
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])++",
        "text RLIKE '[A-Z][A-Z][0-9][0-9]'", 0.6, "iban|account|konto|compte|cuenta|bank",
    ),
}
BASE = ("email", "ip", "card", "phone")
#: The spans of one kind: start and end in code points, end exclusive.
_SPANS = "array<struct<start:int,end:int>>"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


#: SQL conditions on a match ``m``.
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS INT), 0) <= 255)",
    "card": f"""aggregate(array({_DIGITS}), false, (a, d) -> length(d) BETWEEN 14 AND 19 AND
        aggregate(transform(split(reverse(d), ''), (c, i) -> CAST(c AS INT) * (1 + i % 2) - if(i % 2 = 1 AND c > '4', 9, 0)),
          0, (s, v) -> s + v) % 10 = 0)""",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": """aggregate(array(replace(m, ' ', '')), false, (a, d) -> length(d) BETWEEN 15 AND 34 AND
        aggregate(split(concat(substr(d, 5), substr(d, 1, 4)), ''), 0,
          (s, c) -> if(c BETWEEN '0' AND '9', (s * 10 + CAST(c AS INT)) % 97, (s * 100 + ascii(c) - 55) % 97)) = 1)""",
}


def _spans(kind: str) -> str:
    """The confirmed spans of a kind in ``text``."""
    pattern, needs, *_ = KINDS[kind]
    walked = f"""aggregate(
        zip_with(split(text, {_sql(pattern)}, -1), regexp_extract_all(text, {_sql(pattern)}, 0), (g, m) -> named_struct('gap', length(g), 'm', m)),
        named_struct('at', 0, 'found', CAST(array() AS {_SPANS})),
        (s, x) -> if(x.m IS NULL, s, named_struct(
          'at', s.at + x.gap + length(x.m),
          'found', if(exists(array(x.m), m -> {_VALID[kind]}),
            array_append(s.found, named_struct('start', s.at + x.gap, 'end', s.at + x.gap + length(x.m))), s.found))),
        s -> s.found)"""
    return f"CASE WHEN {needs} THEN {walked} ELSE CAST(array() AS {_SPANS}) END"


def _labelled(kinds: tuple[str, ...]) -> str:
    """The spans of ``kinds`` as one array, by start, then by kind as listed."""
    parts = ", ".join(
        f"transform(`_llm_{k}`, s -> named_struct('start', s.start, 'rank', {list(KINDS).index(k)}, 'end', s.end, 'kind', '{k}'))"
        for k in kinds
    )
    return f"array_sort(concat({parts}))"


_JOINED = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
#: The score of span ``s``; the words around it are compared in lower case.
_BASE_SCORE = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {v[2]}D" for k, v in KINDS.items()) + " END"
_AROUND = f"lower(concat(substr(text, greatest(s.start - {WINDOW}, 0) + 1, least(s.start, {WINDOW})), ' ', substr(text, s.end + 1, {WINDOW})))"
_CONTEXT = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {_AROUND} RLIKE '\\\\b({v[3]})\\\\b'" for k, v in KINDS.items()) + " END"
_SCORED = f"transform(`_llm_all`, s -> concat(s.kind, ':', s.start, ':', s.end, ':', format_number({_BASE_SCORE} + if({_CONTEXT}, {BOOST}D, 0D), 2)))"


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, one span array per kind (``_llm_<kind>``), all spans by start (``_llm_all``)."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.selectExpr("*", *(f"{_spans(k)} AS `_llm_{k}`" for k in KINDS))
    return found.selectExpr("*", f"{_labelled(tuple(KINDS))} AS `_llm_all`")


def scored(all_spans: str = "_llm_all") -> Column:
    """kind:start:end:score of every span."""
    return F.expr(f"array_join({_SCORED.replace('_llm_all', all_spans)}, ',')")


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = find_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return found.selectExpr(
        "doc_id",
        *(f"CAST(size(`_llm_{k}`) AS BIGINT) AS n_{k}" for k in BASE),
        f"sha2({_JOINED.format(_labelled(BASE))}, 256) AS base_sha256",
        f"{_JOINED.format('`_llm_all`')} AS spans",
        f"array_join({_SCORED}, ',') AS scored_spans",
    )
