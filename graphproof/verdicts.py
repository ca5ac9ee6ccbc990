"""Builders for verdict rows.

A rule set is applied in two steps: each row is first unnested into the numbers of the rules that
fire on it, then the verdict columns are chosen by that number. Each column is built once per
verdict, which keeps the generated code small enough to be compiled. Expressions are put together as SQL
text and parsed once per rule set, which keeps planning short on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

_WITNESS_FIELDS = {
    "kind": "string", "path": "string", "from": "string", "relation": "string", "to": "string",
    "source": "string", "state": "string", "exact": "string", "start_line": "bigint",
    "end_line": "bigint",
}
_KEY_FIELDS = {
    "phase": "int", "k1": "string", "k2": "string", "k3": "string", "k4": "string",
    "ord": "bigint", "step": "int", "sub": "int",
}


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def fill(template: str, *values: str) -> str:
    """``template`` as a SQL expression, each ``{}`` replaced by the next SQL value."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"{template!r} takes {len(pieces) - 1} values, got {len(values)}")
    parts = []
    for i, piece in enumerate(pieces):
        if piece:
            parts.append(text(piece))
        if i < len(values):
            parts.append(f"CAST({values[i]} AS STRING)")
    return f"concat({', '.join(parts)})"


def _struct(fields: dict[str, str], given: dict[str, str]) -> str:
    cells = [
        f"'{name}', CAST({given.get(name, 'NULL')} AS {kind})" for name, kind in fields.items()
    ]
    return f"named_struct({', '.join(cells)})"


def schema_witness(path: str) -> str:
    return _struct(_WITNESS_FIELDS, {"kind": "'schema'", "path": path})


def declaration_witness(path: str) -> str:
    return _struct(_WITNESS_FIELDS, {"kind": "'declaration'", "path": path})


def assertion_witness() -> str:
    """The assertion of a row with the columns ``src, relation, dst``."""
    return _struct(
        _WITNESS_FIELDS, {"kind": "'assertion'", "from": "src", "relation": "relation", "to": "dst"}
    )


def evidence_witness() -> str:
    """The evidence of a row of resolved selectors."""
    fields = ["source", "state", "exact", "start_line", "end_line"]
    return _struct(_WITNESS_FIELDS, {"kind": "'evidence'", **{f: f for f in fields}})


def when(condition: str, then: str, otherwise: str | None = None) -> str:
    return f"CASE WHEN {condition} THEN {then}" + (f" ELSE {otherwise} END" if otherwise else " END")


@dataclass(frozen=True)
class Rule:
    """One rule: where it fires and what its verdict says. All but ``step`` is SQL text.

    ``path`` is the schema path of the leading witness, if the rule has one.
    """

    condition: str
    status: str
    code: str
    message: str
    path: str | None = None
    step: int = 0


def _chosen(values: list[str]) -> str:
    """The value of the rule numbered by the column ``rule``; equal values are stated once."""
    numbers: dict[str, list[str]] = {}
    for number, value in enumerate(values):
        numbers.setdefault(value, []).append(str(number))
    if len(numbers) == 1:
        return values[0]
    branches = [f"WHEN rule IN ({', '.join(n)}) THEN {value}" for value, n in numbers.items()]
    return f"CASE {' '.join(branches)} END"


def emit(
    df: DataFrame,
    rules: list[Rule],
    subject: str,
    witness: list[str],
    phase: int,
    keys: list[str],
    ord: str = "0",
    sub: str = "0",
) -> DataFrame:
    """Verdicts of ``rules`` on the rows of ``df``, in one pass.

    ``witness`` lists the witnesses that all verdicts share; a rule's schema path comes before
    them. ``phase``, ``keys``, ``ord``, the rule's step and ``sub`` place a verdict in the report.
    """
    if len(rules) == 1 and rules[0].condition == "true":
        fired = df.selectExpr("*", "0 AS rule")
    else:
        numbers = ", ".join(when(r.condition, str(i)) for i, r in enumerate(rules))
        fired = df.selectExpr("*", f"explode(array({numbers})) AS rule").filter("rule IS NOT NULL")
    placed = {
        "phase": str(phase), "ord": ord, "step": _chosen([str(r.step) for r in rules]), "sub": sub,
        **{f"k{i + 1}": key for i, key in enumerate(keys)},
    }
    chosen = fired.selectExpr(
        f"{_chosen([r.status for r in rules])} AS status",
        f"{_chosen([r.code for r in rules])} AS code",
        f"{subject} AS subject",
        f"{_chosen([r.message for r in rules])} AS message",
        f"CAST({_chosen([r.path or 'NULL' for r in rules])} AS STRING) AS schema_path",
        f"array({', '.join(witness)}) AS shared" if witness else "NULL AS shared",
        f"{_struct(_KEY_FIELDS, placed)} AS sort_key",
    )
    contract = f"array({schema_witness('schema_path')})"
    if all(r.path is None for r in rules):
        whole = "shared"
    elif not witness:
        whole = contract
    else:
        whole = when("schema_path IS NULL", "shared", f"concat({contract}, shared)")
    return chosen.selectExpr(
        "status", "code", "subject", "message", f"{whole} AS witness", "sort_key"
    )


def ordered(verdicts: DataFrame) -> DataFrame:
    """The report in its canonical order (a range-partitioned sort; only for output)."""
    return verdicts.orderBy("sort_key", "code")
