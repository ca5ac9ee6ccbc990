"""Report totals and the gate before graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.fixed_values import (
    GATE_ERROR,
    STATUS_SATISFIED,
    STATUS_UNKNOWN,
    STATUS_VIOLATED,
)


class GraphInvalid(ValueError):
    """The graph has violations, so it cannot be queried."""


def summarize(verdicts: DataFrame) -> DataFrame:
    """One row: counts per status, ``can_query`` and ``is_complete``."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    totals = verdicts.agg(count(STATUS_SATISFIED), count(STATUS_VIOLATED), count(STATUS_UNKNOWN))
    no_violation = F.col(STATUS_VIOLATED) == 0
    return totals.select(
        STATUS_SATISFIED, STATUS_VIOLATED, STATUS_UNKNOWN,
        no_violation.alias("can_query"),
        (no_violation & (F.col(STATUS_UNKNOWN) == 0)).alias("is_complete"),
    )


def open_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts that are not satisfied."""
    return verdicts.filter(F.col("status") != STATUS_SATISFIED)


def require_valid(verdicts: DataFrame) -> None:
    """Raise unless the report has no violation."""
    row = summarize(verdicts).first()
    if not row["can_query"]:
        raise GraphInvalid(GATE_ERROR.format(row[STATUS_VIOLATED]))
