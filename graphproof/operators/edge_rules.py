"""Rules over assertions (edges)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.fixed_values import (
    MESSAGES,
    PATH_RELATION,
    PATH_RELATION_FROM,
    PATH_RELATION_TO,
    STATE_INVALID,
    STATE_RELOCATED,
    STATE_VALID,
    STATUS_SATISFIED,
    STATUS_UNKNOWN,
    STATUS_VIOLATED,
    SUBJECT_ASSERTION,
)
from graphproof.functions.text import accepts
from graphproof.model import EDGE_KEY, GraphSchema
from graphproof.operators.compile import selectors_of
from graphproof.operators.entity_rules import last_kinds
from graphproof.operators.evidence import resolve_evidence
from graphproof.session import Scratch, free_shuffles
from graphproof.skew import lookup_join, schema_join, within, without
from graphproof.verdicts import (
    Rule,
    assertion_witness,
    declaration_witness,
    emit,
    evidence_witness,
    fill,
    text,
    when,
)

PHASE = 5
SEMANTIC_KEY = ["relation", "end_a", "end_b"]
SUBJECT = fill(SUBJECT_ASSERTION, "src", "relation", "dst")
SATISFIED, VIOLATED, UNKNOWN = map(text, (STATUS_SATISFIED, STATUS_VIOLATED, STATUS_UNKNOWN))


def linked_edges(schema: GraphSchema, entities: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Edges with the kinds of both ends, the lookup ``fault`` and whether the relation takes
    these kinds (``from_ok``, ``to_ok``).

    ``swapped`` says that the ends count the other way round for duplicates: a symmetric relation has them in order, see
    :func:`_semantic`. With ``scratch``, edges are written between the lookups of their ends, so that the shuffle
    files of the first are gone before the second.
    """
    keep = scratch.write if scratch is not None else lambda df, name: df
    kinds = keep(last_kinds(entities), "kinds")
    contract = schema.relations.select(
        "relation", "from", "to", "symmetric", F.lit(True).alias("declared")
    )
    linked = lookup_join(
        edges, kinds.toDF("src", "src_kind"), ["src"],
        spread=["declaration", "decl_ordinal"], load=edges.select("src"),
    )
    ends = edges
    if scratch is not None:
        ends = linked = scratch.write(linked, "linked_sources")
        free_shuffles(scratch.spark)
    linked = lookup_join(
        linked, kinds.toDF("dst", "dst_kind"), ["dst"],
        spread=["declaration", "decl_ordinal"], load=ends.select("dst"),
    )
    fault = (
        F.when(F.col("src_kind").isNull(), F.lit("edge.missing_source"))
        .when(F.col("dst_kind").isNull(), F.lit("edge.missing_target"))
        .when(F.col("declared").isNull(), F.lit("edge.unknown_relation"))
    )
    swap = F.col("symmetric") & (F.col("src") > F.col("dst"))
    return schema_join(linked, contract, ["relation"], spread=["declaration", "decl_ordinal"]).select(
        *edges.columns, "src_kind", "dst_kind",
        fault.alias("fault"),
        F.coalesce(swap, F.lit(False)).alias("swapped"),
        accepts(F.col("from"), F.col("src_kind")).alias("from_ok"),
        accepts(F.col("to"), F.col("dst_kind")).alias("to_ok"),
    )


def _semantic(linked: DataFrame) -> DataFrame:
    """Linked edges with the ends of the assertion as it counts for duplicates."""
    return linked.withColumns({
        "end_a": F.when(F.col("swapped"), F.col("dst")).otherwise(F.col("src")),
        "end_b": F.when(F.col("swapped"), F.col("src")).otherwise(F.col("dst")),
    }).drop("swapped")


def mark_duplicates(linked: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Add ``repeated``: a linked edge whose assertion was declared before, in edge order.

    A count per assertion finds the repeated ones; copies collapse before its shuffle. Only edges
    of repeated assertions are compared for the leading one and look their assertion up in the leaders; most of
    the others are told apart before any shuffle. With ``scratch``, both small tables are written, so that their real size
    decides how they are joined.
    """
    keep = scratch.write if scratch is not None else lambda df, name: df
    identity = ["src", "dst", "declaration", "decl_ordinal"]
    linked = _semantic(linked)
    sound = linked.filter(F.col("fault").isNull())
    copies = keep(
        sound.groupBy(*SEMANTIC_KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"),
        "repeated_assertions",
    )
    spread = ["declaration", "decl_ordinal"]
    leaders = keep(
        lookup_join(
            within(sound.select(*SEMANTIC_KEY, *identity), SEMANTIC_KEY, copies), copies.select(*SEMANTIC_KEY), SEMANTIC_KEY,
            spread=spread, how="inner", load=copies, weight="copies",
        )
        .groupBy(*SEMANTIC_KEY)
        .agg(F.min(F.struct(*identity)).alias("leader")),
        "leading_assertions",
    )
    marked = lookup_join(within(linked, SEMANTIC_KEY, leaders), leaders, SEMANTIC_KEY, spread=spread, load=copies, weight="copies")
    alone = without(linked, SEMANTIC_KEY, leaders).withColumn("leader", F.lit(None).cast(leaders.schema["leader"].dataType))
    marked = marked.unionByName(alone)
    follows = (
        F.col("fault").isNull() & F.col("leader").isNotNull() & (F.struct(*identity) != F.col("leader"))
    )
    return marked.withColumn("repeated", F.coalesce(follows, F.lit(False))).drop(
        "leader", "end_a", "end_b"
    )


def judge_edges(
    schema: GraphSchema, entities: DataFrame, edges: DataFrame, scratch: Scratch | None = None
) -> DataFrame:
    """Edges with everything the edge rules decide: ``fault``, ``repeated``, ``domain_ok``,
    ``range_ok`` and ``valid`` (the edges that count for cardinality and cycles).

    Linked edges are read several times to find and mark repeats. With ``scratch`` they are
    written in between, so the lookups of both ends run once.
    """
    linked = linked_edges(schema, entities, edges, scratch)
    if scratch is not None:
        linked = scratch.write(linked, "linked_edges")
        scratch.drop("linked_sources")
    checked = "fault IS NULL AND NOT repeated"
    return mark_duplicates(linked, scratch).select(
        *edges.columns, "src_kind", "dst_kind", "fault", "repeated",
        F.expr(f"{checked} AS checked"),
        F.expr(f"{checked} AND from_ok AS domain_ok"),
        F.expr(f"{checked} AND to_ok AS range_ok"),
        F.expr(f"{checked} AND from_ok AND to_ok AS valid"),
    )


def edge_verdicts(judged: DataFrame) -> DataFrame:
    """Lookup, duplicate, domain, range, structure and missing-evidence verdicts."""
    lookup_message = (
        f"CASE fault WHEN 'edge.missing_source' THEN {fill(MESSAGES['edge.missing_source'], 'src')}"
        f" WHEN 'edge.missing_target' THEN {fill(MESSAGES['edge.missing_target'], 'dst')}"
        f" ELSE {fill(MESSAGES['edge.unknown_relation'], 'relation')} END"
    )
    rules = [
        Rule("fault IS NOT NULL", VIOLATED, "fault", lookup_message),
        Rule(
            "repeated", VIOLATED, "'edge.duplicate_assertion'",
            text(MESSAGES["edge.duplicate_assertion"]),
        ),
        Rule(
            "checked AND NOT domain_ok", VIOLATED, "'edge.domain_mismatch'",
            fill(MESSAGES["edge.domain_mismatch"], "relation", "src_kind"),
            fill(PATH_RELATION_FROM, "relation"), 1,
        ),
        Rule(
            "checked AND NOT range_ok", VIOLATED, "'edge.range_mismatch'",
            fill(MESSAGES["edge.range_mismatch"], "relation", "dst_kind"),
            fill(PATH_RELATION_TO, "relation"), 2,
        ),
        Rule(
            "valid", SATISFIED, "'edge.structure'", text(MESSAGES["edge.structure"]),
            fill(PATH_RELATION, "relation"), 2,
        ),
        Rule(
            "checked AND coalesce(size(evidence), 0) <= 0", UNKNOWN, "'edge.evidence'",
            text(MESSAGES["edge.evidence"]), step=3,
        ),
    ]
    shared = [declaration_witness("declaration"), assertion_witness()]
    return emit(judged, rules, SUBJECT, shared, PHASE, EDGE_KEY[:4], ord="decl_ordinal")


def evidence_verdicts(judged: DataFrame, sources: DataFrame) -> DataFrame:
    """One verdict per selector of every edge that reached the evidence check."""
    selectors = selectors_of(judged.filter("checked").select(*EDGE_KEY, "evidence"))
    return evidence_verdict_rows(resolve_evidence(selectors, sources))


def evidence_verdict_rows(resolved: DataFrame) -> DataFrame:
    good = f"state IN ({text(STATE_VALID)}, {text(STATE_RELOCATED)})"
    bad = f"state = {text(STATE_INVALID)}"
    status = when(good, SATISFIED, when(bad, VIOLATED, UNKNOWN))
    code = (
        f"CASE state WHEN {text(STATE_VALID)} THEN 'evidence.resolved' WHEN {text(STATE_RELOCATED)}"
        f" THEN 'evidence.relocated' WHEN {text(STATE_INVALID)} THEN 'evidence.invalid'"
        " ELSE 'evidence.unresolved' END"
    )
    message = f"coalesce(message, {text(MESSAGES['evidence.resolved'])})"
    shared = [declaration_witness("declaration"), assertion_witness(), evidence_witness()]
    rule = Rule("true", status, code, message, step=3)
    return emit(
        resolved, [rule], SUBJECT, shared, PHASE, EDGE_KEY[:4], ord="decl_ordinal", sub="sel_ordinal"
    )
