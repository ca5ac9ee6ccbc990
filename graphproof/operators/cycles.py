"""Cycle check of acyclic relations.

A node can run into a cycle exactly when it has outgoing walks of every length. Nodes without a way on are peeled off
and chains of nodes with a single way on are contracted by pointer doubling, until nothing more goes; the nodes
left, and those contracted into them, are the ones that reach a cycle. Inside this residue every node has a successor, so
following the least successor from the least node must close a loop, which is the witness.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.fixed_values import (
    MESSAGES,
    PATH_RELATION_ACYCLIC,
    STATUS_SATISFIED,
    STATUS_VIOLATED,
    SUBJECT_RELATION,
)
from graphproof.model import GraphSchema
from graphproof.session import Scratch
from graphproof.skew import lookup_join, schema_join
from graphproof.verdicts import Rule, emit, fill, text, when

PHASE = 7


def relation_edges(schema: GraphSchema, valid_edges: DataFrame) -> DataFrame:
    """Distinct ``(relation, src, dst)`` of the relations declared acyclic."""
    acyclic = schema.relations.filter("acyclic").select("relation")
    arcs = valid_edges.select("relation", "src", "dst")
    return schema_join(arcs, acyclic, ["relation"], spread=["src", "dst"], how="left_semi").distinct()


def residue(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between nodes from which a cycle can be reached, for all relations at once.

    Each round drops the arcs into nodes without a way on, then contracts the nodes with a single way on: such a node shares
    the fate of the first node with several ways, or none, that its chain leads to. A relation from which a round drops nothing is
    settled: there every node has a successor that is left, so all of them reach a cycle. Rounds carry only the arcs of
    relations that still change, and the nodes that several ways leave.
    """
    whole = scratch.write(edges, "arcs")
    arcs, counts = whole, scratch.write(_per_relation(whole), "counts-0")
    settled, chains, round_ = [], [], 0
    while not counts.isEmpty():
        round_ += 1
        going_on = arcs.select("relation", F.col("src").alias("dst")).distinct()
        left = lookup_join(arcs, going_on, ["relation", "dst"], spread=["src"], how="left_semi")
        left = scratch.write(left, f"left-{round_}")
        now = _per_relation(left)
        changed = scratch.write(now.join(counts, ["relation", "n"], "left_anti"), f"changed-{round_}")
        settled.append(left.join(changed, "relation", "left_anti").select("relation", F.col("src").alias("node")))
        arcs, chain = _contracted(left.join(changed, "relation", "left_semi"), scratch, round_)
        chains.append(chain)
        counts = scratch.write(_per_relation(arcs), f"counts-{round_}")
    if not settled:
        return whole
    alive = scratch.write(functools.reduce(DataFrame.unionByName, settled).distinct(), "alive")
    for i, chain in reversed(list(enumerate(chains))):  # nodes that were contracted, the last round's first
        if chain is not None:
            ends = alive.withColumnRenamed("node", "next")
            saved = lookup_join(chain, ends, ["relation", "next"], spread=["node"], how="left_semi")
            alive = scratch.write(alive.unionByName(saved.select("relation", "node")), f"alive-{i}")
    ends = alive.withColumnRenamed("node", "dst")
    return lookup_join(whole, ends, ["relation", "dst"], spread=["src"], how="left_semi").select("relation", "src", "dst")


def _contracted(arcs: DataFrame, scratch: Scratch, round_: int) -> tuple[DataFrame, DataFrame | None]:
    """``arcs`` without the nodes that have a single way on, and where these lead: ``(relation, node, next)``.

    Chains are followed by pointer doubling. A step that resolves no further node shows that the open ones run into
    a cycle of such nodes (a chain has nodes at every distance from its end); they stay as they are.
    """
    ways = arcs.groupBy("relation", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("next"))
    single = scratch.write(ways.filter("n = 1").select("relation", "node", "next", F.lit(True).alias("open")), f"single-{round_}")
    if single.isEmpty():
        return scratch.write(arcs, f"arcs-{round_}"), None
    jump, before, doubled = single, None, 0
    while True:
        further = jump.select("relation", F.col("node").alias("next"), F.col("next").alias("after"))
        jump = lookup_join(jump.drop("open"), further, ["relation", "next"], spread=["node"]).select(
            "relation", "node", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("open")
        )
        jump = scratch.write(jump, f"jump-{round_}-{doubled}")
        open_ = jump.filter("open").count()
        if open_ in (0, before):
            break
        before, doubled = open_, doubled + 1
    chain = jump.filter("NOT open").drop("open")
    rest = arcs.join(chain.select("relation", F.col("node").alias("src")), ["relation", "src"], "left_anti")
    ends = chain.select("relation", F.col("node").alias("dst"), F.col("next").alias("end"))
    moved = lookup_join(rest, ends, ["relation", "dst"], spread=["src"]).select("relation", "src", F.coalesce("end", "dst").alias("dst"))
    return scratch.write(moved.distinct(), f"arcs-{round_}"), chain


def _per_relation(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def cyclic_relations(residual: DataFrame) -> DataFrame:
    return residual.select("relation").distinct()


def cycle_nodes(residual: DataFrame, scratch: Scratch) -> DataFrame:
    """The witness loop of each cyclic relation as rows ``(relation, position, node)``.

    Positions start at 0 and the last row repeats the first node. The walk doubles its length per round:
    the jump table then covers twice the distance, so a loop of n nodes takes about log2(n)
    rounds.
    """
    jump = scratch.write(
        residual.groupBy("relation", F.col("src").alias("node")).agg(F.min("dst").alias("next")),
        "jump-0",
    )
    walk = scratch.write(
        jump.groupBy("relation")
        .agg(F.min("node").alias("node"))
        .withColumn("position", F.lit(0).cast("bigint")),
        "walk-0",
    )
    round_ = 0
    while True:
        tally = walk.groupBy("relation", "node").agg(F.count(F.lit(1)).alias("visits"))
        open_relations = (
            tally.groupBy("relation")
            .agg(F.max("visits").alias("most"))
            .filter(F.col("most") == 1)
            .select("relation")
        )
        step = 2**round_
        if open_relations.isEmpty():
            break
        onward = (
            walk.join(open_relations, "relation", "left_semi")
            .join(jump, ["relation", "node"])
            .select("relation", F.col("next").alias("node"), F.col("position") + step)
            .toDF("relation", "node", "position")
        )
        walk = scratch.write(walk.unionByName(onward), f"walk-{round_ + 1}")
        twice = (
            jump.join(open_relations, "relation", "left_semi")
            .join(
                jump.select(
                    "relation", F.col("node").alias("next"), F.col("next").alias("after")
                ),
                ["relation", "next"],
            )
            .select("relation", "node", F.col("after").alias("next"))
        )
        jump = scratch.write(twice, f"jump-{round_ + 1}")
        round_ += 1

    # The loop is closed at the first position whose node was seen before.
    seen = walk.groupBy("relation", "node").agg(F.min("position").alias("opens"))
    span = (
        walk.join(seen, ["relation", "node"])
        .filter(F.col("position") > F.col("opens"))
        .groupBy("relation")
        .agg(F.min(F.struct(F.col("position").alias("closes"), "opens")).alias("span"))
    )
    return (
        walk.join(span, "relation")
        .filter(F.col("position").between(F.col("span.opens"), F.col("span.closes")))
        .select(
            "relation", (F.col("position") - F.col("span.opens")).alias("position"), "node"
        )
    )


def find_cycles(schema: GraphSchema, valid_edges: DataFrame, scratch: Scratch):
    """``(verdicts, nodes)``: one verdict per acyclic relation and the witness loops in long form."""
    residual = residue(relation_edges(schema, valid_edges), scratch)
    return cycle_verdicts(schema, residual), cycle_nodes(residual, scratch)


def cycle_verdicts(schema: GraphSchema, residual: DataFrame) -> DataFrame:
    checked = (
        schema.relations.filter("acyclic")
        .select("relation")
        .join(cyclic_relations(residual).withColumn("cyclic", F.lit(True)), "relation", "left")
    )
    rule = Rule(
        "true",
        when("cyclic", text(STATUS_VIOLATED), text(STATUS_SATISFIED)),
        when("cyclic", "'relation.cycle'", "'relation.acyclic'"),
        when(
            "cyclic", fill(MESSAGES["relation.cycle"], "relation"), text(MESSAGES["relation.acyclic"])
        ),
        fill(PATH_RELATION_ACYCLIC, "relation"),
    )
    return emit(checked, [rule], fill(SUBJECT_RELATION, "relation"), [], PHASE, ["relation"])
