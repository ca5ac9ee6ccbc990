"""Shortest paths for many pairs at once.

The path to return is the least one, by node ids from the start, among all shortest paths, and
on each hop the connection with the least ``(relation, declaration)``. No path is carried along the search:

1. Levels grow from the starts and, against the arcs, from the goals; each round takes the side with the smaller
   frontier. 64 starts (or goals) share a row, see :mod:`graphproof.operators.frontier`. A pair is found in the first round
   in which its start's last level and its goal's last level share a node, and its length is the sum of both levels. A start or
   goal without open pairs leaves the search, and a pair is given up as soon as one of its ends can't go on: a goal that
   few nodes lead to, or a start that leads to few, ends the flood of the other side.
2. From the meeting nodes back along the forward levels, the nodes that lie on a shortest path get their least next hop. It depends
   on node and goal only, so starts share it.
3. From the starts, follow those hops to the meeting nodes, then the least next hops along the levels of the goals.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.fixed_values import UNKNOWN_ENTITY
from graphproof.model import GraphSchema, fill
from graphproof.operators.adjacency import directed
from graphproof.operators.frontier import FEW_ROWS, Search, dealt_into_groups, places
from graphproof.session import Scratch
from graphproof.skew import lookup_join, nothing_hot, two_sided_join, within

HOP = "goal string, node string, next string, relation string, declaration string"
STEP = (
    "start string, goal string, hop int, src string, relation string, dst string, "
    "declaration string"
)


def check_pairs(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs ``(request_id, from, to)`` with ``error`` set where an end is unknown."""
    known = entities.select("id").distinct()
    with_start = lookup_join(
        pairs, known.select(F.col("id").alias("from"), F.lit(True).alias("has_from")), ["from"],
        spread=["request_id"],
    )
    with_both = lookup_join(
        with_start, known.select(F.col("id").alias("to"), F.lit(True).alias("has_to")), ["to"],
        spread=["request_id"], load=pairs.select("to"),
    )
    error = F.when(F.col("has_from").isNull(), fill(UNKNOWN_ENTITY, "from")).when(
        F.col("has_to").isNull(), fill(UNKNOWN_ENTITY, "to")
    )
    return with_both.select("request_id", "from", "to", error.alias("error"))


def _masks(pairs: DataFrame, side: str) -> DataFrame:
    """``(grp, mask)``: which places of the groups of one side are in ``pairs``."""
    return pairs.groupBy(F.col(f"{side}_grp").alias("grp")).agg(F.expr(f"bit_or(shiftleft(1L, {side}_place))").alias("mask"))


def _holds(bits: str, place: str):
    return F.expr(f"({bits} & shiftleft(1L, {place})) <> 0")


def _meeting(waiting: DataFrame, forward: DataFrame, backward: DataFrame, hot: DataFrame | None, keep) -> DataFrame:
    """``(start_grp, goal_grp, node, start_bits, goal_bits)``: nodes that both sides have just reached, for groups with open pairs.

    Groups are paired first: rows are bounded by the pairs of groups that have open pairs, also at nodes that all groups reach.
    Without ``hot``, these rows go through ``keep``, which writes them: they are counted for crowded keys and then joined.
    """
    groups = waiting.groupBy("start_grp", "goal_grp").agg(
        F.expr("bit_or(shiftleft(1L, start_place))").alias("starts"), F.expr("bit_or(shiftleft(1L, goal_place))").alias("goals"),
    )
    near = two_sided_join(
        forward.select(F.col("grp").alias("start_grp"), "node", "bits"), groups, ["start_grp"], ["node"], ["goal_grp"], hot, hot,
    ).select("start_grp", "goal_grp", "node", F.expr("bits & starts AS start_bits"), "goals").filter("start_bits <> 0")
    far = backward.select(F.col("grp").alias("goal_grp"), "node", "bits")
    near = near if hot is not None else keep(near)
    both = lookup_join(near, far, ["goal_grp", "node"], spread=["start_grp"], how="inner", hot=hot)
    return both.select("start_grp", "goal_grp", "node", "start_bits", F.expr("bits & goals AS goal_bits")).filter("goal_bits <> 0")


PAIR = "start string, goal string, start_grp long, start_place int, goal_grp long, goal_place int"
FOUND = PAIR + ", ahead int, back int"
MEETING = "start_grp long, goal_grp long, node string, start_bits long, goal_bits long"


class _TwoEnds:
    """The search of step 1. ``found``: the pairs with the levels ``ahead`` and ``back`` at which their ends meet."""

    def __init__(self, arcs: DataFrame, goals: DataFrame, scratch: Scratch):
        self.scratch = scratch
        steps = scratch.write(arcs.select("node", "next").distinct(), "steps")
        against = scratch.write(steps.select(F.col("next").alias("node"), F.col("node").alias("next")), "against")
        sides = {}
        for side, ways in (("start", steps), ("goal", against)):
            ends = dealt_into_groups(goals.select(F.col(side).alias("start")).distinct(), ways)
            sides[side] = scratch.write(ends, f"{side}-ends")
        waiting = goals
        for side, ends in sides.items():
            named = ends.withColumnsRenamed({"start": side, "grp": f"{side}_grp", "place": f"{side}_place"})
            waiting = waiting.join(named, side)
        self.waiting = scratch.write(waiting.select(*(c.split()[0] for c in PAIR.split(", "))), "waiting-0")
        self.forward = Search(scratch, "ahead", steps, sides["start"])
        self.backward = Search(scratch, "back", against, sides["goal"])
        self.rounds: list[tuple[int, int]] = []  # the levels of both sides after each round

    def run(self) -> DataFrame:
        """The found pairs; at least one pair has to be asked for."""
        self.open_pairs = self.waiting.count()
        while self.open_pairs:
            ahead = self.forward.rows <= self.backward.rows
            search = self.forward if ahead else self.backward
            search.step()
            before = self.open_pairs
            self.rounds.append((self.forward.level, self.backward.level))
            self._take_met()
            self._give_up("start" if ahead else "goal", search)
            if 0 < self.open_pairs < before:
                self.forward.narrow(_masks(self.waiting, "start"))
                self.backward.narrow(_masks(self.waiting, "goal"))
        return self.scratch.read_levels("found", 1, len(self.rounds), FOUND)

    def meetings(self, ahead: int) -> DataFrame | None:
        """``(pair, node)`` of the pairs that have met at this level of their starts, None if no round did."""
        met = None
        for i, (level, _) in enumerate(self.rounds, 1):
            if level == ahead:
                pairs = self._met(self.scratch.read(f"found-{i}", FOUND), self.scratch.read(f"meeting-{i}", MEETING), "node")
                met = pairs if met is None else met.unionByName(pairs)
        return met

    @staticmethod
    def _met(pairs: DataFrame, meeting: DataFrame, *keep: str) -> DataFrame:
        """Pairs with bits in ``meeting``: one row per start first, so that no group of pairs crowds."""
        starts = places(meeting.withColumnsRenamed({"start_grp": "grp", "start_bits": "bits"}), "goal_grp", "goal_bits", *keep)
        keys = ["start_grp", "start_place", "goal_grp"]
        starts = starts.withColumnsRenamed({"grp": "start_grp", "place": "start_place"}).groupBy(*keys, *keep).agg(F.bit_or("goal_bits").alias("goal_bits"))
        return pairs.join(starts, keys).filter(_holds("goal_bits", "goal_place")).select(*pairs.columns, *keep)

    def _take_met(self) -> None:
        few = max(self.forward.rows, self.backward.rows, self.open_pairs) <= FEW_ROWS
        hot = nothing_hot(self.scratch.spark) if few else None
        number = len(self.rounds)
        meeting = _meeting(
            self.waiting, self.forward.frontier, self.backward.frontier, hot, lambda rows: self.scratch.write(rows, f"side-{number}")
        )
        meeting = self.scratch.write(meeting, f"meeting-{number}")
        pairs = self._met(self.waiting, meeting)
        levels = F.lit(self.forward.level).alias("ahead"), F.lit(self.backward.level).alias("back")
        found = self.scratch.write(pairs.select("*", *levels), f"found-{number}")
        self._keep(self.waiting.join(found.select("start", "goal"), ["start", "goal"], "left_anti"), found.count(), "met")

    def _give_up(self, side: str, search: Search) -> None:
        """An end whose frontier is empty has seen all that it can reach."""
        alive = search.frontier.groupBy(F.col("grp").alias(f"{side}_grp")).agg(F.bit_or("bits").alias("alive"))
        hot = nothing_hot(self.scratch.spark) if self.open_pairs <= FEW_ROWS else None
        left = lookup_join(self.waiting, alive, [f"{side}_grp"], spread=["start", "goal"], hot=hot)
        lost = F.col("alive").isNull() | ~_holds("alive", f"{side}_place")
        gone = left.filter(lost).count()
        self._keep(left.filter(~lost).select(*self.waiting.columns), gone, "alive")

    def _keep(self, left: DataFrame, gone: int, name: str) -> None:
        """Go on with fewer pairs."""
        if gone:
            self.open_pairs -= gone
            self.waiting = self.scratch.write(left, f"waiting-{len(self.rounds)}-{name}")


def _between(arcs: DataFrame, nodes: DataFrame, nexts: DataFrame) -> DataFrame:
    """Arcs that may lead from a node of ``nodes`` to one of ``nexts``, told apart before any shuffle."""
    return within(within(arcs, ["next"], nexts.select(F.col("node").alias("next"))), ["node"], nodes)


def _forward_hops(arcs: DataFrame, ends: _TwoEnds, scratch: Scratch) -> DataFrame:
    """``(goal, node, next, relation, declaration)``: the least hops before the meeting nodes."""
    depth = ends.forward.level
    hot = ends.forward.hot
    arriving = None  # (goal, goal_grp, goal_place, grp, node, bits): starts whose shortest path to the goal passes the node
    goal = ["goal", "goal_grp", "goal_place"]
    for level in range(depth, 0, -1):
        met = ends.meetings(level)
        starting = arriving
        if met is not None:
            met = met.groupBy(*goal, F.col("start_grp").alias("grp"), "node").agg(F.expr("bit_or(shiftleft(1L, start_place))").alias("bits"))
            starting = met if arriving is None else met.unionByName(arriving).groupBy(*goal, "grp", "node").agg(F.bit_or("bits").alias("bits"))
            starting = scratch.write(starting, f"starting-{level}")
        before = ends.forward.levels(level - 1, level - 1).select("grp", "node", "bits")
        # most arcs lie on no shortest path; those left are written, since their crowded keys are counted before they are joined
        into = two_sided_join(_between(arcs, before, starting), before, ["node"], ["next", "declaration"], ["grp"], hot_left=hot)
        into = scratch.write(into, f"leading-{level}")
        into = two_sided_join(
            into, starting.select(*goal, "grp", F.col("node").alias("next"), F.col("bits").alias("wanted")), ["grp", "next"],
            ["node", "declaration"], ["goal"],
        ).withColumn("bits", F.col("bits").bitwiseAND(F.col("wanted"))).filter("bits <> 0")
        into = scratch.write(
            into.groupBy(*goal, "grp", "node").agg(F.bit_or("bits").alias("bits"), F.min(F.struct("next", "relation", "declaration")).alias("hop")),
            f"into-{level}",
        )
        # every start of a node has the same hops to a goal open
        scratch.write(into.groupBy("goal", "node").agg(F.min("hop").alias("hop")).select("goal", "node", "hop.*"), f"hops-{level}")
        arriving = into.drop("hop")
    return scratch.read_levels("hops", 1, depth, HOP).distinct()


def _walk(arcs: DataFrame, ends: _TwoEnds, found: DataFrame, scratch: Scratch) -> DataFrame:
    """All hops of the found pairs, ``STEP`` rows."""
    columns = [c.split()[0] for c in STEP.split(", ")]
    if ends.forward.level:
        hops = scratch.write(_forward_hops(arcs, ends, scratch), "hops")
    at = found.select("start", "goal", "goal_grp", "goal_place", F.col("start").alias("node"), "ahead", "back")
    written = 0

    def taken(going: DataFrame, hop) -> DataFrame:
        """Write the hops; the pairs at their next nodes."""
        nonlocal written
        rows = scratch.write(going.withColumn("hop", hop), f"path-{written}")
        written += 1
        return rows.select("start", "goal", "goal_grp", "goal_place", F.col("next").alias("node"), "ahead", "back")

    arrived = [at.filter("ahead = 0")]
    at = at.filter("ahead > 0")
    for hop in range(ends.forward.level):
        at = taken(lookup_join(at, hops, ["goal", "node"], spread=["start"], how="inner"), F.lit(hop))
        arrived.append(at.filter(F.col("ahead") == hop + 1))
        at = at.filter(F.col("ahead") > hop + 1)
    waiting = functools.reduce(DataFrame.unionByName, arrived)
    at = None
    for rest in range(ends.backward.level, 0, -1):  # hops left
        here = waiting.filter(F.col("back") == rest)
        here = here if at is None else here.unionByName(at)
        near = ends.backward.levels(rest - 1, rest - 1).select(F.col("grp").alias("goal_grp"), F.col("node").alias("next"), "bits")
        at = scratch.write(here.select("goal", "goal_grp", "goal_place", "node").distinct(), f"here-{rest}")
        out = two_sided_join(
            _between(arcs, at, near.withColumnRenamed("next", "node")), at, ["node"], ["next", "declaration"], ["goal"],
            hot_left=ends.forward.hot,
        )
        out = scratch.write(out, f"out-{rest}")
        leading = lookup_join(out, near, ["goal_grp", "next"], spread=["node", "declaration"], how="inner").filter(_holds("bits", "goal_place"))
        best = leading.groupBy("goal", "node").agg(F.min(F.struct("next", "relation", "declaration")).alias("h")).select("goal", "node", "h.*")
        at = taken(lookup_join(here, best, ["goal", "node"], spread=["start"], how="inner"), F.col("ahead") + F.col("back") - rest)
    rows = scratch.read_levels("path", 0, written - 1, f"{HOP}, start string, hop int")
    return rows.withColumnsRenamed({"node": "src", "next": "dst"}).select(*columns)


class _Request:
    """Checked requests and what the search finds; steps are made only if asked for."""

    def __init__(self, schema: GraphSchema, entities: DataFrame, edges: DataFrame, pairs: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.checked = scratch.write(check_pairs(entities, pairs), "requests").withColumnsRenamed({"from": "start", "to": "goal"})
        self.sound = self.checked.filter(F.col("error").isNull())
        goals = scratch.write(self.sound.filter("start <> goal").select("start", "goal").distinct(), "goals")
        self.arcs = scratch.write(directed(schema, edges), "arcs")
        self.ends = _TwoEnds(self.arcs, goals, scratch)
        self.found = self.ends.run() if not goals.isEmpty() else None

    def results(self) -> DataFrame:
        spark = self.scratch.spark
        found = spark.createDataFrame([], FOUND) if self.found is None else self.found
        lengths = found.select("start", "goal", (F.col("ahead") + F.col("back")).alias("level"))
        sound = F.col("error").isNull()
        same = F.col("start") == F.col("goal")
        return self.checked.join(lengths, ["start", "goal"], "left").select(
            "request_id", F.col("start").alias("from"), F.col("goal").alias("to"),
            F.when(sound, same | F.col("level").isNotNull()).alias("found"),
            F.when(sound & same, F.lit(0)).otherwise(F.col("level")).alias("hops"),
            "error",
        )

    def steps(self) -> DataFrame:
        if self.found is None:
            taken = self.scratch.spark.createDataFrame([], STEP)
        else:
            taken = _walk(self.arcs, self.ends, self.found, self.scratch)
        return self.sound.join(taken, ["start", "goal"]).select(
            "request_id", "hop", "src", "relation", "dst", "declaration"
        )


def shortest_lengths(
    schema: GraphSchema, entities: DataFrame, edges: DataFrame, pairs: DataFrame, scratch: Scratch | None = None
) -> DataFrame:
    """The ``results`` of :func:`shortest_paths` alone: no hops are looked for."""
    scratch = scratch or Scratch(edges.sparkSession, "paths")
    return _Request(schema, entities, edges, pairs, scratch).results()


def shortest_paths(
    schema: GraphSchema,
    entities: DataFrame,
    edges: DataFrame,
    pairs: DataFrame,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(results, steps)`` for requests ``(request_id, from, to)``.

    ``results`` has one row per request: ``request_id, from, to, found, hops, error``; ``steps``
    one row per hop: ``request_id, hop, src, relation, dst, declaration``. A node reaches itself
    with no hop. Equal pairs are searched once.
    """
    scratch = scratch or Scratch(edges.sparkSession, "paths")
    request = _Request(schema, entities, edges, pairs, scratch)
    return request.results(), request.steps()
