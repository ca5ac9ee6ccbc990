"""Conversation structure repair: Viterbi with survivor coalescence.

Every conversation is read in order of (turn, role, text), nulls first, and edited at the least cost so that its
role initials read ``(s?(ua)+)?``: keep a row (0), give it the role user or assistant (2), delete it (3), insert a row
with an empty text (2). Blank and repeated rows must be deleted; an undeleted truncated row costs 1 more. Among edits of
equal cost the least in ASCII order of their initials (D, I, K, R) is taken.

* The four states are what has been emitted: nothing, a system row, a user row, an assistant row. A step is some
  insertions and then one edit of the row, so at each row boundary all survivors hold equally many row edits and end with one;
  no survivor's edits are a beginning of another's, and comparing them up to there decides for good.
* A state whose cost exceeds another's by more than whatever may follow can make up for is given up.
* Survivors are the leaves of a backpointer tree with reference counts. Losers are pruned at once. Equal costs are
  compared over the whole unresolved suffixes, from the nearest common ancestor on. As soon as nothing but
  one child refers to the root, all survivors share that child: its edit is final, is emitted, and the child becomes the root. So memory holds the
  rows since the survivors last met, not the conversation.
* Repeated rows are found by Spark, by first appearances of (conversation, role, text digest), so no task holds the
  texts that it has seen.

Conversations are spread by key and sorted within tasks; a task streams through them with constant memory, and a
conversation of any length is sorted by Spark, which spills. One conversation is one stream: the digest of its repaired text
is a SHA-256, which has no parallel form.

Defined cases: null role or text counts as one space; null conv_id is a conversation of its own, named by
one space; null turns come first; rows of equal turns are ordered by role and text; an empty table gives no rows. Only the
four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import SPACES, table
from graphproof.session import Scratch
from graphproof.skew import lookup_join

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: What has been emitted last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: The state after emitting a role, where the pattern allows it.
AFTER = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
ROLES = {"u": "user", "a": "assistant"}
WHITE = " " + SPACES

#: What it costs at most, by (state, other state), to do from the first whatever may follow the other: a user or assistant row
#: inserted, both, or a system row deleted.
CATCH_UP = {
    (NOTHING, SYSTEM): 0, (NOTHING, USER): 2, (NOTHING, ASSISTANT): 0,
    (SYSTEM, NOTHING): 4, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4,
    (USER, NOTHING): 5, (USER, SYSTEM): 2, (USER, ASSISTANT): 2,
    (ASSISTANT, NOTHING): 3, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2,
}


def _insertions() -> dict[int, list[tuple[str, int]]]:
    """Roles that may be inserted at one place, by state: (initials, state after). Three or more never pay."""
    found = {}
    for state in range(4):
        found[state], level = [("", state)], [("", state)]
        for _ in range(2):
            level = [(done + r, AFTER[r][s]) for done, s in level for r in ROLES if s in AFTER[r]]
            found[state] += level
    return found


INSERTIONS = _insertions()


class _Node:
    """One edit in the backpointer tree. ``row`` is None for insertions and for the root; ``refs`` counts the children and
    the survivors that stand here."""

    __slots__ = ("parent", "edit", "role", "row", "depth", "refs")

    def __init__(self, parent, edit, role, row):
        self.parent, self.edit, self.role, self.row, self.refs = parent, edit, role, row, 0
        self.depth = parent.depth + 1 if parent else 0


class Edit(NamedTuple):
    edit: str
    role: str | None  # of the repaired row, None if deleted
    row: object


def _less(a: _Node, b: _Node) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b``: unresolved suffixes from the common ancestor on."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return left[::-1] < right[::-1]


class Repair:
    """Repairs one conversation, row by row; ``emit`` gets the edits, in order, as soon as they are final."""

    def __init__(self, emit: Callable[[Edit], None]):
        self.emit = emit
        self.root = _Node(None, "", None, None)
        self.root.refs = 1
        self.alive: dict[int, tuple[int, _Node]] = {NOTHING: (0, self.root)}
        self.nodes = self.most_nodes = 0

    def _child(self, parent: _Node, edit: str, role: str | None, row: object) -> _Node:
        parent.refs += 1
        self.nodes += 1
        return _Node(parent, edit, role, row)

    def _insert(self, node: _Node, inserted: str) -> _Node:
        for r in inserted:
            node = self._child(node, INSERT, ROLES[r], None)
        return node

    def _release(self, node: _Node) -> None:
        """Drop what nothing leads on from."""
        while node.refs == 0 and node is not self.root:
            node = node.parent
            node.refs -= 1
            self.nodes -= 1

    def add(self, row: object, role: str, fault: str | None) -> None:
        """The next row; ``role`` is its own."""
        initial = role[:1]
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        ways: dict[int, list] = {}  # by state after: (cost, state before, inserted, edit, new role)
        for state, (cost, _) in self.alive.items():
            for inserted, middle in INSERTIONS[state]:
                price = cost + INSERT_COST * len(inserted)
                ways.setdefault(middle, []).append((price + DELETE_COST, state, inserted, DELETE, None))
                if fault in (BLANK, DUPLICATE):
                    continue
                end = AFTER.get(initial, {}).get(middle)
                if end is not None:
                    ways.setdefault(end, []).append((price + extra, state, inserted, KEEP, role))
                for r, name in ROLES.items():
                    if middle in AFTER[r]:
                        ways.setdefault(AFTER[r][middle], []).append((price + extra + REROLE_COST, state, inserted, REROLE, name))
        least = {end: min(way[0] for way in found) for end, found in ways.items()}
        after = {end: self._survivor(found, row) for end, found in ways.items() if not self._beaten(end, least)}
        for _, node in self.alive.values():
            node.refs -= 1
            self._release(node)
        self.alive = after
        self.most_nodes = max(self.most_nodes, self.nodes)
        self._coalesce()

    @staticmethod
    def _beaten(end: int, least: dict[int, int]) -> bool:
        """Another survivor stays cheaper, whatever follows. Without this, deleting all rows would survive for ever."""
        return any(least[other] + extra < least[end] for (other, of), extra in CATCH_UP.items() if of == end and other in least)

    def _survivor(self, ways: list, row: object) -> tuple[int, _Node]:
        """The cheapest of the ways into one state, by their edits where costs tie."""
        least, best = min(way[0] for way in ways), None
        for cost, state, inserted, edit, role in ways:
            if cost > least:
                continue
            node = self._child(self._insert(self.alive[state][1], inserted), edit, role, row)
            if best is not None and _less(best, node):
                best, node = node, best
            if best is not None:
                self._release(best)
            best = node
        best.refs += 1
        return least, best

    def _path(self, node: _Node) -> list[_Node]:
        """From below the root down to ``node``."""
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _final(self, node: _Node) -> None:
        self.emit(Edit(node.edit, node.role, node.row))
        node.parent, self.root = None, node
        self.nodes -= 1

    def _coalesce(self) -> None:
        """Emit the edits that all survivors share."""
        if self.root.refs == 1:
            for node in self._path(next(iter(self.alive.values()))[1]):
                if self.root.refs > 1:
                    break
                self._final(node)

    def finish(self) -> int:
        """Close the conversation: emits what is left and returns the cost."""
        ways = [
            (cost + INSERT_COST * len(inserted), node, inserted)
            for state, (cost, node) in self.alive.items() for inserted, end in INSERTIONS[state] if end in ENDS
        ]
        least = min(cost for cost, *_ in ways)
        best, *others = [self._insert(node, inserted) for cost, node, inserted in ways if cost == least]
        for node in others:
            best = node if _less(node, best) else best
        for node in self._path(best):
            self._final(node)
        return least


def _plain(conversations: DataFrame) -> DataFrame:
    """conv_id (as text), turn, role, text; only the turn may be null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(text("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def with_faults(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id (as text), turn, role, text, and ``earlier``: the same role and text stand at an earlier turn.

    Repeats at one turn are neighbours in the reading order and are seen there.
    """
    rows = _plain(conversations).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # nulls first: a struct of (has a turn, turn)
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    key = ["conv_id", "role", "digest"]
    seen = rows.groupBy(*key).agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last")
    seen = scratch.write(seen.select(*key, "first"), "seen")  # few rows: only texts that come back at a later turn
    joined = lookup_join(rows, seen, key, spread=["turn"])
    return joined.select("conv_id", "turn", "role", "text", F.coalesce(at > F.col("first"), F.lit(False)).alias("earlier"))


def fault_of(text: str, repeated: bool) -> str | None:
    """The first fault of a row."""
    end = text.rstrip(WHITE)
    return BLANK if not end else DUPLICATE if repeated else None if end[-1] in ".!?" else TRUNCATED


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, role, text, fault), from rows sorted by conversation, turn, role and text."""
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "earlier")]
        for conv, turn, role, text, earlier in zip(*columns, strict=True):
            row = (conv, turn, role, text)
            yield *row, fault_of(text, earlier or row == last)
            last = row


def _sorted(faults: DataFrame) -> DataFrame:
    return faults.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


#: Rows of one output batch, and characters, at most (but for a single longer text).
BATCH_ROWS, BATCH_CHARS = 10_000, 1 << 23
EDITS = "conv_id string, position long, edit string, turn long, role string, text string, old_role string, fault string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.string()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()),
         ("text", pa.string()), ("old_role", pa.string()), ("fault", pa.string())]
    )
    held: list[tuple] = []
    chars = position = 0
    conv, repair = None, None

    def emit(e: Edit) -> None:
        nonlocal position, chars
        position += 1
        turn, old, text, fault = e.row or (None, None, "", None)
        held.append((conv, position, e.edit, turn, e.role, text, old, fault))
        chars += len(text)

    for own, turn, role, text, fault in _rows(batches):
        if repair is None or own != conv:
            if repair:
                repair.finish()
            conv, repair, position = own, Repair(emit), 0
        repair.add((turn, role, text, fault), role, fault)
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema)
            held, chars = [], 0
    if repair:
        repair.finish()
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema)


def repair_edits(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """All edits, deletions too: conv_id (as text), position (from 1), edit (K, R, D, I), turn, role (repaired; null if deleted),
    text, old_role and fault; turn, old_role and fault are null for insertions."""
    scratch = scratch or Scratch(conversations.sparkSession, "conversations")
    return _sorted(with_faults(conversations, scratch)).mapInArrow(_edits, EDITS)


class _Report:
    """The figures of one conversation."""

    def __init__(self, conv: str):
        self.conv, self.audit, self.hash, self.empty = conv, [], hashlib.sha256(), True
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = self.turns = 0
        self.least = self.last_turn = self.last_initial = None
        self.repair = Repair(self._emit)

    def _emit(self, e: Edit) -> None:
        self.audit.append(e.edit)
        if len(self.audit) >= 4096:
            self.audit = ["".join(self.audit)]
        if e.role is not None:
            self.hash.update(f"{'' if self.empty else chr(10)}{e.role}:{e.row or ''}".encode())
            self.empty = False

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if fault:
            self.counts[fault] += 1
        if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = role[:1]
        self.repair.add(text, role, fault)

    def row(self) -> dict:
        cost = self.repair.finish()
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.turns
        return {
            "conv": self.conv, "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE],
            "truncated": self.counts[TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string() if c in ("conv", "audit", "repaired_sha256") else pa.int64()) for c in (p.split()[0] for p in REPORT.split(", "))])
    done, report, chars = [], None, 0
    for conv, turn, role, text, fault in _rows(batches):
        if report is None or report.conv != conv:
            if report:
                done.append(report.row())
                chars += len(done[-1]["audit"])
            report = _Report(conv)
        report.add(turn, role, text, fault)
        if len(done) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(done, schema)
            done, chars = [], 0
    if report:
        done.append(report.row())
    yield pa.RecordBatch.from_pylist(done, schema)


def repair_report(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per conversation: conv (its id as text), counts of faults, gaps between turns, illegal neighbours, the cost and the
    initials of its edits, and the SHA-256 of the repaired ``role:text`` lines."""
    scratch = scratch or Scratch(conversations.sparkSession, "conversations")
    return _sorted(with_faults(conversations, scratch)).mapInArrow(_reports, REPORT)


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults put in, chosen by a checksum of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chosen = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), chosen.alias("damage")).filter("damage <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    scratch = Scratch(spark, "conversations")
    reports = repair_report(damaged(conversations), scratch)
    ids = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    whole = ids.join(reports, "conv", "left").drop("conv")
    return whole.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill(
        {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    )


def _sql() -> str:
    """The statement: a checksum by table, and a recursion over rows that keeps the whole least edits of each state."""

    def add(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {state}.o || {line}}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    inserted = f"""n, s, {least("u", *(add(x, "2", "I", user) for x in "nsa"))} AS u,
      {least("a", add("u", "2", "I", assistant), *(add(x, "4", "II", f"{user} || {assistant}") for x in "ns"))} AS a"""

    def rowed(state: str, initial: str, name: str) -> list[str]:
        keep = add(state, "extra", "K", "role || ':' || text || chr(10)")
        ways = [f"CASE WHEN keepable AND role[1] = '{initial}' THEN {keep} END"]
        if name:
            rerole = add(state, "(2 + extra)", "R", f"'{name}:' || text || chr(10)")
            ways.append(f"CASE WHEN keepable THEN {rerole} END")
        return ways

    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
named AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
chosen AS (
  SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda d: ord(d)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS damage
  FROM named, crc_table),
damaged AS (
  SELECT conv, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM chosen, unnest(CASE damage WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
looked AS (
  SELECT *, regexp_replace(text, '[ \\t\\n\\v\\f\\r]+$', '') AS core, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS copy,
    lag(role) OVER (PARTITION BY conv ORDER BY i) AS role_before FROM numbered),
faulty AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM looked),
priced AS (
  SELECT conv, i, role, text, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS keepable, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS extra FROM faulty),
best AS (
  SELECT DISTINCT conv, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS n, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS s,
    NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS a FROM named
  UNION ALL
  SELECT conv, i, {add("n", "3", "D")}, {least(add("s", "3", "D"), *rowed("n", "s", ""))},
    {least(add("u", "3", "D"), *(way for x in "nsa" for way in rowed(x, "u", "user")))},
    {least(add("a", "3", "D"), *rowed("u", "a", "assistant"))}
  FROM (SELECT b.conv, p.i, p.role, p.text, p.keepable, p.extra, {inserted} FROM best b JOIN priced p ON p.conv = b.conv AND p.i = b.i + 1)),
closed AS (SELECT conv, i, {inserted} FROM best),
chosen_edits AS (SELECT conv, {least("n", "a")} AS e FROM closed QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (role_before IS NOT NULL AND role_before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.c::BIGINT AS cost, e.a AS audit,
  sha256(CASE WHEN e.o = '' THEN '' ELSE e.o[1:length(e.o) - 1] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM named) ids JOIN chosen_edits USING (conv) LEFT JOIN counted USING (conv)
"""


OP12_SQL = _sql()
