"""Repairs against a search that keeps whole strings; conversations against plain Python."""

import hashlib
import random
import zlib

from graphproof.llm import conversation_repair as C
from graphproof.llm.conversation_repair import Repair, repair_edits, repair_report


def whole_search(rows):
    """(cost, audit, repaired rows) of (role, text, fault) rows: every state keeps its whole least string."""
    best = {C.NOTHING: (0, "", ())}
    for role, text, fault in rows:
        found = {}
        for state, (cost, audit, out) in best.items():
            for inserted, middle in C.INSERTIONS[state]:
                c, a = cost + 2 * len(inserted), audit + "I" * len(inserted)
                o = out + tuple((C.ROLES[r], "") for r in inserted)
                ways = [(c + 3, a + "D", o, middle)]
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    if middle in C.AFTER.get(role[:1], {}):
                        ways.append((c + extra, a + "K", (*o, (role, text)), C.AFTER[role[:1]][middle]))
                    ways += [(c + extra + 2, a + "R", (*o, (n, text)), C.AFTER[r][middle]) for r, n in C.ROLES.items() if middle in C.AFTER[r]]
                for way in ways:
                    if way[3] not in found or way[:2] < found[way[3]][:2]:
                        found[way[3]] = way[:3]
        best = found
    ends = []
    for state, (cost, audit, out) in best.items():
        for inserted, end in C.INSERTIONS[state]:
            if end in C.ENDS:
                ends.append((cost + 2 * len(inserted), audit + "I" * len(inserted), out + tuple((C.ROLES[r], "") for r in inserted)))
    return min(ends)


def repaired(rows):
    out = []
    repair = Repair(out.append)
    for role, text, fault in rows:
        repair.add(text, role, fault)
    cost = repair.finish()
    return cost, "".join(e.edit for e in out), tuple((e.role, e.row or "") for e in out if e.role is not None)


def test_edits_equal_a_whole_search():
    rng = random.Random(5)
    for _ in range(3000):
        roles = rng.choice([["system", "user", "assistant", "tool", ""], ["user", "assistant"], ["assistant"], ["user", "system"]])
        rows = [(rng.choice(roles), f"t{i}", rng.choice([None, None, None, "blank", "truncated", "duplicate"])) for i in range(rng.randint(0, 16))]
        assert repaired(rows) == whole_search(rows)


def test_ties_take_the_least_initials():
    assert repaired([("tool", "x", None)]) == (3, "D", ())  # RI would cost 4
    assert repaired([("user", "x", None)]) == (2, "KI", (("user", "x"), ("assistant", "")))
    assert repaired([("assistant", "x", None)])[:2] == (2, "IK")
    assert repaired([("system", "x", None)])[:2] == (3, "D")
    assert repaired([("assistant", "x", "truncated")])[:2] == (3, "D")  # ties with IK, D comes first
    assert repaired([])[:2] == (0, "")


def test_memory_follows_open_ties_only():
    rng = random.Random(2)
    seen = []
    repair = Repair(seen.append)
    for i in range(20_000):
        repair.add(i, rng.choice(["user", "assistant", "user", "assistant", "tool"]), rng.choice([None] * 5 + ["blank", "truncated"]))
    assert repair.most_nodes < 200
    assert len(seen) > 19_000  # emitted on the way
    repair.finish()
    assert [e.row for e in seen if e.edit != "I"] == list(range(20_000))


def plain(rows):
    """conv -> report, from (conv, turn, role, text) rows."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(" " if conv is None else str(conv), []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in groups.items():
        own.sort()
        seen, marked = set(), []
        for *_, role, text in own:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for has, t, *_ in own if has]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:], strict=False)]
        cost, audit, lines = whole_search(marked)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def odd_rows():
    rng = random.Random(9)
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (2, 5, "", ""), (2, 9, "system", "x!"), (2, 9, "assistant", "y?")]
    rows += [(3, -4, "user", "ü" * 200_000 + "."), (3, -4, "user", "ü" * 200_000 + "."), (3, 7, "user", "ü" * 200_000 + ".")]
    rows += [(4, t % 9, rng.choice(["user", "assistant", "system"]), rng.choice(["q.", "r?", "s", " \n", "t!\x0b"])) for t in range(200)]
    rows += [(c, t, rng.choice(["user", "assistant"]), f"{c}-{t}" + rng.choice([".", "!", "", " . "])) for c in range(5, 60) for t in range(rng.randint(1, 9))]
    return rows


def test_reports_and_edits_equal_plain_python(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, first int")
    got = {r[0]: tuple(r)[1:] for r in repair_report(frame).collect()}
    assert got == plain(rows)
    edits = {}
    for r in repair_edits(frame).collect():
        edits.setdefault(r["conv_id"], []).append(r)
    for conv, own in edits.items():
        own.sort(key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(1, len(own) + 1))
        assert "".join(r["edit"] for r in own) == got[conv][6]
        lines = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["role"] is not None)
        assert hashlib.sha256(lines.encode()).hexdigest() == got[conv][7]
    assert repair_report(frame.limit(0)).count() == 0


def test_damage(spark, tmp_path):
    rows = [(c, t, ["user", "assistant"][t % 2], f"row {c}. {t}!") for c in range(80) for t in range(6)] + [(900, None, None, None), (None, 1, "user", "k.")]
    # conversations of one row whose checksum drops it
    gone = [c for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(c, 0, "user", "x.") for c in gone]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()}
    hurt = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        hurt += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    expected = plain(hurt)
    assert gone and set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        figures = expected.get(" " if conv is None else str(conv), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
        assert tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == figures
