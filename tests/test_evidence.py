import random
import time

import pytest

from graphproof import resolve_evidence
from graphproof.functions.matching import FEW, LineIndex, match_quotes
from graphproof.model import SELECTOR
from graphproof.operators import evidence

COLUMNS = (
    "src string, relation string, dst string, declaration string, decl_ordinal bigint, "
    f"sel_ordinal int, selector {SELECTOR}"
)


def resolve(spark, files, selectors, declaration="d.md"):
    """Resolve ``(source, exact, prefix, suffix, hint)`` rows; results in order."""
    rows = [
        ("s", "r", "t", declaration, 0, i, (src, exact, prefix, suffix, hint))
        for i, (src, exact, prefix, suffix, hint) in enumerate(selectors)
    ]
    sources = spark.createDataFrame(list(files.items()), "path string, content string")
    out = resolve_evidence(spark.createDataFrame(rows, COLUMNS), sources).collect()
    return sorted(out, key=lambda r: r["sel_ordinal"])


def sel(exact, source="a.txt", prefix=None, suffix=None, hint=None):
    return (source, exact, prefix, suffix, hint)


def test_states_and_lines(spark):
    files = {
        "a.txt": "red owl sat\nold owl ran\nonly\r\nhere",
        "f.md": "---\nquote: owl\nx: y\n---\n# Text\nowl\n",
        "d.md": "own quote",
        "sub/b.txt": "aaaaa",
        "bad.bin": None,
        "c.txt": "a\\Eb (x) é",
    }
    cases = [
        (sel("owl"), "ambiguous", None, None),
        (sel("owl", prefix="old ", suffix=" ran"), "valid", 2, 2),
        (sel("owl", prefix="blue "), "stale", None, None),
        (sel("owl", prefix=""), "ambiguous", None, None),
        (sel("only\nhere"), "valid", 3, 4),
        (sel("only\r\nhere", hint=(3, 4)), "valid", 3, 4),
        (sel("only", hint=(1, 1)), "relocated", 3, 3),
        (sel("gone"), "stale", None, None),
        (sel("owl", source="f.md"), "valid", 6, 6),
        (sel("Text", source="f.md", prefix="---\n# "), "stale", None, None),
        (sel("own quote", source=None), "valid", 1, 1),
        (sel("aa", source="sub/b.txt"), "ambiguous", None, None),
        (sel("aa", source="sub/b.txt", prefix="a"), "valid", 1, 1),
        (sel("aaaa", source="./sub//b.txt", prefix="a"), "stale", None, None),
        (sel("x", source="nowhere.txt"), "missing", None, None),
        (sel("x", source="sub"), "invalid", None, None),
        (sel("x", source=""), "invalid", None, None),
        (sel("x", source="a.txt/"), "missing", None, None),
        (sel("x", source="bad.bin"), "invalid", None, None),
        (sel("x", source="/a.txt"), "invalid", None, None),
        (sel("x", source="b/../a.txt"), "invalid", None, None),
        (sel(""), "invalid", None, None),
        (sel("x", hint=(0, 1)), "invalid", None, None),
        (sel("x", hint=(2, 1)), "invalid", None, None),
        (sel("\\Eb (x)", source="c.txt", prefix="a"), "valid", 1, 1),
        (sel("é", source="c.txt", prefix="(x) "), "valid", 1, 1),
    ]
    results = resolve(spark, files, [c[0] for c in cases])
    for (selector, state, start, end), row in zip(cases, results, strict=True):
        assert (row["state"], row["start_line"], row["end_line"]) == (state, start, end), selector


def test_messages(spark):
    files = {"a.txt": "x x x y", "bad.bin": None}
    cases = {
        "exact quote appears 3 times; add prefix/suffix context": sel("x"),
        "selector matches 2 locations; provide more distinguishing context": sel("x", prefix=" "),
        "evidence source must be relative: /a": sel("x", source="/a"),
        "evidence source may not escape workspace: ../a": sel("x", source="../a"),
        "stream did not contain valid UTF-8": sel("x", source="bad.bin"),
    }
    results = resolve(spark, files, list(cases.values()))
    assert [r["message"] for r in results] == list(cases)


def model(text, exact, prefix, suffix):
    starts, at = [], text.find(exact)
    while at >= 0:
        starts.append(at)
        at = text.find(exact, at + len(exact))
    if not starts:
        return "stale", None
    if prefix is not None or suffix is not None:
        starts = [
            s for s in starts
            if text[:s].endswith(prefix or "") and text[s + len(exact):].startswith(suffix or "")
        ]
    if len(starts) == 1:
        return "valid", 1 + text[: starts[0]].count("\n")
    return ("ambiguous" if starts else "stale"), None


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab\n") for _ in range(n))
    files = {f"{i}.txt": word(rng.randint(0, 30)) for i in range(60)}
    selectors = []
    for _ in range(600):
        context = [rng.choice([None, word(rng.randint(0, 2))]) for _ in range(2)]
        selectors.append((rng.choice(list(files)), word(rng.randint(1, 3)), *context, None))
    for selector, row in zip(selectors, resolve(spark, files, selectors), strict=True):
        want = model(files[selector[0]], *selector[1:4])
        assert (row["state"], row["start_line"]) == want, (selector, files[selector[0]])


def test_one_source_quoted_by_most_selectors(spark):
    files = {"hub.txt": "\n".join(f"line {i}." for i in range(50)), "b.txt": "line 1."}
    selectors = [sel(f"line {i % 50}.", source="hub.txt") for i in range(3000)]
    selectors += [sel("line 1.", source="b.txt")]
    rows = resolve(spark, files, selectors)
    assert [r["start_line"] for r in rows] == [i % 50 + 1 for i in range(3000)] + [1]


def plain_matches(text, quote, prefix, suffix):
    hits, fits, first, at = 0, 0, -1, text.find(quote)
    while at >= 0:
        hits += 1
        if text[:at].endswith(prefix or "") and text[at + len(quote):].startswith(suffix or ""):
            fits += 1
            first = at if first < 0 else first
        at = text.find(quote, at + len(quote))
    return hits, fits, first


@pytest.mark.parametrize("count", [1, FEW, FEW + 1, 300])
def test_one_pass_finds_what_single_scans_find(count):
    rng = random.Random(count)
    word = lambda low, high: "".join(rng.choice("ab\nü") for _ in range(rng.randint(low, high)))
    for _ in range(20):
        text = word(0, 400)
        probes = [(word(1, 5), rng.choice([None, word(0, 3)]), rng.choice([None, word(0, 3)])) for _ in range(count)]
        assert match_quotes(text, probes) == [plain_matches(text, *p) for p in probes]


def test_nested_quotes_in_one_automaton():
    text = "a" * 50 + "b" + "a" * 7
    probes = [("a" * n, None, suffix) for n in range(1, 12) for suffix in (None, "b")]
    assert match_quotes(text, probes) == [plain_matches(text, *p) for p in probes]


def test_lines_by_binary_search():
    for text in ("", "\n", "\n\nx", "no end", "a\nbb\r\n\n" + "x" * 100_000 + "\n", "ü\n🦉\n"):
        index = LineIndex(text)
        assert [index.before(p) for p in range(min(len(text), 50) + 1)] == [text[:p].count("\n") for p in range(min(len(text), 50) + 1)]
        assert index.before(len(text)) == text.count("\n")


def test_lines_after_frontmatter_and_very_long_lines(spark):
    files = {
        "f.md": "---\na: b\n\n---\n\n\nfirst\n" + "long " * 60_000 + "owl\nlast owl",
        "empty.md": "", "only.md": "---\nx: owl\n---\n",
    }
    rows = resolve(spark, files, [
        sel("first", "f.md"), sel("owl\nlast", "f.md"), sel("owl", "f.md", prefix="last "), sel("\n\nfirst\nlong", "f.md"), sel("x", "empty.md"), sel("owl", "only.md"),
    ])
    assert [(r["state"], r["start_line"], r["end_line"]) for r in rows] == [
        ("valid", 7, 7), ("valid", 8, 9), ("valid", 9, 9), ("valid", 5, 8), ("stale", None, None), ("stale", None, None),
    ]


def test_blocks_and_own_groups_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab \n") for _ in range(n))
    files = {f"{i}.txt": word(rng.choice([0, 20, 3000])) for i in range(12)} | {"bad": None}
    selectors = [(rng.choice([*files, "gone", "x/.."]), word(rng.randint(1, 4)), rng.choice([None, word(1)]), None, None) for _ in range(900)]
    expected = resolve(spark, files, selectors)
    for name, value in {"OWN_GROUP_BYTES": 1000, "GROUP_BYTES": 2000, "BLOCK_QUOTES": 10, "BLOCK_CHARS": 100}.items():
        monkeypatch.setattr(evidence, name, value)
    assert resolve(spark, files, selectors) == expected


def test_a_hundred_thousand_quotes_of_one_source(spark, monkeypatch):
    """Each quote is found, and the text is read once per block and not once per quote."""
    text = "\n".join(f"entry {i:06d} of the long list" for i in range(33_000))
    assert 900_000 < len(text) < 1_100_000
    selectors = [sel(text[at : at + 32], hint=None) for at in range(0, 900_000, 9)]
    assert len(selectors) == 100_000
    begin = time.perf_counter()
    rows = resolve(spark, {"a.txt": text}, selectors)
    seconds = time.perf_counter() - begin
    lines = LineIndex(text)
    assert all(r["state"] == "valid" for r in rows)
    assert [r["start_line"] for r in rows] == [1 + lines.before(at) for at in range(0, 900_000, 9)]
    # the quotes make a few blocks; one scan of 1 MB per quote would take minutes
    assert -(-100_000 // evidence.BLOCK_QUOTES) <= 4
    assert seconds < 60
