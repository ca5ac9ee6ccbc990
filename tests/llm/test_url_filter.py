"""URL rules against plain string tests; the automaton against translated regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphproof.llm import url_filter
from graphproof.llm.url_filter import ONE, REST, RUN, Automaton, Rule, glob_tokens, judge_urls


def as_regex(tokens):
    parts = {ONE: b"[^/]", RUN: b"[^/]*", REST: b"(?s:.*)"}
    return re.compile(b"".join(parts.get(t) or re.escape(bytes([t])) for t in tokens))


def test_automaton_equals_regular_expressions():
    rng = random.Random(3)
    patterns = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?", "ab", "ä"]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    tokens = [glob_tokens(p) for p in patterns]
    texts = ["".join(rng.choice("ab/.ä") for _ in range(rng.randint(0, 40))).encode() for _ in range(400)] + [b"", b"ab" * 60]
    automaton = Automaton(tokens)
    assert len(automaton.start) > 3  # patterns straddle words
    got = automaton.first_accepted(pa.array(texts, pa.binary()), [[i] for i in range(len(tokens))])
    hits = 0
    for found, pattern in zip(got, tokens, strict=True):
        expected = [as_regex(pattern).fullmatch(t) is not None for t in texts]
        assert ((found == 0) == np.array(expected)).all()
        hits += sum(expected)
    assert hits > 200


def test_pieces_and_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(url_filter, "SET_BYTES", 64)
    automaton = Automaton([glob_tokens("*.x/**"), glob_tokens("**b")])
    texts = pa.array([b"zz", b".x/1", b"ab", b".x/b", b".x"], pa.binary())[1:]
    first, = automaton.first_accepted(texts, [[0, 1]])
    assert first.tolist() == [0, 1, 0, -1]


def test_escapes_and_bounds(monkeypatch):
    assert glob_tokens(r"a\*?") == [ord("a"), ord("*"), ONE]
    monkeypatch.setattr(url_filter, "MOST_BITS", 8)
    with pytest.raises(ValueError, match="positions"):
        Automaton([glob_tokens("abcdefgh")])


def plain(url, rules, blocked):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + tail
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    bad = any(re.fullmatch(g.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", "(?s:.*)"), f".{host}{path}") for g in blocked)
    return host, path, None, "block" if bad else "allow"


def test_rows_equal_plain_rules(spark):
    urls = [
        None, "", "no scheme", "://", "http://org", "http://org/", "HTTP://ORG/es/", "http://notorg/", "http://a.example.org/es/1",
        "http://example.org/en/1", "http://example.org/en/2", "http://badexample.org/es/", "http://EXAMPLE.ORG/es/x?u=http://com/fr/",
        "http://x.com/fr/1", "http://x.com/FR/1", "http://x.com?/fr/", "http://x.com#/de/", "http://x.net/.org/", "http://x.org:80/",
        "http://İ.org/a", "a://b://c.org/", "http://x.net/\n/de/", "http://ads-1.x.net", "http://m.adult-x.net/p", "http://threads-1.net/",
        "http://x.net/.spam-1", "http://free-bets.com/fr/", "http://x.com/" + "y" * 300_000, "http://x.com/de/" + "ü" * 70_000,
    ]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, "http://x.org/", "", ""), (3, "://", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = judge_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    expected = [(k, *plain(u, url_filter.RULES, url_filter.BLOCKED_GLOBS)) for k, u, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert judge_urls(pages.limit(0)).count() == 0


def test_own_rules(spark):
    pages = spark.createDataFrame([("k", "http://a*b.c/x*/1"), ("l", "http://aab.c/xy/1")], "name string, url string")
    rules = [Rule("block", "a*b.c", "/x*/"), Rule("allow", "c", "/")]
    got = {r["name"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, "name", rules, []).collect()}
    assert got == {"k": ("a*b.c/x*/", "block"), "l": ("c/", "allow")}
    with pytest.raises(ValueError, match="path"):
        judge_urls(pages, "name", [Rule("allow", "c", "x")])
