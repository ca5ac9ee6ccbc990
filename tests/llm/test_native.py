"""Exact dedup, personal data and mixing against brute force and on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphproof.llm import exact_dedup, mixing, pii
from graphproof.session import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 20_000


def docs(spark, *texts, source="s"):
    return spark.createDataFrame([(i, t, None, source, 0) for i, t in enumerate(texts)], DOCS)


# exact dedup

def groups_of(spark, frame):
    return {r.doc_id: r for r in exact_dedup.exact_groups(frame).collect()}


def test_equal_after_white_space_runs(spark):
    rows = groups_of(spark, docs(spark, "a  b", "a\n\tb", "a b ", None, "", LONG, LONG, " ", "A b"))
    assert {i: r.keep_id for i, r in rows.items()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8}
    assert {i for i, r in rows.items() if r.kept} == {0, 2, 3, 5, 7, 8}
    assert rows[1].group_size == 2 and rows[2].group_size == 1
    assert rows[0].digest == hashlib.sha256(b"a b").hexdigest()


def test_of_repeated_rows_one_stays(spark):
    frame = spark.createDataFrame([(5, "x"), (5, "x"), (7, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    rows = exact_dedup.exact_groups(frame).collect()
    assert Counter((r.keep_id, r.kept) for r in rows) == {(5, True): 1, (5, False): 3, (None, True): 1}
    assert exact_dedup.exact_groups(frame.limit(0)).count() == 0


def test_dedup_keeps_columns_and_takes_clashing_names(spark):
    frame = docs(spark, "a", "a", "b").withColumn("digest", F.lit(1)).withColumn("n", F.lit(2)).withColumn("kept", F.lit(3))
    out = exact_dedup.exact_dedup(frame)
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == {0, 2}


def test_state_outlives_a_run(spark):
    scratch = Scratch(spark, "test")
    state = exact_dedup.DedupState(spark, f"{scratch.path}/kept")
    first = exact_dedup.digest_rows(exact_dedup.located(docs(spark, "a", "b"), Scratch(spark, "one")))
    state.absorb(first)
    later = docs(spark, "zz", "b", "c").withColumn("doc_id", F.col("doc_id") + 100)
    state.absorb(exact_dedup.digest_rows(exact_dedup.located(later, Scratch(spark, "two"))))
    found = {r.digest: (r.n, r.keep_id) for r in state.read().collect()}
    assert found[hashlib.sha256(b"b").hexdigest()] == (2, 1) and len(found) == 4


def test_texts_that_share_a_digest_are_told_apart(spark, monkeypatch):
    """With a digest of the first letter only, full bytes decide."""
    monkeypatch.setattr(
        exact_dedup, "digest_rows",
        lambda d: d.select(F.substring("text", 1, 1).alias("digest"), "doc_id", "_llm_file", "_llm_row"),
    )
    rows = groups_of(spark, docs(spark, "ax", "ay", "ax", "ay", "b", "az"))
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in rows.items()} == {
        0: (0, 2, True), 1: (1, 2, True), 2: (0, 2, False), 3: (1, 2, False), 4: (4, 1, True), 5: (5, 1, True)}


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15,
    }[kind]()


def brute(text):
    text = text or ""
    found = [
        (m.start(), list(PLAIN).index(k), m.end(), k)
        for k, p in PLAIN.items() for m in re.finditer(p, text) if valid(k, m.group())
    ]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return Counter(k for *_, k in found), hashlib.sha256(joined.encode()).hexdigest(), joined


AWKWARD = [
    None, "", "no data", "a@b.c_d@e.f.g x.y@z-1.de.", "@a@b.c a@b", "x+y%z@q.w...e@r.t", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004",
    "0.0.0.0 9999999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111111111111111",
    "é漢😀 4111 1111-1111 1111 😀 mail jo@x.org", "+1 (988) 555-2485 and +49 30 1234567", "+1 2", "+123456789012345678",
    "+1.2.3.4.5.6.7.8.9.0 1.2.3.4", "call +44 20 7946 0958 now", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432 x",
    "7" * 30_000, "1 " * 30_000, "a@b.c " * 3_000, "a" * 50_000, "a.b" * 20_000 + "@x.y", LONG, "a@b.c,d@e.f", "1-2--3 4  5",
]


def test_spans_equal_brute_force(spark, tmp_path):
    docs(spark, *AWKWARD).withColumn("spans", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(AWKWARD):
        counts, digest, joined = brute(text)
        own = ",".join(s for s in rows[i].spans.split(",") if not s.startswith("iban"))
        assert (own, rows[i].base_sha256) == (joined, digest), text and text[:80]
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [counts[k] for k in PLAIN]


def test_method_adds_ibans_and_scores(spark, tmp_path):
    texts = ["iban DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "call +44 20 7946 0958", "+44 20 7946 0958"]
    docs(spark, *texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r.scored_spans for r in pii.op4_pii(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert rows[0] == "iban:5:32:0.85" and rows[1] == ""
    assert rows[2] == "phone:5:21:0.75" and rows[3] == "phone:0:16:0.50"


# mixing

def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i % 40), None, f"s{i % 7}" if i % 3 else "hot", 0) for i in range(6000)]
    frame = spark.createDataFrame(rows, DOCS)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in mixing.with_copies(frame, Scratch(spark, "test")).collect():
        n = len(r.text.split())
        size[r.source] += n
        taken[r.source] += n * r._llm_copies
        target[r.source] = r._llm_target
        assert 0 <= r._llm_copies <= 2
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    weights = dict(zip(sorted(size), [3, 1, 2] * 3, strict=False))
    level = max(target[s] / weights[s] for s in size)
    for s in size:
        assert target[s] == pytest.approx(min(2 * size[s], level * weights[s]))
        assert taken[s] == pytest.approx(target[s], rel=0.15)


def test_mix_of_awkward_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", None, "a", 0), (None, "x y", None, "b", 0), (4, LONG, None, "b", 0), (4, LONG, None, "b", 0)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("rate", F.lit(1)).withColumn("size", F.lit("x"))
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert {r.source for r in out.collect()} <= {"a", "b", None}
    assert mixing.mix(frame.limit(0)).count() == 0
    assert mixing.mix(frame.filter("text is null")).count() == 0
