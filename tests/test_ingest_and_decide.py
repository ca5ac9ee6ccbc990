import json
import time

import pytest

from graphproof import build_requests, check_answers, decide, escalate, parse_documents
from graphproof.operators.decide import NO_ANSWER, SEVERAL_ANSWERS, read_response
from graphproof.sources.frontmatter import META_LAYOUT, DecodeError, load_yaml

ENTITY = "id string, kind string, title string, aliases array<string>, document string"


def errors(spark, documents):
    rows = spark.createDataFrame(list(documents.items()), "document string, content string")
    return {r["document"]: r["error"] for r in parse_documents(rows).collect()}


def test_document_errors(spark):
    got = errors(
        spark,
        {
            "ok": "---\r\nid: x\r\ntype: T\r\n---\r\nbody\n---\nmore",
            "empty": "---\n---\n",
            "no_end": "---\nid: x\n---",
            "bom": "﻿---\nid: x\ntype: T\n---\n",
            "blank": "---\nid: '　'\ntype: T\n---\n",
            "kind": "---\nid: x\ntype: ' '\n---\n",
            "extra": "---\nid: x\ntype: T\nnote: 1\n---\n",
        },
    )
    assert got["ok"] is None
    assert got["empty"] == "empty: YAML frontmatter is missing closing delimiter"
    assert got["no_end"] == "no_end: YAML frontmatter is missing closing delimiter"
    assert got["bom"] == "bom: knowledge document must start with YAML frontmatter"
    assert got["blank"] == "blank: id must not be empty"
    assert got["kind"] == "kind: type must not be empty"
    assert got["extra"] == "extra: invalid frontmatter: document: unknown field `note`"


def test_scalars_keep_their_text():
    meta = load_yaml("id: 017\ntype: yes\ntitle: 2024-01-01\naliases: [1:30, ~]", META_LAYOUT)
    assert (meta["id"], meta["type"], meta["title"]) == ("017", "yes", "2024-01-01")
    assert meta["aliases"] == ["1:30", "~"]
    assert load_yaml("id: a\ntype: b\ntitle: ~", META_LAYOUT)["title"] is None


@pytest.mark.parametrize(
    "text",
    ["id: a", "id: a\nid: b\ntype: t", "id: [a]\ntype: t", "- a", "", "id: a\ntype: t\naliases: x",
     "id: a\ntype: t\nrelations: [{relation: r}]", "id: 'a\ntype: t",
     "id: a\ntype: t\nrelations: [{relation: r, target: t, evidence: [{exact: e, hint: {start: -1, end: 1}}]}]"],
)
def test_wrong_layouts_are_errors(text):
    with pytest.raises(DecodeError):
        load_yaml(text, META_LAYOUT)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"entity_id": "a", "confidence": 1}', ("a", 1.0)),
        ("{}", (None, None)),
        (' {"entity_id": null} \n', (None, None)),
        ('["a", 0.5]', ("a", 0.5)),
    ],
)
def test_sound_responses(text, want):
    assert read_response(text) == (*want, None)


@pytest.mark.parametrize(
    "text",
    [None, "", "5", '"a"', "{} x", '{"entity_id": 5}', '{"confidence": "1"}', '{"note": 1}',
     '{"confidence": NaN}', '{"confidence": true}', '{"entity_id": "a", "entity_id": "b"}',
     '{"confidence": 1e999}', "[]"],
)
def test_unsound_responses(text):
    assert read_response(text)[2].startswith("invalid decision response: ")


def test_escalation(spark):
    rows = [("a", "T", "Same", ["x"], "1.md"), ("b", "T", "same", [], "2.md"),
            ("c", "T", "Other", ["only"], "3.md")]
    entities = spark.createDataFrame(rows, ENTITY)
    asked = [(1, "only"), (2, " SAME "), (3, "oth"), (4, "  "), (5, "same")]
    lookups = spark.createDataFrame(asked, "query_id bigint, text string")
    requests, candidates = escalate(entities, lookups)
    built = {
        r["query_id"]: json.loads(r["request"]) for r in build_requests(requests).collect()
    }
    assert built == {
        n: {"version": 1, "task": "select_entity", "query": text, "needle": needle, "scope": scope}
        for n, text, needle, scope in (
            (2, " SAME ", "same", "exact"), (3, "oth", "oth", "all"), (4, "  ", "", "all"),
            (5, "same", "same", "exact"))
    }
    sets = {(c["needle"], c["id"]) for c in candidates.collect()}
    assert sets == {("same", "a"), ("same", "b")}

    def decider(request):
        text = json.loads(request)["query"]
        if text == "oth":
            raise RuntimeError("no idea")
        chosen = {" SAME ": "b", "same": "c", "  ": "c"}[text]
        return json.dumps({"entity_id": chosen, "confidence": 0.75})

    answers = decide(build_requests(requests), decider, entities)
    got = {
        r["query_id"]: (r["entity_id"], r["document"], r["confidence"], r["error"])
        for r in check_answers(requests, candidates, entities, answers).collect()
    }
    assert got == {
        2: ("b", "2.md", 0.75, None),
        3: (None, None, None, "no idea"),
        4: ("c", "3.md", 0.75, None),
        5: (None, None, None, "decision adapter returned entity 'c' outside the candidate set"),
    }


def test_high_confidence_is_rejected(spark):
    entities = spark.createDataFrame([("a", "T", "A", [], "1.md")], ENTITY)
    lookups = spark.createDataFrame([(1, "zzz")], "query_id bigint, text string")
    requests, candidates = escalate(entities, lookups)
    answers = spark.createDataFrame(
        [(1, '{"entity_id": "a", "confidence": 1.1}')], "query_id bigint, response string"
    )
    (row,) = check_answers(requests, candidates, entities, answers).collect()
    assert row["error"] == "decision adapter confidence must be finite and within 0..=1"


def _two_requests(spark, rows=(("a", "T", "A", [], "1.md"),)):
    entities = spark.createDataFrame(list(rows), ENTITY)
    lookups = spark.createDataFrame([(1, "zzz"), (2, "yyy")], "query_id bigint, text string")
    return entities, *escalate(entities, lookups)


def test_each_request_is_asked_once(spark, tmp_path):
    entities, requests, candidates = _two_requests(spark)
    log = str(tmp_path / "calls")

    def decider(request):
        with open(log, "a") as f:
            f.write("x")
        return '{"entity_id": "a"}'

    answers = decide(build_requests(requests), decider, entities)
    decisions = check_answers(requests, candidates, entities, answers)
    for _ in range(2):
        assert {r["entity_id"] for r in decisions.collect()} == {"a"}
    assert open(log).read() == "xx"


def test_nobody_is_asked_about_no_entities(spark):
    entities, requests, candidates = _two_requests(spark, rows=())

    def decider(request):
        raise AssertionError("asked")

    answers = decide(build_requests(requests), decider, entities)
    rows = check_answers(requests, candidates, entities, answers).collect()
    assert [(r["entity_id"], r["error"]) for r in rows] == [(None, None)] * 2


def test_lost_and_repeated_answers_are_errors(spark):
    entities, requests, candidates = _two_requests(spark)
    answers = spark.createDataFrame(
        [(1, '{"entity_id": "a"}'), (1, "{}")], "query_id bigint, response string"
    )
    rows = {r["query_id"]: r["error"] for r in check_answers(requests, candidates, entities, answers).collect()}
    assert rows == {1: SEVERAL_ANSWERS, 2: NO_ANSWER}


def test_a_hanging_or_endless_decider_costs_its_own_request_only(spark):
    entities = spark.createDataFrame([("a", "T", "A", [], "1.md")], ENTITY)
    texts = ["hang", "long", "exit", "raise", *(f"fine {i}" for i in range(6))]
    lookups = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string").coalesce(1)
    requests, candidates = escalate(entities, lookups)

    def decider(request):
        text = json.loads(request)["query"]
        if text == "hang":
            time.sleep(600)
        if text == "exit":
            raise SystemExit("gone")
        if text == "raise":
            raise ValueError("no")
        return '{"entity_id": "a"}' + " " * (100 if text == "long" else 0)

    begin = time.perf_counter()
    answers = decide(build_requests(requests), decider, entities, seconds=1.5, most_bytes=60)
    rows = {r["query_id"]: (r["entity_id"], r["error"]) for r in check_answers(requests, candidates, entities, answers).collect()}
    assert time.perf_counter() - begin < 120
    assert rows[0] == (None, "decision adapter 'decider' timed out after 1.5 seconds")
    assert rows[1] == (None, "decision adapter 'decider' exceeded 60 bytes")
    assert rows[2] == (None, "gone") and rows[3] == (None, "no")
    assert all(rows[i] == ("a", None) for i in range(4, 10))
