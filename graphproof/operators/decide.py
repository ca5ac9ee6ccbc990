"""Escalation of ambiguous lookups to a user-supplied decider.

A candidate set is kept once per needle and never copied per query. The set of a query without
exact match is the whole entity table: it is named by ``scope = 'all'``. Requests name their set and
never hold it, whatever its size; answers are checked by a join with the set. A decider that has to
see the candidates takes the tables (``decide_with_tables``).
"""

from __future__ import annotations

import json
import math
import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.fixed_values import DECISION_BYTES, DECISION_ERRORS, DECISION_SECONDS, DECISION_TASK, DECISION_VERSION
from graphproof.model import fill
from graphproof.operators.lookup import exact_matches, keyed_entities, listed_keys, needles_of
from graphproof.session import Scratch
from graphproof.skew import lookup_join

SCOPE_EXACT, SCOPE_ALL = "exact", "all"
#: Errors of answers that are lost or given twice; the batch form has no counterpart elsewhere.
NO_ANSWER = "no answer for this request"
SEVERAL_ANSWERS = "more than one answer for this request"


def escalate(
    entities: DataFrame, lookups: DataFrame, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(requests, candidates)`` for the lookups that do not have exactly one exact match.

    ``requests``: ``query_id, text, needle, scope, exact_count``; ``candidates``: ``needle``,
    ``rank`` and entity columns for the needles with two or more exact matches.
    """
    scratch = scratch or Scratch(entities.sparkSession, "escalate")
    needles = scratch.write(needles_of(lookups), "needles")
    # written, or the count of crowded keys would list them all again
    keys = scratch.write(listed_keys(keyed_entities(entities)), "keys")
    exact = scratch.write(exact_matches(keys, needles), "exact")
    counts = exact.groupBy("needle").agg(F.count(F.lit(1)).alias("exact_count"))
    requests = (
        lookup_join(needles, counts, ["needle"], spread=["query_id"])
        .withColumn("exact_count", F.coalesce("exact_count", F.lit(0)))
        .filter(F.col("exact_count") != 1)
        .select(
            "query_id", "text", "needle",
            F.when(F.col("exact_count") == 0, F.lit(SCOPE_ALL))
            .otherwise(F.lit(SCOPE_EXACT))
            .alias("scope"),
            "exact_count",
        )
    )
    crowded = counts.filter(F.col("exact_count") > 1).select("needle")
    candidates = lookup_join(
        exact, crowded, ["needle"], spread=["id", "document"], how="left_semi",
        load=counts, weight="exact_count",
    )
    return requests, candidates


def build_requests(requests: DataFrame) -> DataFrame:
    """Requests with the JSON ``request`` a decider gets: the query and the name of its candidate set."""
    body = F.struct(
        F.lit(DECISION_VERSION).alias("version"),
        F.lit(DECISION_TASK).alias("task"),
        F.col("text").alias("query"),
        "needle",
        "scope",
    )
    return requests.select(
        "query_id", "needle", "scope", "exact_count",
        F.to_json(body, {"ignoreNullFields": "false"}).alias("request"),
    )


class _Caller:
    """Calls a decider with a deadline.

    Calls run one after another in a thread of their own. A call that misses its deadline is left behind with its thread,
    which ends with the worker at the latest, and the next call gets a new thread.
    """

    def __init__(self, decider: Callable[[str], str | None], seconds: float, most_bytes: int):
        self.decider, self.seconds, self.most_bytes = decider, seconds, most_bytes
        self.name = getattr(decider, "__name__", type(decider).__name__)
        self.calls: queue.SimpleQueue | None = None

    @staticmethod
    def _serve(decider: Callable, calls: queue.SimpleQueue, answers: queue.SimpleQueue) -> None:
        while (request := calls.get()) is not None:
            try:
                answers.put((decider(request), None))
            except BaseException as error:  # noqa: BLE001 - reported per request; SystemExit too must not end the thread
                answers.put((None, str(error) or type(error).__name__))

    def __call__(self, request: str) -> tuple[str | None, str | None]:
        """(response, failure)"""
        if self.calls is None:
            self.calls, self.answers = queue.SimpleQueue(), queue.SimpleQueue()
            threading.Thread(target=self._serve, args=(self.decider, self.calls, self.answers), daemon=True).start()
        self.calls.put(request)
        try:
            response, failure = self.answers.get(timeout=self.seconds)
        except queue.Empty:
            self.calls.put(None)  # should it ever come back
            self.calls = None
            return None, DECISION_ERRORS["timeout"].format(self.name, f"{self.seconds:g}")
        if isinstance(response, str) and len(response.encode("utf-8", "replace")) > self.most_bytes:
            return None, DECISION_ERRORS["too_long"].format(self.name, self.most_bytes)
        return response, failure

    def close(self) -> None:
        if self.calls is not None:
            self.calls.put(None)


def decide(
    requests: DataFrame,
    decider: Callable[[str], str | None],
    entities: DataFrame,
    scratch: Scratch | None = None,
    seconds: float = DECISION_SECONDS,
    most_bytes: int = DECISION_BYTES,
) -> DataFrame:
    """Ask ``decider`` for each ``request``, once; ``(query_id, response, failure)``.

    The decider runs inside the tasks. What it raises becomes the ``failure`` of that row, and so does an answer that takes
    longer than ``seconds`` or has more than ``most_bytes`` bytes; the other requests go on. The
    answers are written before they are returned, so reading them again asks nobody; only a task
    that Spark runs again repeats its calls. Without entities there is no set to choose from and nobody is asked.
    """
    scratch = scratch or Scratch(requests.sparkSession, "decide")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = _Caller(decider, seconds, most_bytes)
        try:
            for batch in batches:
                answers = [caller(request) for request in batch["request"]]
                responses, failures = zip(*answers, strict=True) if answers else ((), ())
                yield pd.DataFrame({"query_id": batch["query_id"], "response": list(responses), "failure": list(failures)})
        finally:
            caller.close()

    asked = requests.filter(F.lit(False)) if entities.isEmpty() else requests
    answers = asked.select("query_id", "request").mapInPandas(
        ask, f"query_id {_id_type(requests)}, response string, failure string"
    )
    return scratch.write(answers, "answers")


def decide_with_tables(
    requests: DataFrame,
    candidates: DataFrame,
    entities: DataFrame,
    decider: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
    scratch: Scratch | None = None,
) -> DataFrame:
    """Answers ``(query_id, response[, failure])`` of a decider that works on whole tables.

    It gets the requests, the candidates (by needle) and the entities, the set of ``scope = 'all'``.
    """
    scratch = scratch or Scratch(requests.sparkSession, "decide")
    return scratch.write(decider(requests, candidates, entities), "table-answers")


def _id_type(df: DataFrame) -> str:
    return df.schema["query_id"].dataType.simpleString()


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate field")
    return out


def _no_constant(name):
    raise ValueError(f"{name} is not JSON")


def read_response(text: str | None) -> tuple[str | None, float | None, str | None]:
    """One decider response as ``(entity_id, confidence, error)``, read strictly."""
    try:
        if text is None:
            raise ValueError("no response")
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
        if isinstance(value, list):  # fields by position
            if not 1 <= len(value) <= 2:
                raise ValueError("expected one or two elements")
            value = dict(zip(("entity_id", "confidence"), value))
        if not isinstance(value, dict):
            raise ValueError("expected an object")
        extra = set(value) - {"entity_id", "confidence"}
        if extra:
            raise ValueError(f"unknown field `{min(extra)}`")
        entity_id, confidence = value.get("entity_id"), value.get("confidence")
        if entity_id is not None:
            if not isinstance(entity_id, str):
                raise ValueError("entity_id must be a string or null")
            entity_id.encode("utf-8")
        if confidence is not None:
            if isinstance(confidence, bool) or not isinstance(confidence, (int, float)):
                raise ValueError("confidence must be a number or null")
            confidence = float(confidence)
            if math.isinf(confidence):
                raise ValueError("number out of range")
        return entity_id, confidence, None
    except (ValueError, OverflowError) as error:
        return None, None, f"invalid decision response: {error}"


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [read_response(text) for text in batch["response"]]
        out = pd.DataFrame(rows, columns=["entity_id", "confidence", "problem"])
        out["confidence"] = out["confidence"].astype("float64")
        out.insert(0, "query_id", batch["query_id"].to_numpy())
        out["failure"] = batch["failure"].to_numpy()
        yield out


def check_answers(
    requests: DataFrame,
    candidates: DataFrame,
    entities: DataFrame,
    answers: DataFrame,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Decisions for the requests, from answers ``(query_id, response[, failure])``.

    Result: ``query_id, entity_id, kind, title, document, confidence, error``. A null
    ``entity_id`` without error is the answer "none of them". A request without answer row or with
    several is reported as an error, except that an empty entity table leaves nothing to ask about.
    """
    scratch = scratch or Scratch(requests.sparkSession, "answers")
    if "failure" not in answers.columns:
        answers = answers.withColumn("failure", F.lit(None).cast("string"))
    read = answers.select("query_id", "response", "failure").mapInPandas(
        _read_batches,
        f"query_id {_id_type(answers)}, entity_id string, confidence double, problem string, failure string",
    )
    # one row per query; of several answers only their number is used
    fields = ("entity_id", "confidence", "problem", "failure")
    read = read.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_answers"), *(F.min(c).alias(c) for c in fields))
    read = scratch.write(read, "read")
    asked = requests.select("query_id", "needle", "scope").join(read, "query_id", "left")
    # First row of a set with that id, in candidate order.
    chosen = candidates.groupBy("needle", F.col("id").alias("entity_id")).agg(
        F.min(F.struct("rank", "document", "kind", "title")).alias("exact_pick")
    )
    any_row = entities.groupBy(F.col("id").alias("entity_id")).agg(
        F.min(F.struct("document", "kind", "title")).alias("all_pick")
    )
    located = lookup_join(asked, chosen, ["needle", "entity_id"], spread=["query_id"])
    located = lookup_join(
        located, any_row, ["entity_id"], spread=["query_id"], load=read.select("entity_id")
    )
    exact_only = F.col("scope") == SCOPE_EXACT

    def pick(field: str):
        return F.when(exact_only, F.col(f"exact_pick.{field}")).otherwise(
            F.col(f"all_pick.{field}")
        )

    confidence = F.col("confidence")
    error = (
        F.when(F.col("n_answers").isNull(), F.lit(None if entities.isEmpty() else NO_ANSWER))
        .when(F.col("n_answers") > 1, F.lit(SEVERAL_ANSWERS))
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(~confidence.between(0.0, 1.0), F.lit(DECISION_ERRORS["confidence"]))
        .when(
            F.col("entity_id").isNotNull() & pick("document").isNull(),
            fill(DECISION_ERRORS["outside"], "entity_id"),
        )
    )
    sound = F.col("error").isNull() & F.col("n_answers").isNotNull()
    keep = lambda c: F.when(sound, c)
    return located.withColumn("error", error).select(
        "query_id",
        keep(F.col("entity_id")).alias("entity_id"),
        keep(pick("kind")).alias("kind"),
        keep(pick("title")).alias("title"),
        keep(pick("document")).alias("document"),
        keep(confidence).alias("confidence"),
        "error",
    )
