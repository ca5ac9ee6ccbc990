"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around hits.

Training, on labelled rows only:

1. A sample of labelled rows whose expected size is bounded by ``TRAIN_ROWS`` is drawn by the hash of
   doc_id. Equal texts count once.
2. Words and word beginnings (stems) are counted in toxic and in clean documents with a map-side
   combined aggregate; those frequent enough and clearly more common in toxic documents form the lexicon
   of at most ``MAX_TERMS`` terms, which is small and goes into the tasks with the scan.
3. The scan's hits on the sample give each term a weight per edit distance and a logistic model
   over a few features of a document.

Scan: the lexicon is a trie. A word is read by the product of the trie with the Levenshtein automata
of its whole-word terms, made deterministic state by state as words need it; most words reach the
dead state within three letters. Each hit's window decides whether it is quoted (quotation marks around
it, no other hit near) or heaped (other hits near). Memos have bounded size.

Defined cases: null and empty texts have no hits and get the model's score for that; without any
toxic training row all scores are 0; repeated labels of a document count as toxic if one is; repeated
rows score alike; empty tables give no rows.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import lean, listed, table
from graphproof.session import Scratch

#: Expected labelled rows that train the model, at most; terms of the lexicon, at most.
TRAIN_ROWS = 6_000
MAX_TERMS = 300
#: A term must be in this share of the toxic documents, and so much likelier there (natural log).
MIN_SUPPORT, MIN_LIFT = 0.02, 1.5
STEMS = range(4, 8)
#: Edits that a whole word of at least so many letters may have.
EDITS = ((9, 2), (5, 1))
#: Words before and after a hit that belong to its window.
WINDOW = 10
MEMO = 400_000
_WORD = re.compile(r"\w+")
_QUOTES = re.compile("[\"“”„«»‹›]")


@dataclasses.dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # the beginning of a word, else a whole word
    weight: float  # of exact hits
    near: float = 0.0  # of hits with edits

    @property
    def edits(self) -> int:
        return 0 if self.stem else next((e for n, e in EDITS if len(self.text) >= n), 0)


class Automaton:
    """Words -> (term, edits) or None, by the determinised product of trie and Levenshtein automata."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget = [0]  # the most edits that a term below the node allows
        for i, term in enumerate(terms):
            node = 0
            self.budget[0] = max(self.budget[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], term.edits)
            self.ends[node].append(i)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.result: list[tuple[int, int] | None] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0)})

    def _state(self, items: set) -> int:
        """The id of a set of (node, edits), closed under skipped lexicon letters; stems stay as (~term, 0)."""
        stack = list(items)
        while stack:
            node, used = stack.pop()
            if node < 0:
                continue
            if used == 0:
                more = {(~t, 0) for t in self.ends[node] if self.terms[t].stem}
                items |= more
            for child in self.children[node].values():
                if used < self.budget[child] and (child, used + 1) not in items:
                    items.add((child, used + 1))
                    stack.append((child, used + 1))
        key = frozenset(items)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.result.append(self._best(key))
        return self.ids[key]

    def _best(self, items: frozenset) -> tuple[int, int] | None:
        found = []
        for node, used in items:
            own = [~node] if node < 0 else [t for t in self.ends[node] if not self.terms[t].stem and used <= self.terms[t].edits]
            found += [(used, -self.terms[t].weight, t) for t in own]
        if not found:
            return None
        used, _, term = min(found)
        return term, used

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, used in self.sets[state]:
            if node < 0:
                out.add((node, used))
                continue
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, used))
            if used < self.budget[node]:
                out.add((node, used + 1))
            out |= {(n, used + 1) for n in self.children[node].values() if used < self.budget[n]}
        to = self.moves[state][c] = self._state(out)
        return to

    def read(self, word: str) -> tuple[int, int] | None:
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                return None
        return self.result[state]


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str):
        if len(self) > MEMO:
            self.clear()
        found = self[word] = self.automaton.read(word)
        return found


class Scanner:
    """Hits and features of texts; made once per task."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.memo = _Memo(Automaton(terms))

    def hits(self, text: str) -> tuple[list[tuple[int, int, int]], int, str]:
        """(word position, term, edits) of each hit, the number of words, the text in lower case."""
        lower = text.lower()
        words = _WORD.findall(lower)
        return [(i, *h) for i, h in enumerate(map(self.memo.__getitem__, words)) if h], len(words), lower

    def features(self, text: str) -> list[float]:
        hits, n, lower = self.hits(text)
        exact = near = heaped = quoted = best = 0.0
        if hits:
            places = [m.span() for m in _WORD.finditer(lower)]
            for k, (i, term, used) in enumerate(hits):
                weight = self.terms[term].near if used else self.terms[term].weight
                if weight <= 0:
                    continue
                crowd = k > 0 and i - hits[k - 1][0] <= WINDOW or k + 1 < len(hits) and hits[k + 1][0] - i <= WINDOW
                start, end = places[max(0, i - WINDOW)][0], places[min(n - 1, i + WINDOW)][1]
                before = len(_QUOTES.findall(lower, start, places[i][0]))
                if not crowd and before % 2 and _QUOTES.search(lower, places[i][1], end):
                    quoted += weight
                    continue
                heaped += weight * crowd
                best = max(best, weight)
                if used:
                    near += weight
                else:
                    exact += weight
        length = math.log1p(n)
        return [
            math.log1p(exact), math.log1p(near), math.log1p(heaped), math.log1p(quoted), best,
            math.log1p(1000 * (exact + near) / (n + 50)), length,
        ]


@dataclasses.dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]  # the last one is the constant

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not self.coef:
            return np.zeros(len(features))
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.coef[:-1] + self.coef[-1], -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, scratch: Scratch) -> DataFrame:
    """text and label of labelled documents, expected ``rows`` of them at most, equal texts once.

    The share that is drawn follows from the count of labels; ids are drawn by hash and are
    so few that they can be broadcast, which leaves the documents unshuffled.
    """
    usable = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, rows / max(1, usable.count()))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max("label").alias("label"))
    return scratch.write(sample, "sample")


def _candidates(sample: DataFrame) -> list:
    """Terms of the sample that are frequent and telling enough, with their document counts."""
    totals = sample.agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals.t or 0, totals.n - (totals.t or 0)
    if not toxic:
        return []
    words = sample.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    stems = ", ".join(f"if(length(w) > {n}, concat(substr(w, 1, {n}), '*'), NULL)" for n in STEMS)
    terms = words.select("label", F.explode(F.expr(f"filter(array(w, {stems}), x -> x IS NOT NULL)")).alias("term"))
    # a stem that several words of one document share counts once per word; supports are of words then
    counts = terms.groupBy("term").agg(F.sum("label").alias("t"), (F.count(F.lit(1)) - F.sum("label")).alias("c"))
    lift = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    counts = counts.withColumn("lift", lift).filter((F.col("t") >= max(3, MIN_SUPPORT * toxic)) & (F.col("lift") >= MIN_LIFT))
    counts = counts.filter(F.length("term") >= 4)
    return counts.orderBy(F.desc(F.col("t") * F.col("lift")), "term").limit(20 * MAX_TERMS).collect()


def lexicon(sample: DataFrame) -> list[Term]:
    """The best terms: telling words, stems of many more telling words, no words that such a stem covers."""
    rows = _candidates(sample)
    words = {r.term: r for r in rows if not r.term.endswith("*")}
    stems: dict[str, Term] = {}
    for row in rows:
        if row.term.endswith("*"):
            text = row.term[:-1]
            own = [w.t for t, w in words.items() if t.startswith(text)]
            # one word's own stems say nothing new; a stem must gather several words
            if row.t > 1.5 * max(own, default=0):
                stems[text] = Term(text, True, row.lift)

    def covered(text: str, lift: float) -> bool:
        above = (stems.get(text[:n]) for n in STEMS if n < len(text))
        return any(t and t.weight >= lift - 0.5 for t in above)

    chosen = []
    for row in rows:
        text = row.term.rstrip("*")
        if row.term.endswith("*"):
            if text in stems and not covered(text, row.lift):
                chosen.append(stems[text])
        elif not covered(text, row.lift):
            chosen.append(Term(text, False, row.lift))
    return chosen[:MAX_TERMS]


def _weighed(sample: DataFrame, terms: list[Term]) -> list[Term]:
    """Terms with the weights of their exact and edited hits in the sample's documents."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(terms)
        for batch in batches:
            rows = [
                (label, term, used) for text, label in zip(batch["text"], batch["label"], strict=True)
                for term, used in {(t, min(u, 1)) for _, t, u in scanner.hits(text)[0]}
            ]
            yield pd.DataFrame(rows, columns=["label", "term", "used"])

    totals = sample.agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals.t, totals.n - totals.t
    hits = sample.mapInPandas(found, "label int, term int, used int")
    counts = {
        (r.term, r.used): (r.t, r.n - r.t)
        for r in hits.groupBy("term", "used").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    }

    def lift(t: int, c: int) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    out = []
    for i, term in enumerate(terms):
        t, c = counts.get((i, 1), (0, 0))
        exact = max(0.0, lift(*counts.get((i, 0), (0, 0))))
        # misspellings that clean documents hardly have are trusted without examples
        near = 0.6 * exact if c <= 0.001 * clean else max(0.0, lift(t, c))
        out.append(dataclasses.replace(term, weight=exact, near=min(near, exact)))
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last column of ``x`` is the constant."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + penalty * beta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, scratch: Scratch | None = None) -> Model:
    """A model of ``labels.toxic``, learnt from labelled rows for which ``usable`` (of doc_id) holds."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    usable = F.lit(True) if usable is None else usable
    sample = training_sample(docs, labels, "toxic", usable, TRAIN_ROWS, scratch)
    terms = lexicon(sample)
    if not terms:
        return Model((), (), (), ())
    terms = _weighed(sample, terms)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(terms)
        for batch in batches:
            rows = [scanner.features(t) for t in batch["text"]]
            yield pd.DataFrame({"x": rows, "label": batch["label"]})

    rows = sample.mapInPandas(features, "x array<double>, label int").collect()  # the bounded sample
    x, y = np.array([r.x for r in rows]), np.array([float(r.label) for r in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    coef = _fit(np.c_[(x - mean) / scale, np.ones(len(x))], y)
    return Model(tuple(terms), tuple(mean), tuple(scale), tuple(coef))


def toxicity(model: Model) -> callable:
    """A column function: text -> probability that it is toxic."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(list(model.terms))
        for texts in batches:
            x = np.array([scanner.features(t or "") for t in listed(texts)]).reshape(len(texts), -1)
            yield pa.array(model.probability(x))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(scores)(batches)

    return score


def reject_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``limit`` or more; same columns."""
    return docs.filter(toxicity(model)(F.col("text").cast("string")) < limit)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs, table(spark, folder, "labels"), remainder != 0)
    scored = docs.select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
        toxicity(model)(F.col("text").cast("string")).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
