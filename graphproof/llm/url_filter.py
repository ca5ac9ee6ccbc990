"""URL filters: all wildcard rules at once, in a bit-parallel Shift-And automaton over many words.

1. A url becomes host (lower-cased A-Z) and path in SQL. The automaton reads the canonical form
   ``.`` + host + path, byte by byte.
2. Each pattern takes one bit per position. Reading byte ``c`` turns the set ``D`` of reached positions into
   ``((D << 1) & MOVE[c]) | (D & STAY[c])``: MOVE has the positions that ``c`` leads to, STAY the positions
   with a wildcard that takes ``c``. Patterns lie one after another in a row of 64-bit words; the first position
   of a pattern is in no MOVE mask, so nothing shifts from one pattern into the next.
3. All urls of a batch step together. The pattern with the longest rule among those accepted decides; where no
   rule fits, the glob patterns do.

The tables are built from the rules, never from the data, and have a fixed bound (``MOST_BITS``: 16 MB). Only
the key and the url are read; there is no shuffle.

Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one byte other than ``/``, ``\\`` takes the next
character as it is. Hosts are matched from a dot on, so ``*.ads-**`` is a label that starts with ``ads-``.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
globs as the text ``.``; a null key stays null; repeated rows are judged one by one; of rules that are equally
long the first given wins; an empty table gives no rows; urls of any length are read to their end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import table

ALLOW, BLOCK = "allow", "block"
#: Wildcard tokens beside the bytes 0 to 255.
ONE, RUN, REST = 256, 257, 258
SLASH = ord("/")
#: Positions of all patterns together, at most.
MOST_BITS = 1 << 18
#: Bytes of position sets that are held at once; longer batches are cut into pieces.
SET_BYTES = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, all its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[int]:
        return [RUN, ord("."), *self.host.encode(), *self.path.encode(), REST]


#: The rules of op13.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)
#: Host labels of advertising and spam; they block where no rule fits, all else is allowed.
BLOCKED_GLOBS = ("*.adult-**", "*.ads-**", "*.casino-**", "*.cheap-**", "*.free-bets**", "*.spam-**")


def glob_tokens(pattern: str) -> list[int]:
    """The tokens of a glob pattern."""
    out, data, i = [], pattern.encode(), 0
    while i < len(data):
        if data[i : i + 2] == b"**":
            out.append(REST)
            i += 1
        elif data[i] == ord("*"):
            out.append(RUN)
        elif data[i] == ord("?"):
            out.append(ONE)
        else:
            i += data[i] == ord("\\") and i + 1 < len(data)
            out.append(data[i])
        i += 1
    return out


class Automaton:
    """Shift-And masks of several patterns."""

    def __init__(self, patterns: Sequence[Sequence[int]]):
        sizes = [1 + sum(t <= ONE for t in p) for p in patterns]
        if sum(sizes) > MOST_BITS:
            raise ValueError(f"the patterns take {sum(sizes)} positions, more than {MOST_BITS}")
        words = max(1, -(-sum(sizes) // 64))
        self.move, self.stay = np.zeros((2, 256, words), np.uint64)
        self.start, self.absorbing = np.zeros((2, words), np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        no_slash = np.arange(256) != SLASH
        base = 0
        for pattern, size in zip(patterns, sizes, strict=True):
            at = base
            self.start[at // 64] |= self._bit(at)
            for token in pattern:
                if token in (RUN, REST):
                    self.stay[no_slash if token == RUN else slice(None), at // 64] |= self._bit(at)
                else:
                    at += 1
                    self.move[no_slash if token == ONE else token, at // 64] |= self._bit(at)
            if pattern and pattern[-1] == REST:
                self.absorbing[at // 64] |= self._bit(at)
            self.accept.append((at // 64, self._bit(at)))
            base += size

    @staticmethod
    def _bit(at: int) -> np.uint64:
        return np.uint64(1) << np.uint64(at % 64)

    def scan(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Reached positions (texts x words) at the end of each text ``data[begin : begin + length]``."""
        order = np.argsort(-length, kind="stable")
        begin, falling = begin[order], -length[order]
        reached = np.tile(self.start, (len(order), 1))
        for step in range(int(-falling[0]) if len(order) else 0):
            active = int(np.searchsorted(falling, -step))  # texts longer than ``step``
            now = reached[:active]
            if step % 32 == 31 and not (now & ~self.absorbing).any():
                break  # accepted patterns stay so, all others are out
            read = data[begin[:active] + step]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            reached[:active] = (shifted & self.move[read]) | (now & self.stay[read])
        out = np.empty_like(reached)
        out[order] = reached
        return out

    def first_accepted(self, texts: pa.Array, among: Sequence[Sequence[int]]) -> list[np.ndarray]:
        """Per list of pattern numbers, and per text: the place in that list of the first pattern that accepts, or -1."""
        texts = pa.array(texts, pa.binary())
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        piece = max(1, SET_BYTES // (8 * len(self.start)))
        found = [np.full(len(texts), -1, np.int64) for _ in among]
        for a in range(0, len(texts), piece):
            b = min(len(texts), a + piece)
            reached = self.scan(data, offsets[a:b], np.diff(offsets[a : b + 1]))
            for out, patterns in zip(found, among, strict=True):
                for place, pattern in reversed(list(enumerate(patterns))):
                    word, bit = self.accept[pattern]
                    out[a:b][(reached[:, word] & bit) != 0] = place
        return found


def canonical(url) -> tuple:
    """(host, path) expressions of a url."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), UPPER, LOWER), part(2)


def judge_urls(
    pages: DataFrame, key: str = "page_id", rules: Sequence[Rule] = RULES, blocked: Sequence[str] = BLOCKED_GLOBS
) -> DataFrame:
    """``key, host, path, rule, glob, verdict`` of every row of ``pages`` (``key``, url); ``glob`` is the first pattern of
    ``blocked`` that takes the url, looked up for every row; it decides only where no rule fits."""
    if any(not rule.path.startswith("/") for rule in rules):
        raise ValueError("the path of a rule starts with /")
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([r.tokens() for r in ranked] + [glob_tokens(g) for g in blocked])
    among = (range(len(ranked)), range(len(ranked), len(ranked) + len(blocked)))
    # one entry more, for -1
    names = pa.array([r.name for r in ranked] + [None], pa.string())
    verdicts = pa.array([r.verdict for r in ranked] + [None], pa.string())
    globs = pa.array([*blocked, None], pa.string())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, glob = automaton.first_accepted(batch.column("whole").cast(pa.binary()), among)
            glob = pa.array(np.where(glob < 0, len(blocked), glob))
            rule = pa.array(np.where(rule < 0, len(ranked), rule))
            otherwise = pa.array(np.where(globs.take(glob).is_null().to_numpy(zero_copy_only=False), ALLOW, BLOCK), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (key, "host", "path")), names.take(rule), globs.take(glob), verdicts.take(rule).fill_null(otherwise)],
                [key, "host", "path", "rule", "glob", "verdict"],
            )

    host, path = canonical(F.col("url"))
    parts = pages.select(key, host.alias("host"), path.alias("path"))
    kind = parts.schema[key].dataType.simpleString()
    parts = parts.withColumn("whole", F.concat(F.lit("."), "host", "path"))
    return parts.mapInArrow(judged, f"`{key}` {kind}, host string, path string, rule string, glob string, verdict string")


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || host, '[.](adult-|ads-|casino-|cheap-|free-bets|spam-)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
