"""Many quotes in one text: all non-overlapping occurrences of each, in one pass over the text.

Plain Python without Spark, for the tasks of :mod:`graphproof.operators.evidence`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np

#: So few distinct quotes are looked for one by one; more share an automaton.
FEW = 8


def _one_by_one(text: str, quotes: Sequence[str]) -> Iterator[tuple[int, int]]:
    for number, quote in enumerate(quotes):
        at = text.find(quote)
        while at >= 0:
            yield number, at
            at = text.find(quote, at + len(quote))


def _together(text: str, quotes: Sequence[str]) -> Iterator[tuple[int, int]]:
    automaton = ahocorasick.Automaton()
    for number, quote in enumerate(quotes):
        automaton.add_word(quote, number)
    automaton.make_automaton()
    free = [0] * len(quotes)  # where the last occurrence of each quote ended
    for last, number in automaton.iter(text):
        at = last + 1 - len(quotes[number])
        if at >= free[number]:
            free[number] = last + 1
            yield number, at


def occurrences(text: str, quotes: Sequence[str]) -> Iterator[tuple[int, int]]:
    """(number of the quote, start) of the non-overlapping occurrences, counted from the left, of distinct non-empty quotes."""
    return _one_by_one(text, quotes) if len(quotes) <= FEW else _together(text, quotes)


class _Quote:
    """What is wanted about one quote, by the lengths of its contexts: an occurrence is looked up once per pair of lengths."""

    def __init__(self):
        self.hits = 0
        self.contexts: dict[tuple[int, int], dict[tuple[str, str], list]] = {}

    def want(self, prefix: str, suffix: str) -> list:
        """[occurrences that fit, start of the first of them]"""
        same_lengths = self.contexts.setdefault((len(prefix), len(suffix)), {})
        return same_lengths.setdefault((prefix, suffix), [0, -1])

    def found(self, text: str, start: int, end: int) -> None:
        self.hits += 1
        for (before, after), tallies in self.contexts.items():
            tally = tallies.get((text[max(0, start - before) : start], text[end : end + after]))
            if tally is not None:
                tally[0] += 1
                if tally[1] < 0:
                    tally[1] = start


def match_quotes(text: str, probes: Sequence[tuple[str, str | None, str | None]]) -> list[tuple[int, int, int]]:
    """(occurrences, those between prefix and suffix, start of the first of these or -1) of each (quote, prefix, suffix)."""
    quotes: dict[str, _Quote] = {}
    tallies = [quotes.setdefault(quote, _Quote()).want(prefix or "", suffix or "") for quote, prefix, suffix in probes]
    names, wanted = list(quotes), list(quotes.values())
    for number, start in occurrences(text, names):
        wanted[number].found(text, start, start + len(names[number]))
    return [(quotes[probe[0]].hits, *tally) for probe, tally in zip(probes, tallies, strict=True)]


class LineIndex:
    """The line of a position, by binary search among the line ends of a text."""

    def __init__(self, text: str):
        self.ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == ord("\n"))

    def before(self, position: int) -> int:
        """Line ends before ``position``."""
        return int(np.searchsorted(self.ends, position))
