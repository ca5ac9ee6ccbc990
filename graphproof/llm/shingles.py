"""Word shingles as 64-bit hashes, for whole batches of texts at once.

Words are runs of bytes other than white space (U+0020, U+0009 to U+000D), A-Z in lower case. A word's
hash is a sum of table values chosen by byte and position (tabulation hashing), a shingle's hash
mixes those of its words. Equal words have equal hashes; different ones agree with chance 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
#: Bytes of text of a chunk; a longer text is one chunk of its own.
CHUNK_BYTES = 2_000_000
#: Bytes whose shingles are made at once; arrays of 8 bytes for each of them are short-lived.
HASHED_BYTES = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits each depend on all input bits."""
    x = np.asarray(x, U64)
    if not x.ndim:
        return mix(x[None])[0]
    # two arrays for all steps
    high = x >> U64(30)
    out = x ^ high
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= np.right_shift(out, U64(27), out=high)
    out *= U64(0x94D049BB133111EB)
    out ^= np.right_shift(out, U64(31), out=high)
    return out


_POSITIONS = 64
_TABLE = mix(np.arange(1, _POSITIONS * 256 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in order, and the number of words of each text."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, U64), counts
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    position = np.arange(offsets[-1] + lengths[-1]) - np.repeat(offsets, lengths)
    values = _TABLE[(position % _POSITIONS) * 256 + buf[inside]]
    if lengths.max() > _POSITIONS:
        values *= (2 * (position // _POSITIONS) + 1).astype(U64)
    return mix(np.add.reduceat(values, offsets) + lengths.astype(U64) * U64(0xD1342543DE82EF95)), counts


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer than ``words`` words, but at least one, has its whole sequence as its only shingle.
    """
    out, run, size = [], [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size > HASHED_BYTES:
            out += _shingle_sets(run, words)
            run, size = [], 0
    return out + _shingle_sets(run, words) if run else out


def _shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    factors = mix(np.arange(101, 101 + words, dtype=U64)) | U64(1)
    total = np.zeros(len(hashes), U64)
    for k in range(min(words, len(hashes))):
        total[: len(hashes) - k] += mix(hashes[k:] + U64(k)) * factors[k]
    total = mix(total + U64(words))
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(total[at : at + n - words + 1]))
        elif n:
            short = mix(hashes[at : at + n] + np.arange(n, dtype=U64)) * factors[:n]
            out.append(mix(np.add.reduce(short, keepdims=True) + U64(n)))
        else:
            out.append(np.zeros(0, U64))
        at += n
    return out


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of encoded texts (null: empty) of bounded total size, with the index of the first."""
    run, size, start = [], 0, 0
    for i, text in enumerate(texts):
        run.append((text or "").encode("utf-8", "replace"))
        size += len(run[-1])
        if size > CHUNK_BYTES:
            yield start, run
            run, size, start = [], 0, i + 1
    if run:
        yield start, run
