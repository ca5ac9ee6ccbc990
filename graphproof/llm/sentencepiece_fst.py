"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled once: the normaliser (dummy prefix, white space to U+2581, extra white
space), one arc path per piece, and byte arcs for characters without a piece. An input is composed with it to a
lattice of (position, last arc) states, and its segmentation is the shortest path in the tropical
semiring.

For a model of merges, arc weights are on pairs of neighbouring arcs: 0 where the merges
leave the two pieces side by side, infinite where they would have joined other symbols first. A
segmentation all of whose neighbours are at weight 0 is the one that the merges produce, so just
one path is finite. For a unigram model an arc weighs its negative score and pairs weigh nothing.

Two neighbouring characters that are neighbours in no piece of a merge model are a cut that no path
crosses, so paths are searched between cuts; workers keep found paths of words and of the stretches
between cuts, packed, in memos of bounded size. Texts are taken whole.

Defined cases: null and empty texts have no pieces and decode to the empty text; repeated rows
repeat; columns of the input named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphproof.llm.common import lean, table

SPACE = "▁"
#: Words and stretches that a worker remembers in the newer half of a memo before the older one goes, and pairs at most.
MEMO, PAIRS = 250_000, 500_000
#: Characters that are encoded before a batch of rows is handed on.
BATCH_CHARS = 4_000_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
_UNIGRAM, _MERGES = 1, 2
_INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class _Memo(dict):
    """Results of a function; when the newer half is full the older one goes. Long keys aren't kept."""

    def __init__(self, function: Callable[[str], bytes], half: int):
        self.function, self.half = function, half
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.function(key)
            if len(key) > 100:
                return found
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Transducer:
    """The compiled model; made once per task from the content of the model file. Paths are packed 32-bit ids."""

    def __init__(self, model: bytes, memo: int = MEMO):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, _NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2):
            raise ValueError("models with a character map of their own are not supported")
        self.merges = trainer.get(3, _UNIGRAM) == _MERGES
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.arcs = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (_NORMAL, _USER)}
        self.scores = [s for _, s, _ in self.pieces]
        self.longest = max(map(len, self.arcs), default=1)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == _BYTE}
        self.unknown = next((i for i, (*_, kind) in enumerate(self.pieces) if kind == _UNKNOWN), 0)
        self.unknown_cost = 10.0 - min((s for _, s, kind in self.pieces if kind == _NORMAL), default=0.0)
        cut = self.merges and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.arcs)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cut else "(?s:.+)")
        self.texts = [
            bytes([int(p[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else p.replace(SPACE, " ").encode()
            for p, _, kind in self.pieces
        ]
        if self.pieces:
            self.texts[self.unknown] = " ⁇ ".encode()
        # arcs as a tree: character -> next node; at 0, the id of the piece that ends there
        self.tree: dict = {}
        for p, i in self.arcs.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[0] = i
        self.neighbours = {p[k : k + 2] for p in self.arcs for k in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.paths = _Memo(self._path, memo)
        self.stretches = _Memo(self._finite_path, memo)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (" " * self.dummy_prefix + text).replace(" ", SPACE)

    def _merged(self, text: str) -> list[str]:
        """The symbols that the merges make of a short text: best score first, leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = -_INF, -1
            for i in range(len(symbols) - 1):
                piece = self.arcs.get(symbols[i] + symbols[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether the pair's weight is 0; ``left`` -1 stands for the beginning."""
        b = self.pieces[right][0]
        if left < 0:
            found = self._merged(b) == [b]
        else:
            a = self.pieces[left][0]
            found = self._merged(a + b) == [a, b]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = found
        return found

    def _path(self, word: str) -> bytes:
        """The path of a word, put together from those of its stretches."""
        if not self.merges:
            return self._least_path(word)
        joined, start = self.neighbours, 0
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        if not cuts:
            return self._finite_path(word)
        out = []
        for cut in [*cuts, len(word)]:
            out.append(self.stretches[word[start:cut]])
            start = cut
        return b"".join(out)

    def _finite_path(self, word: str) -> bytes:
        """Shortest path of a merge model: each position has one last arc on a finite path."""
        n = len(word)
        last: list[int | None] = [None] * (n + 1)  # -1: begin, or a character by bytes, which merges with nothing
        back = [0] * (n + 1)
        last[0] = -1
        tree, pairs = self.tree, self.pairs
        for start in range(n):
            before = last[start]
            key = before << 32
            node = tree.get(word[start])
            if last[start + 1] is None and (node is None or 0 not in node):
                last[start + 1], back[start + 1] = -1, start
            end = start
            while node is not None:
                end += 1
                if last[end] is None and 0 in node:
                    piece = node[0]
                    free = pairs.get(key | piece)
                    if free is None:
                        free = self._side_by_side(before, piece)
                    if free:
                        last[end], back[end] = piece, start
                if end == n:
                    break
                node = node.get(word[end])
        out: list[int] = []
        while n:
            if last[n] == -1:
                out += self._by_bytes(word[n - 1])[::-1]
            else:
                out.append(last[n])
            n = back[n]
        return struct.pack(f"={len(out)}i", *out[::-1])

    def _least_path(self, word: str) -> bytes:
        """Shortest path of a unigram model."""
        n = len(word)
        best, back = [0.0] + [_INF] * n, [(0, -1)] * (n + 1)
        for start in range(n):
            for end in range(start + 1, min(n, start + self.longest) + 1):
                piece = self.arcs.get(word[start:end])
                if piece is not None and best[start] - self.scores[piece] < best[end]:
                    best[end], back[end] = best[start] - self.scores[piece], (start, piece)
            if word[start] not in self.arcs and best[start] + self.unknown_cost < best[start + 1]:
                best[start + 1], back[start + 1] = best[start] + self.unknown_cost, (start, -1)
        out: list[int] = []
        while n:
            start, piece = back[n]
            out += [piece] if piece >= 0 else self._by_bytes(word[start])[::-1]
            n = start
        return struct.pack(f"={len(out)}i", *out[::-1])

    def _by_bytes(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "replace")
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]

    def encode(self, text: str | None) -> np.ndarray:
        words = self.parts.findall(self.normalise(text or ""))
        return np.frombuffer(b"".join(map(self.paths.__getitem__, words)), np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        raw = b"".join(map(self.texts.__getitem__, ids if isinstance(ids, list) else ids.tolist()))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _read(model_file: str) -> bytes:
    with open(model_file, "rb") as f:  # an installed file, read by the driver only
        return f.read()


def _appended(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in docs.schema.fields if f.name not in names] + list(fields))


def encode_decode(docs: DataFrame, model_file: str, memo: int = MEMO) -> DataFrame:
    """``docs`` with ``piece_ids`` of the text and ``decoded``, the text that the pieces give back.

    A smaller ``memo`` takes less memory of a worker and more of its time; the pieces are the same.
    """
    content = _read(model_file)
    schema = _appended(docs, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()))
    names = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(content, memo)

        def encoded(rows: pa.RecordBatch, ids: list, texts: list) -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0] + [len(x) for x in ids]), pa.int32())
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            columns = [rows.column(n) for n in names]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(offsets, values), pa.array(texts, pa.string())],
                [*names, "piece_ids", "decoded"],
            )

        for batch in batches:
            start, chars, ids, texts = 0, 0, [], []
            for i, text in enumerate(batch.column("text")):
                ids.append(transducer.encode(text.as_py()))
                texts.append(transducer.decode(ids[-1]))
                chars += len(texts[-1])
                if chars > BATCH_CHARS:
                    yield encoded(batch.slice(start, len(ids)), ids, texts)
                    start, chars, ids, texts = i + 1, 0, [], []
            if ids:
                yield encoded(batch.slice(start, len(ids)), ids, texts)
        # the worker is kept for later tasks; methods that memos hold make a cycle, so the memos are cleared by hand
        for kept in (transducer.paths, transducer.stretches):
            kept.clear()
            kept.older.clear()
        transducer.pairs.clear()

    return docs.mapInArrow(lean(run), schema)


def decode_pieces(frame: DataFrame, model_file: str, ids: str = "piece_ids") -> DataFrame:
    """``frame`` with ``decoded``, the text of the piece ids in column ``ids`` (null: empty)."""
    content = _read(model_file)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transducer = Transducer(content)
        for column in batches:
            yield column.map(lambda x: transducer.decode([int(i) for i in x] if x is not None else []))

    return frame.withColumn("decoded", decode(F.col(ids)))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_pieces, a hash of the piece ids, and whether they decode to the text again."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
