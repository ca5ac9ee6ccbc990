"""Piece ids and decoded texts against the library; exact round trips."""

import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from graphproof.llm.sentencepiece_fst import Transducer, _read, decode_pieces, encode_decode

FILE = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the ", "thnd", "ou", "éè", "漢字", "😀", "\n", "\t", "  ", "   ", " ", "<0x0A>", "<s>", "▁", "x" * 40, "123", ".", "***", "ÀÉ", "\xa0", "ﬁ", "Á", "\x00"]


def texts():
    rng = random.Random(8)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(1, 25))) for _ in range(1500)]
    letters = "abcdefghijklmnopqrstuvwxyzABC éü"
    made += ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(1500)]
    return made + ["", " ", "a", "a b", "word " * 30_000, "q" * 20_000, " " * 3_000]


def test_pieces_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=FILE), Transducer(_read(FILE))
    for text in texts():
        ids = own.encode(text).tolist()
        assert ids == library.encode(text), text[:80]
        assert own.decode(ids) == library.decode(ids), text[:80]
        if "▁" not in text:
            assert own.decode(ids) == text


def test_frames(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "long " * 50_000), (5, "x\ny"), (5, "x\ny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("decoded", F.lit(3)).withColumn("other", F.lit("k"))
    out = encode_decode(frame, FILE)
    assert out.columns == ["doc_id", "text", "other", "piece_ids", "decoded"]
    for r in out.collect():
        assert r.decoded == (r.text or "") and r.other == "k"
    assert {r.decoded for r in decode_pieces(out.drop("decoded"), FILE).collect()} == {t or "" for _, t in rows}
    assert encode_decode(frame.limit(0), FILE).count() == 0


def test_real_documents_equal_the_library(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    for r in encode_decode(frame, FILE).collect():
        assert r.piece_ids == library.encode(r.text) and r.decoded == r.text


def test_small_memos_hold_little_and_change_nothing():
    """What a worker remembers is bounded by its memo and packed; the pieces don't depend on it."""
    draw = random.Random(5)
    words = ["".join(draw.choices("aeioulmnrst漢é", k=draw.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=40)) for _ in range(200)]
    large, small = Transducer(_read(FILE)), Transducer(_read(FILE), 50)
    assert all(large.encode(t).tolist() == small.encode(t).tolist() for t in texts)
    for memo in (small.paths, small.stretches):
        assert len(memo) <= 50 and len(memo.older) <= 50
        assert all(isinstance(path, bytes) for path in memo.values())
