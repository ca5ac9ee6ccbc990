"""Token counts against the library on whole texts."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphproof.llm import token_counts
from graphproof.session import Scratch

FILE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "Wor", "d's", "'ll", " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", "\x1c", "\x85", "é", "漢字", "😀", "12", "3.5", "!!", "<|endoftext|>", "<|end", "_"]


def library(texts):
    t = Tokenizer.from_file(FILE)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunks_sum_to_the_library_count():
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(30))) for _ in range(4000)]
    counter = token_counts.ChunkCounter(open(FILE).read())
    assert counter.count(texts) == library(texts)


def test_counts_and_cache(spark, monkeypatch):
    texts = [None, "", "one two", "one two", "x " * 600, "long " * 40_000, "a<|endoftext|>b", "\n\n  x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two"), (2, "one two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit(2))
    cache = Scratch(spark, "test").path + "/cache"
    out = token_counts.count_tokens(frame, FILE, cache).collect()
    want = library([t or "" for _, t in rows])
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), n) for (i, _), n in zip(rows, want, strict=True))
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in rows})
    more = frame.union(spark.createDataFrame([(50, "brand new", 1, 1)], frame.schema))
    assert token_counts.count_tokens(more, FILE, cache).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_counts.count_tokens(frame.limit(0), FILE, cache).count() == 0
