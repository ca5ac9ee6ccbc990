"""Token counts with a digest cache.

The cache is a Parquet table: tokenizer version, content digest, tokens. The version is the digest of
the tokenizer's file and the library's version. A run hashes every text, joins the digests with the
cache, and encodes only the texts that are missing, each distinct one once; their counts are
appended to the cache. Counts are those of the ``tokenizers`` library for the whole text; no
normalisation beyond null to empty is made, since any other could change a count.

Encoding: byte-level pre-tokenizers of this family cut before a space that a non-space follows, and
around other white space, so the count of a text is the sum over such chunks. Workers keep the
counts of chunks in a memo of bounded size and give the library only chunks that they don't know.
A text holding an added token's string goes to the library whole, since that string cuts the text first.

Defined cases: null and empty texts have 0 tokens; repeated rows and equal texts are encoded once;
null doc_ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import fetch_texts, located, table
from graphproof.session import Scratch

LIMIT = 512
#: Chunks that a worker's memo holds before it starts anew.
MEMO = 300_000
#: Characters given to the library in one call.
CALL_CHARS = 1_000_000
#: White space of Unicode, as the pre-tokenizer's \s has it.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


class ChunkCounter:
    """Token counts of texts by one tokenizer; made once per task."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[int]:
        counts, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= CALL_CHARS):
                chars += len(texts[end])
                end += 1
            counts += [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts[start:end], add_special_tokens=False)]
            start = end
        return counts

    def count(self, texts: list[str]) -> list[int]:
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        chunks = [[] if i in whole else _CHUNKS.findall(t) for i, t in enumerate(texts)]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        missing = list({c for own in chunks for c in own if c not in memo})
        memo.update(zip(missing, self._library(missing), strict=True))
        own = iter(self._library([texts[i] for i in sorted(whole)]))
        return [next(own) if i in whole else sum(map(memo.__getitem__, cs)) for i, cs in enumerate(chunks)]


def tokenizer_version(content: str) -> str:
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\n{content}".encode()).hexdigest()


def _texts_in(batch: pa.RecordBatch, column: str, chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in runs of bounded length, so that memory doesn't follow text length."""
    texts, start, size = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        text = text.as_py()
        texts.append(text)
        size += len(text)
        if size > chars:
            yield start, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, texts


def count_tokens(docs: DataFrame, tokenizer_file: str, cache: str, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs``; new counts are appended to ``cache``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    docs = located(docs.select("doc_id", "text"), scratch)
    with open(tokenizer_file, encoding="utf-8") as f:  # an installed file, read by the driver only
        content = f.read()
    version = tokenizer_version(content)
    schema = "version string, digest string, n_tokens long"

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("digest"),
        "_llm_file", "_llm_row",
    )
    rows = scratch.write(rows, "digests")
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)  # so that it exists
    known = spark.read.schema(schema).parquet(cache).filter(F.col("version") == version)
    missing = (
        rows.groupBy("digest").agg(F.min(F.struct("_llm_file", "_llm_row")).alias("at"))
        .join(known, "digest", "left_anti").select("digest", "at.*")
    )
    missing = scratch.write(missing, "missing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(content)
        for batch in batches:
            for start, texts in _texts_in(batch, "text"):
                digests = batch.column("digest").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([digests, pa.array(counter.count(texts), pa.int64())], ["digest", "n_tokens"])

    counted = fetch_texts(docs, missing).select("digest", "text").mapInArrow(encode, "digest string, n_tokens long")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # a count that two runs appended at the same time may be there twice
    counts = spark.read.schema(schema).parquet(cache).filter(F.col("version") == version)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    counts = count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), f"{scratch.path}/cache", scratch
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
