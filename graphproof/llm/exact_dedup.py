"""Exact dedup: stateful streaming over digests, with full bytes compared on every hit.

1. Each row's text (null: empty; white-space runs become one space) is hashed; the narrow rows
   (digest, doc_id, content locator) are written to the inbox of the state.
2. A streaming aggregation reads the inbox and keeps, per digest and without expiry, the stable
   identifier (smallest doc_id), the content locator and the count, in a RocksDB store on disk
   with its checkpoint in the shared folder. Rows of a batch combine on the map side first, so a
   group with a third of all rows reaches the store as one row per task. The state outlives the
   run: later documents are absorbed into the same state and find earlier keepers.
3. Rows whose digest occurs more than once are hits. Their texts are fetched at their locators and
   compared byte for byte with the keeper's. Rows that differ from it despite the digest form
   classes of their own by full text.

Defined cases: of rows with the same doc_id and text exactly one stays (the one with the smallest
locator); a null doc_id counts as larger than any other; empty and null texts are one group; an
empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import fetch_texts, located, single_spaced, table, within
from graphproof.session import Scratch

_INBOX = "digest string, doc_id long, _llm_file string, _llm_row long"
_PLACE = ["_llm_file", "_llm_row"]
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def digest_rows(docs: DataFrame) -> DataFrame:
    """digest, doc_id and locator of each row of located documents."""
    return docs.select(
        F.sha2(single_spaced(F.col("text")).cast("binary"), 256).alias("digest"),
        F.col("doc_id").cast("long").alias("doc_id"), *_PLACE,
    )


def _first() -> Column:
    """The smallest (doc_id, locator); null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *_PLACE))


class DedupState:
    """Keyed state on disk: digest -> smallest doc_id, its content locator, number of rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.inbox, self.checkpoint = f"{folder}/inbox", f"{folder}/state"

    def absorb(self, rows: DataFrame) -> DataFrame:
        """Add rows (as of ``digest_rows``) to the state; returns them, read from the inbox."""
        batch = f"{self.inbox}/batch={uuid.uuid4().hex}"
        rows.write.parquet(batch)
        with _set(self.spark, _STORE):
            arrived = self.spark.readStream.schema(_INBOX).parquet(f"{self.inbox}/*")
            kept = arrived.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _first().alias("first"))
            query = (
                kept.writeStream.format("noop").outputMode("update")
                .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            )
            query.awaitTermination()
        return self.spark.read.schema(_INBOX).parquet(batch)

    def read(self) -> DataFrame:
        """digest, n, keep_id, keep_file, keep_row of every digest ever absorbed."""
        with _set(self.spark, _STORE):
            state = self.spark.read.format("statestore").load(self.checkpoint)
        # the store names the aggregates itself; their order is that of absorb()
        names = state.schema["value"].dataType.fieldNames()
        value = [F.col("value")[n] for n in names][-2:]
        return state.select(
            F.col("key")["digest"].alias("digest"), value[0].alias("n"), value[1]["doc_id"].alias("keep_id"),
            value[1]["_llm_file"].alias("keep_file"), value[1]["_llm_row"].alias("keep_row"),
        )


@contextlib.contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _checked(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with ``same``: whether the row's full text equals that of its digest's keeper.

    ``other`` is the text where it differs. The keeper side has one row per digest; the
    copies' side may be crowded and is split by adaptive execution.
    """
    texts = fetch_texts(docs, hits).withColumn("text", single_spaced(F.col("text")))
    keepers = texts.filter("_llm_file = keep_file AND _llm_row = keep_row").select("digest", F.col("text").alias("keep_text"))
    both = texts.join(keepers, "digest", "left")
    same = F.col("text") == F.col("keep_text")
    return both.select("digest", "doc_id", *_PLACE, same.alias("same"), F.when(~same, F.col("text")).alias("other"))


def exact_groups(docs: DataFrame, scratch: Scratch | None = None, state: DedupState | None = None) -> DataFrame:
    """One row per document: doc_id, locator, digest, keep_id, keep_file, keep_row, group_size, kept.

    With a ``state`` of earlier runs, keepers and counts cover the earlier documents too; the
    locators of those must still be readable for the byte check, so the documents given must then
    include them, or be of the same folder.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact-dedup")
    if "_llm_file" not in docs.columns:
        docs = located(docs, scratch)
    state = state or DedupState(docs.sparkSession, f"{scratch.path}/dedup")
    rows = state.absorb(digest_rows(docs))
    digests = scratch.write(state.read(), "digests")

    repeated = digests.filter("n > 1")
    hits = within(rows, ["digest"], repeated).join(repeated.drop("n"), "digest")
    hits = scratch.write(hits, "hits")
    checked = scratch.write(_checked(docs, hits), "checked")

    # digests that two texts share: their rows are grouped again by the text itself
    mixed = checked.filter("NOT same").select("digest").distinct()
    mixed = checked.join(mixed, "digest", "left_semi").withColumn("other", F.coalesce("other", F.lit("")))
    classes = mixed.groupBy("digest", "same", "other").agg(F.count(F.lit(1)).alias("n"), _first().alias("first"))
    mended = mixed.join(classes, ["digest", "same", "other"]).select(
        *_PLACE, F.col("n").alias("own_n"), F.col("first").alias("own_first"),
    )

    found = rows.join(digests, "digest").join(mended, _PLACE, "left")
    own = F.col("own_n").isNotNull()
    keep = {
        "keep_id": F.when(own, F.col("own_first")["doc_id"]).otherwise(F.col("keep_id")),
        "keep_file": F.when(own, F.col("own_first")["_llm_file"]).otherwise(F.col("keep_file")),
        "keep_row": F.when(own, F.col("own_first")["_llm_row"]).otherwise(F.col("keep_row")),
    }
    return found.select(
        "doc_id", *_PLACE, "digest", *(v.alias(k) for k, v in keep.items()),
        F.coalesce("own_n", "n").cast("long").alias("group_size"),
    ).withColumn("kept", F.expr("_llm_file = keep_file AND _llm_row = keep_row"))


def exact_dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without later copies; same columns."""
    scratch = scratch or Scratch(docs.sparkSession, "exact-dedup")
    names = [F.col(f"`{c}`") for c in docs.columns]
    docs = located(docs, scratch)
    dropped = scratch.write(exact_groups(docs, scratch).filter("NOT kept").select(*_PLACE), "dropped")
    return docs.join(dropped, _PLACE, "left_anti").select(*names)


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_groups(table(spark, folder, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (norm)
"""
