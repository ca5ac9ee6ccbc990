"""Mixing sources to target weights: tokens per source, repetition rates, repeated emission.

Sizes are words. The total of the mix is shared out by weight; a source never gets more than
``CAP`` times its own size, and what it can't take is shared again by weight among the others
until no source is above (the water level that this reaches is computed in closed form). The rate
of a source is its target over its size. Each document is emitted ``floor(rate)`` times, plus one
time if the hash of its identity, as a number from 0 to 1, is below the fraction of the rate.
The draw depends on the document alone: reruns, retries and other partitionings agree.

Defined cases: null text has size 0; a null source is a source of its own and comes last; sources
without words get target 0 and rate 0; repeated rows draw alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.llm.common import table, word_count
from graphproof.session import Scratch

#: Weights by the rank of the source in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's words over all words, in halves (3 halves: 150 %), and the most that a source repeats.
SHARE_HALVES = 3
CAP = 2
SEED = "mix-1"


def source_plan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    The sums combine on the map side, so a source with a third of all rows costs no more than
    others. The windows run over one row per source.
    """
    sizes = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("s"))
    weights = ", ".join(f"{w}D" for w in WEIGHTS)
    plan = docs.sparkSession.sql(f"""
        WITH ranked AS (
          SELECT source, s, array({weights})[CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} AS INT)] AS w
          FROM {{sources}}),
        filled AS (
          SELECT *, sum(s) OVER () AS total_s, sum(w) OVER () AS total_w,
                 coalesce(sum(s) OVER earlier, 0) AS before_s, coalesce(sum(w) OVER earlier, 0D) AS before_w
          FROM ranked
          WINDOW earlier AS (ORDER BY s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        capped AS (
          SELECT *, {2 * CAP} * s * (total_w - before_w) < w * ({SHARE_HALVES} * total_s - {2 * CAP} * before_s) AS full
          FROM filled),
        level AS (
          SELECT *, coalesce(sum(if(full, s, 0)) OVER (), 0) AS full_s, coalesce(sum(if(full, w, 0D)) OVER (), 0D) AS full_w
          FROM capped)
        SELECT source, s AS source_size,
               CASE WHEN full OR s = 0 THEN {CAP}D * s
                    ELSE w * ({SHARE_HALVES} * total_s - {2 * CAP} * full_s) / (2 * (total_w - full_w)) END AS target
        FROM level""", sources=sources)
    plan = plan.withColumn("rate", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size")))
    return scratch.write(plan, "source_plan")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the hash of the document's identity."""
    key = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{SEED}")))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(doc_id: Column, rate: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id) < rate - whole, 1).otherwise(0)).cast("long")


def with_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with the plan of its source and ``_llm_copies``, how often the mix takes the row."""
    plan = source_plan(docs, scratch).select(
        F.col("source").alias("_llm_source"), F.col("source_size").alias("_llm_source_size"),
        F.col("target").alias("_llm_target"), F.col("rate").alias("_llm_rate"),
    )
    joined = docs.join(plan, docs["source"].cast("string").eqNullSafe(plan["_llm_source"]), "left")
    return joined.withColumn("_llm_copies", copies(F.col("doc_id"), F.col("_llm_rate")))


def mix(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it; same columns."""
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    names = [F.col(f"`{c}`") for c in docs.columns]
    taken = with_copies(docs, scratch).filter("_llm_copies > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("_llm_copies").cast("int"))).alias("_llm_copy")).select(*names)


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    rows = with_copies(docs, Scratch(spark, "mix")).withColumn("size", word_count(F.col("text")))
    return rows.select(
        "doc_id", "size", F.col("_llm_source_size").alias("source_size"), F.col("_llm_target").alias("target"),
        (F.col("size") * F.col("_llm_copies")).alias("taken"),
    )


OP6_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (
  SELECT source, s, CAST([{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w FROM sources),
filled AS (
  SELECT *, sum(s) OVER () AS total_s, sum(w) OVER () AS total_w,
         coalesce(sum(s) OVER earlier, 0) AS before_s, coalesce(sum(w) OVER earlier, 0) AS before_w
  FROM ranked WINDOW earlier AS (ORDER BY s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT *, {2 * CAP} * s * (total_w - before_w) < w * ({SHARE_HALVES} * total_s - {2 * CAP} * before_s) AS is_full FROM filled),
level AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN s ELSE 0 END) OVER (), 0) AS full_s,
         coalesce(sum(CASE WHEN is_full THEN w ELSE 0 END) OVER (), 0) AS full_w FROM capped),
plan AS (
  SELECT source, s AS source_size,
         CASE WHEN is_full OR s = 0 THEN CAST({CAP} AS DOUBLE) * s
              ELSE w * CAST({SHARE_HALVES} * total_s - {2 * CAP} * full_s AS DOUBLE) / (2 * (total_w - full_w)) END AS target
  FROM level),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52} AS u
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""
