"""Lookup joins that stay balanced when one key holds a large share of the rows.

Keys are hashed into a fixed number of buckets and the rows per bucket are counted with a
map-side combined aggregate. Only buckets that hold far more than their share are salted:
their lookup rows are copied once per salt and their fact rows are spread over the salts. The
bucket table has at most ``2 * SPLITS`` rows whatever the data size, so broadcasting it is safe.
Copies of the lookup side are bounded as well: over all buckets there are at most
``BUCKETS + SPLITS`` of them, that is 1.25 copies per lookup row on average.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SPLITS = 1024
#: Words of the bounded prefilter, of 64 bits each: at most so many are broadcast, whatever the data size.
FILTER_WORDS = 1 << 18
#: A table of at most so many rows is broadcast by :func:`schema_join`.
FEW_KEYS = 2048


def _names(columns: list[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _bucket(keys: list[str]) -> str:
    return f"CAST(pmod(xxhash64({_names(keys)}), {BUCKETS}) AS INT) AS hot_bucket"


def hot_buckets(load: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Buckets of ``keys`` that hold over two shares (1/SPLITS) of all rows, with salt counts."""
    amount = f"sum(`{weight}`)" if weight else "count(1)"
    counts = load.groupBy(F.expr(_bucket(keys))).agg(F.expr(f"{amount} AS n"))
    total = counts.agg(F.expr("sum(n) AS total"), F.expr("collect_list(struct(hot_bucket, n)) AS b"))
    return (
        total.selectExpr("total", "inline(b)")
        .filter(f"n * {SPLITS} > total * 2")
        .selectExpr("hot_bucket", f"CAST(ceil(n * {SPLITS} / total) AS INT) AS hot_salts")
    )


def nothing_hot(spark: SparkSession) -> DataFrame:
    """A bucket table for tables that are known to be small."""
    return spark.range(0).selectExpr("CAST(id AS INT) AS hot_bucket", "CAST(id AS INT) AS hot_salts")


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "left",
    load: DataFrame | None = None,
    weight: str | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``fact`` with ``lookup`` on ``on``; hot keys of ``fact`` are split over many tasks.

    ``spread`` names fact columns that differ between rows of one key (the row identity); they
    choose the salt, which keeps the split repeatable when a task is run again. ``load`` may
    name a cheaper table with the same key distribution as ``fact``; ``hot`` a bucket table
    computed before.
    """
    if hot is None:
        hot = hot_buckets(fact if load is None else load, on, weight)
    hot = F.broadcast(hot)

    fact_columns = [f"`{c}`" for c in fact.columns]
    lookup_columns = [f"`{c}`" for c in lookup.columns]
    salted_fact = (
        fact.selectExpr("*", _bucket(on))
        .join(hot, "hot_bucket", "left")
        .selectExpr(
            *fact_columns,
            f"coalesce(CAST(pmod(xxhash64({_names(spread)}), hot_salts) AS INT), 0) AS salt",
        )
    )
    salted_lookup = (
        lookup.selectExpr("*", _bucket(on))
        .join(hot, "hot_bucket", "left")
        .selectExpr(*lookup_columns, "explode(sequence(0, coalesce(hot_salts, 1) - 1)) AS salt")
    )
    return salted_fact.join(salted_lookup, on + ["salt"], how).drop("salt")


def schema_join(fact: DataFrame, lookup: DataFrame, on: list[str], spread: list[str], how: str = "left") -> DataFrame:
    """Join ``fact`` with a part of the schema, which has few keys as a rule.

    Dealt by such a key, nearly all rows of ``fact`` would go to the tasks of a few relations or types. So a
    small part is broadcast (it is counted up to ``FEW_KEYS`` rows) and rows stay where they are; a large one is a lookup like others.
    """
    if lookup.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        return fact.join(F.broadcast(lookup), on, how)
    return lookup_join(fact, lookup, on, spread, how)


def two_sided_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_left: list[str],
    spread_right: list[str],
    hot_left: DataFrame | None = None,
    hot_right: DataFrame | None = None,
) -> DataFrame:
    """Inner join where either side, or both, may crowd on a key.

    A bucket that is crowded on the left has its left rows spread over salts and its right rows copied
    once per salt, and the other way round, so the rows and the matches of a hub go to many tasks.
    A row is copied at most as often as the other side's bucket has shares.
    """
    hot_left = hot_buckets(left, on) if hot_left is None else hot_left
    hot_right = hot_buckets(right, on) if hot_right is None else hot_right
    hot = hot_left.withColumnRenamed("hot_salts", "left_salts").join(
        hot_right.withColumnRenamed("hot_salts", "right_salts"), "hot_bucket", "full"
    )
    hot = F.broadcast(hot)  # at most 2 * SPLITS rows from either side

    def dealt(df: DataFrame, own: str, other: str, spread: list[str]) -> DataFrame:
        columns = [f"`{c}`" for c in df.columns]
        salted = df.selectExpr("*", _bucket(on)).join(hot, "hot_bucket", "left")
        return salted.selectExpr(
            *columns,
            f"coalesce(CAST(pmod(xxhash64({_names(spread)}), {own}_salts) AS INT), 0) AS {own}_salt",
            f"explode(sequence(0, coalesce({other}_salts, 1) - 1)) AS {other}_salt",
        )

    salts = ["left_salt", "right_salt"]
    return dealt(left, "left", "right", spread_left).join(
        dealt(right, "right", "left", spread_right), on + salts
    ).drop(*salts)


def within(df: DataFrame, keys: list[str], wanted: DataFrame, or_if: str | None = None) -> DataFrame:
    """Rows of ``df`` that may have a key of ``wanted``, before any shuffle of wide rows.

    Keys are hashed to one bit of a fixed number of words; the words with a bit of ``wanted`` are broadcast
    (at most FILTER_WORDS). Rows that share only the bit pass too; an exact join follows. Rows for which ``or_if`` holds
    pass as well.
    """
    if or_if is not None:
        return _by_bit(df, keys, wanted, "left").filter(f"coalesce(getbit(_key_bits, _key_bit) = 1, false) OR {or_if}").drop(*_BITS)
    return _by_bit(df, keys, wanted, "inner").filter("getbit(_key_bits, _key_bit) = 1").drop(*_BITS)


def without(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The other rows of ``df``: those that ``within`` leaves out, none of which has a key of ``wanted``."""
    rest = _by_bit(df, keys, wanted, "left")
    return rest.filter("_key_bits IS NULL OR getbit(_key_bits, _key_bit) = 0").drop(*_BITS)


_BITS = ["_key_word", "_key_bit", "_key_bits"]


def _by_bit(df: DataFrame, keys: list[str], wanted: DataFrame, how: str) -> DataFrame:
    spot = F.xxhash64(*keys)
    word = F.pmod(spot, F.lit(FILTER_WORDS)).cast("int").alias("_key_word")
    bit = F.shiftrightunsigned(spot, 58).cast("int").alias("_key_bit")
    bits = wanted.select(word, bit).groupBy("_key_word").agg(F.expr("bit_or(shiftleft(1L, _key_bit))").alias("_key_bits"))
    return df.select("*", word, bit).join(F.broadcast(bits), "_key_word", how)
