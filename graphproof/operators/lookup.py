"""Entity lookup for many needles at once.

Exact matches are an equi-join on normalized keys. Substring matches are found through an
anchor: of the grams of a needle (six letters, three for needles under six, the needle itself
under three) the one that the fewest entities have. Entities are joined with the anchors on the gram
and the full containment is verified on the entity's row, so no needle meets an entity that lacks its
rarest gram. Entity rows are numbered and only their numbers travel with grams and needles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphproof.fixed_values import DEFAULT_LIMIT, MATCH_KINDS
from graphproof.functions.text import lookup_key, lookup_keys
from graphproof.session import Scratch, free_shuffles
from graphproof.skew import lookup_join, within

ENTITY = ["id", "kind", "title", "aliases", "document"]
KEYS = ["id_key", "title_key", "alias_keys", "key_text"]
ROW = ["id", "document"]


def keyed_entities(entities: DataFrame) -> DataFrame:
    """Entities with their keys in comparable form; ``key_text`` holds all of them as lines."""
    return entities.select(
        *ENTITY,
        lookup_key(F.col("id")).alias("id_key"),
        lookup_key(F.col("title")).alias("title_key"),
        lookup_keys(F.col("aliases")).alias("alias_keys"),
    ).withColumn("key_text", F.concat_ws("\n", "id_key", "title_key", "alias_keys"))


def needles_of(lookups: DataFrame) -> DataFrame:
    """Lookups ``(query_id, text)`` with their ``needle``; a blank one matches nothing."""
    return lookups.select("query_id", "text", lookup_key(F.col("text")).alias("needle"))


def match_kind(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in MATCH_KINDS]), rank + 1)


def listed_keys(keyed: DataFrame) -> DataFrame:
    """``(needle, rank, entity columns)``: each distinct key of an entity row once, under its best rank."""
    none = F.array().cast("array<struct<rank:int,needle:string>>")
    listed = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col("id_key").alias("needle"))),
        F.when(
            F.col("title_key") != F.col("id_key"),
            F.array(F.struct(F.lit(1).alias("rank"), F.col("title_key").alias("needle"))),
        ).otherwise(none),
        F.when(
            F.size("alias_keys") > 0,
            F.transform(
                F.array_except(F.array_distinct("alias_keys"), F.array("id_key", "title_key")),
                lambda key: F.struct(F.lit(2).alias("rank"), key.alias("needle")),
            ),
        ).otherwise(none),
    )
    return keyed.select(*ENTITY, F.inline(listed)).select("needle", "rank", *ENTITY)


def exact_matches(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """``(needle, rank, entity columns)`` of the listed keys that equal a needle."""
    wanted = needles.filter(F.col("needle") != "").select("needle").distinct()
    return lookup_join(rows, wanted, ["needle"], spread=ROW, how="inner").select(
        "needle", "rank", *ENTITY
    )


def _grams(text: Column, size: Column) -> Column:
    """All distinct substrings of ``size`` characters (overlapping, found by lookahead)."""
    pattern = F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))"))
    return F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1)))


def _entity_grams(keyed: DataFrame, sizes: list[int]) -> DataFrame:
    """The number of each entity row beside each distinct gram of its keys. Grams that span two
    keys add rows that the containment check drops."""
    grams = F.flatten(F.array(*[_grams(F.col("key_text"), F.lit(size)) for size in sizes]))
    return keyed.select("row", F.explode(grams).alias("gram"))


def _maybe_among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``, dropped before any shuffle; an exact join has to follow."""
    return within(rows, [key], wanted)


def all_matches(keyed: DataFrame, needles: DataFrame, scratch: Scratch) -> DataFrame:
    """``(needle, rank, row, entity columns)`` for every match, exact or by substring.

    ``keyed`` is a written table with numbered rows. Only the numbers travel with grams, and only with those of anchors; the wide row
    is fetched for the pairs that an anchor proposes. A needle has one anchor and a row each gram once, so no pair repeats.
    """
    wanted = scratch.write(
        needles.filter(F.col("needle") != "").select("needle").distinct(), "needles"
    )
    length = F.length("needle")
    size = F.when(length >= 6, F.lit(6)).when(length >= 3, F.lit(3)).otherwise(length)
    sizes = [r[0] for r in wanted.select(size.alias("size")).distinct().collect()] or [1]
    grams = _entity_grams(keyed, sizes)

    options = scratch.write(
        wanted.select(
            "needle", F.explode(_grams(F.col("needle"), size)).alias("gram")
        ),
        "needle_grams",
    )
    # counted on the map side before anything meets the options
    counts = scratch.write(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram_counts")
    common = counts.join(options.select("gram").distinct(), "gram", "left_semi")
    anchors = scratch.write(
        options.join(common, "gram", "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        .select("needle", "best.gram", "best.n")
        .filter(F.col("n") > 0),
        "anchors",
    )
    # most grams are no anchor and stay where they are; the gram rows left are the split side, so their own
    # counts say which grams are crowded
    load = counts.join(anchors.select("gram").distinct(), "gram", "left_semi")
    proposed = lookup_join(
        _maybe_among(grams, anchors, "gram"), anchors.select("gram", "needle"), ["gram"], spread=["row"], how="inner",
        load=load, weight="n",
    )
    # written, or the count of crowded rows would find all of them again
    pairs = scratch.write(proposed.select("needle", "row"), "pairs")
    free_shuffles(scratch.spark)
    met = lookup_join(pairs, keyed, ["row"], spread=["needle"], how="inner").filter(F.contains(F.col("key_text"), F.col("needle")))
    needle = F.col("needle")
    inside = (
        F.contains(F.col("id_key"), needle)
        | F.contains(F.col("title_key"), needle)
        | F.exists("alias_keys", lambda key: F.contains(key, needle))
    )
    rank = (
        F.when(F.col("id_key") == needle, F.lit(0))
        .when(F.col("title_key") == needle, F.lit(1))
        .when(F.array_contains("alias_keys", needle), F.lit(2))
        .when(inside, F.lit(3))
    )
    return (
        met.withColumn("rank", rank)
        .filter(F.col("rank").isNotNull())
        .select("needle", "rank", "row", *ENTITY)
    )


def _best(matches: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` matches per needle in rank order, with their ``position``.

    The limit is applied per (needle, part) first, so a needle that matches a large share of
    all entities is cut down in many tasks before its rows meet.
    """
    order = [F.col("rank"), F.col("id"), F.col("document")]
    part = F.pmod(F.xxhash64(*ROW), F.lit(256))
    within = W.partitionBy("needle", "part").orderBy(*order)
    first = (
        matches.withColumn("part", part)
        .withColumn("position", F.row_number().over(within))
        .filter(F.col("position") <= limit)
    )
    whole = W.partitionBy("needle").orderBy(*order)
    return (
        first.withColumn("position", F.row_number().over(whole))
        .filter(F.col("position") <= limit)
        .drop("part")
    )


def lookup(
    entities: DataFrame,
    lookups: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Ranked matches for lookups ``(query_id, text)``.

    Result: ``query_id, match, rank, position`` and the entity columns. ``position`` counts
    from 1 in the order of rank, id, document; it is null without a ``limit``. Equal needles are
    searched and ranked once.
    """
    scratch = scratch or Scratch(entities.sparkSession, "lookup")
    needles = scratch.write(needles_of(lookups), "asked")
    # the numbers are fixed by being written
    keyed = scratch.write(keyed_entities(entities).withColumn("row", F.monotonically_increasing_id()), "keyed")
    matches = all_matches(keyed, needles, scratch)
    if limit is None:
        unplaced = matches.withColumn("position", F.lit(None).cast("int"))
        ranked = scratch.write(unplaced, "matches")
        scratch.drop("pairs")
    else:  # few are left, and only these are fetched whole
        best = _best(matches.select("needle", "rank", "row", *ROW), limit).drop(*ROW)
        ranked = best.join(keyed.select("row", *ENTITY), "row")
    asked = needles.select("query_id", "needle")
    if limit is None:  # any number of matches per needle
        answered = lookup_join(ranked, asked, ["needle"], spread=ROW, how="inner")
    else:  # any number of queries per needle
        answered = lookup_join(asked, ranked, ["needle"], spread=["query_id"], how="inner")
    return answered.select(
        "query_id", match_kind(F.col("rank")).alias("match"), "rank", "position", *ENTITY
    )
