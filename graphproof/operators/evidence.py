"""Evidence resolution: find quoted text again in its source.

Selectors and texts meet in groups, and each text is read once for all quotes of its group: an automaton over the quotes gives
the occurrences, an index of line ends their lines. Sources that carry much, by their size or their quotes, have groups of their
own, and a source with very many quotes is dealt into blocks, each with its share of the quotes and the text. Small sources share
groups. So a group holds at most a block of quotes and either one large text or a share of the small ones.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphproof.fixed_values import (
    EVIDENCE_MESSAGES,
    STATE_AMBIGUOUS,
    STATE_INVALID,
    STATE_MISSING,
    STATE_RELOCATED,
    STATE_STALE,
    STATE_VALID,
)
from graphproof.functions.matching import LineIndex, match_quotes
from graphproof.functions.text import is_absolute, leaves_root, newlines, normalize_text, path_key
from graphproof.model import fill
from graphproof.session import Scratch
from graphproof.skew import lookup_join
from graphproof.sources.corpus import folders, searchable

#: Characters and number of the quotes of one block, at most on average.
BLOCK_CHARS, BLOCK_QUOTES = 1 << 20, 1 << 15
#: A source with more bytes (text and quotes) than this has groups of its own; the others share groups of about GROUP_BYTES.
OWN_GROUP_BYTES, GROUP_BYTES = 1 << 20, 1 << 24
SELECTOR_KEY = ["src", "relation", "dst", "declaration", "decl_ordinal", "sel_ordinal"]


def _flat_selectors(selectors: DataFrame) -> DataFrame:
    """Selector fields as columns, normalized, with the fault found before any text is read."""
    source = F.coalesce("selector.source", "declaration")
    hint = F.col("selector.hint")
    flat = selectors.select(
        *SELECTOR_KEY,
        source.alias("source"),
        F.col("selector.exact").alias("exact"),
        normalize_text(F.col("selector.exact")).alias("quote"),
        normalize_text(F.col("selector.prefix")).alias("prefix"),
        normalize_text(F.col("selector.suffix")).alias("suffix"),
        hint.alias("hint"),
    )
    fault = (
        F.when(F.col("exact") == "", F.lit(EVIDENCE_MESSAGES["empty_exact"]))
        .when(
            (F.col("hint.start") == 0) | (F.col("hint.end") < F.col("hint.start")),
            F.lit(EVIDENCE_MESSAGES["bad_hint"]),
        )
        .when(is_absolute(F.col("source")), fill(EVIDENCE_MESSAGES["absolute"], "source"))
        .when(leaves_root(F.col("source")), fill(EVIDENCE_MESSAGES["escape"], "source"))
    )
    return flat.withColumn("fault", fault).withColumn("path_key", path_key(F.col("source")))


def resolve_evidence(selectors: DataFrame, sources: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Resolve every selector against the source texts.

    ``selectors`` has the edge key, ``sel_ordinal`` and the ``selector`` struct; ``sources`` is
    ``(path, content)`` with one row per path. The result has the edge key and ``sel_ordinal``
    with ``state, source, exact, start_line, end_line, message``.
    """
    scratch = scratch or Scratch(selectors.sparkSession, "evidence")
    flat = _flat_selectors(selectors)
    load = selectors.select(
        path_key(F.coalesce("selector.source", "declaration")).alias("path_key")
    )
    keyed = sources.withColumn("path_key", path_key(F.col("path")))
    places = _places(flat, sources, keyed, scratch)
    aimed = lookup_join(flat, places.drop("text_bytes"), on=["path_key"], spread=SELECTOR_KEY, load=load)
    folder_only = F.col("source").rlike(r"/\.?\z")
    usable = F.col("fault").isNull() & F.coalesce(F.col("readable"), F.lit(False)) & ~folder_only
    aimed = aimed.select(
        *SELECTOR_KEY, "source", "exact", "hint", "quote", "prefix", "suffix", "fault", "path_key",
        F.coalesce("is_folder", F.lit(False)).alias("is_folder"),
        (F.col("readable").isNotNull() & ~folder_only).alias("found"),
        F.coalesce("readable", F.lit(False)).alias("readable"),
        usable.alias("usable"),
        # selectors without a text to search go anywhere
        F.when(usable, F.col("pack")).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64(*SELECTOR_KEY), F.lit(1024)))).alias("pack"),
        F.when(usable, F.pmod(F.xxhash64(*SELECTOR_KEY), F.col("blocks"))).otherwise(F.lit(0)).cast("int").alias("block"),
    )
    # Only quoted sources are prepared: the rest is dropped by its key, before its text is normalized.
    wanted = places.filter("readable").select("path_key", "pack", "blocks")
    texts = searchable(keyed.join(wanted.select("path_key"), "path_key", "left_semi")).join(wanted, "path_key")
    texts = texts.select("path_key", "region", "region_line", "pack", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    kept = [f for f in aimed.schema if f.name not in ("quote", "prefix", "suffix", "path_key", "usable", "pack", "block")]
    added = "with_context boolean, hits bigint, fits bigint, start_line bigint, end_line bigint"
    schema = T.StructType([*kept, *T._parse_datatype_string(added).fields])
    group = ["pack", "block"]
    found = aimed.groupBy(*group).cogroup(texts.groupBy(*group)).applyInArrow(_finder([f.name for f in kept]), schema)
    return _judge(found)


def _places(flat: DataFrame, sources: DataFrame, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """What the quoted paths lead to, and how: ``path_key, readable, is_folder, text_bytes, pack, blocks``.

    Two written tables without texts. Folders are looked for only if some path leads to no file.
    """
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("quote", "prefix", "suffix")), F.lit(0))
    asked = flat.filter(F.col("fault").isNull()).groupBy("path_key").agg(F.count(F.lit(1)).alias("quotes"), F.sum(chars).alias("chars"))
    asked = scratch.write(asked, "asked")
    sizes = keyed.select("path_key", F.col("content").isNotNull().alias("readable"), F.coalesce(F.octet_length("content"), F.lit(0)).alias("text_bytes"))
    files = scratch.write(asked.join(sizes, "path_key"), "files")
    weight = F.col("text_bytes") + F.col("chars") + 64 * F.col("quotes")
    files = files.withColumn("own", weight > OWN_GROUP_BYTES)
    shared = files.filter(~F.col("own")).agg(F.sum(weight)).first()[0] or 0
    blocks = F.greatest(F.ceil(F.col("chars") / BLOCK_CHARS), F.ceil(F.col("quotes") / BLOCK_QUOTES), F.lit(1))
    bucket = F.pmod(F.xxhash64("path_key"), F.lit(shared // GROUP_BYTES + 1))
    routed = files.select(
        "path_key", "readable", F.lit(False).alias("is_folder"), "text_bytes",
        F.when(F.col("own"), F.concat(F.lit("/"), "path_key")).otherwise(bucket.cast("string")).alias("pack"),
        F.when(F.col("own"), blocks).otherwise(F.lit(1)).cast("int").alias("blocks"),
    )
    open_keys = asked.select("path_key").join(files.select("path_key"), "path_key", "left_anti")
    open_keys = scratch.write(open_keys, "open")
    if open_keys.isEmpty():
        return routed
    named = folders(sources).join(open_keys, "path_key", "left_semi").withColumn("is_folder", F.lit(True))
    return routed.unionByName(named, allowMissingColumns=True)


def _finder(kept: list[str]):
    """Selectors and texts of one group -> the selectors' kept columns with what was found."""

    def find(selectors: pa.Table, texts: pa.Table) -> pa.Table:
        probes = [selectors.column(c).to_pylist() for c in ("quote", "prefix", "suffix")]
        hits, fits, starts, ends = ([None] * selectors.num_rows for _ in range(4))
        by_path = defaultdict(list)
        for row, (path, usable) in enumerate(zip(selectors.column("path_key").to_pylist(), selectors.column("usable").to_pylist(), strict=True)):
            if usable:
                by_path[path].append(row)
        for path, region, lines_before in zip(*(texts.column(c) for c in ("path_key", "region", "region_line")), strict=True):
            rows = by_path.get(path.as_py())
            if not rows:
                continue
            text, lines = region.as_py(), None
            found = match_quotes(text, [tuple(p[row] for p in probes) for row in rows])
            for row, (n, fitting, start) in zip(rows, found, strict=True):
                hits[row], fits[row] = n, fitting
                if fitting == 1:
                    lines = lines or LineIndex(text)
                    starts[row] = lines_before.as_py() + lines.before(start) + 1
                    ends[row] = starts[row] + probes[0][row].count("\n")
        added = {
            "with_context": pa.array([p is not None or s is not None for p, s in zip(*probes[1:], strict=True)], pa.bool_()),
            "hits": hits, "fits": fits, "start_line": starts, "end_line": ends,
        }
        out = selectors.select(kept)
        for name, values in added.items():
            out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values, pa.int64()))
        return out

    return find


def _judge(found_rows: DataFrame) -> DataFrame:
    found, is_folder, with_context = F.col("found"), F.col("is_folder"), F.col("with_context")
    moved = (F.col("hint.start") != F.col("start_line")) | (
        F.col("hint.end") != F.col("end_line")
    )

    state = (
        F.when(F.col("fault").isNotNull(), F.lit(STATE_INVALID))
        .when(found & ~F.col("readable"), F.lit(STATE_INVALID))
        .when(~found & is_folder, F.lit(STATE_INVALID))
        .when(~found, F.lit(STATE_MISSING))
        .when(F.col("fits") == 0, F.lit(STATE_STALE))
        .when(F.col("fits") > 1, F.lit(STATE_AMBIGUOUS))
        .when(moved, F.lit(STATE_RELOCATED))
        .otherwise(F.lit(STATE_VALID))
    )
    text = {name: F.lit(value) for name, value in EVIDENCE_MESSAGES.items()}
    message = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(found & ~F.col("readable"), text["not_utf8"])
        .when(~found & is_folder, text["directory"])
        .when(~found, text["missing"])
        .when(F.col("hits") == 0, text["gone"])
        .when(F.col("fits") == 0, text["context"])
        .when(
            with_context & (F.col("fits") > 1),
            fill(EVIDENCE_MESSAGES["ambiguous_context"], "fits"),
        )
        .when(F.col("fits") > 1, fill(EVIDENCE_MESSAGES["ambiguous"], "fits"))
        .when(moved, text["relocated"])
    )
    return found_rows.select(
        *SELECTOR_KEY, state.alias("state"), "source", "exact", "start_line", "end_line",
        message.alias("message"),
    )
