"""Graph tables built from a star-schema data set.

The inputs are the Parquet tables region, nation, customer, supplier, part, orders, lineitem,
events, documents and pages. Every builder covers its whole input tables. Faults are
seeded by key arithmetic, which changes rows but never leaves any out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphproof.model import SELECTOR, Graph, GraphSchema
from graphproof.sources.schema import (
    RELATIONS_TABLE,
    SHAPES_TABLE,
    TYPES_TABLE,
    schema_from_tables,
)

KINDS = ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "Event", "Doc", "Source"]

# relation: (from, to, symmetric, acyclic)
RELATIONS = {
    "in_region": (["Nation"], ["Region"], False, True),
    "in_nation": (["Customer", "Supplier"], ["Nation"], False, True),
    "placed_by": (["Order"], ["Customer"], False, False),
    "contains": (["Order"], ["Part"], False, False),
    "supplied_by": (["Part"], ["Supplier"], False, False),
    "peer": (["Supplier"], ["Supplier"], True, False),
    "precedes": (["Nation"], ["Nation"], False, True),
    "follows": (["Event"], ["Event"], False, True),
    "refers": (["Customer"], ["Customer"], False, True),
    "quotes": (["Doc"], ["Source"], False, False),
}

# (type, relation, min, max)
SHAPES = [
    ("Nation", "in_region", 1, 1),
    ("Customer", "in_nation", 1, 1),
    ("Supplier", "in_nation", 1, 1),
    ("Order", "placed_by", 1, None),
    ("Order", "contains", 1, 6),
    ("Part", "supplied_by", None, 40),
]


# The columns that the builders use; stating them saves one footer-reading job per scan.
LAYOUTS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, event_type string",
    "documents": "doc_id bigint, text string, lang string, source string",
    "pages": "page_id bigint, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{folder}/{name}.parquet")


def schema(spark: SparkSession) -> GraphSchema:
    """The declared schema of the data set."""
    return schema_from_tables(
        spark.createDataFrame([(k, None) for k in KINDS], TYPES_TABLE),
        spark.createDataFrame(
            [(name, None, *spec) for name, spec in RELATIONS.items()], RELATIONS_TABLE
        ),
        spark.createDataFrame(SHAPES, SHAPES_TABLE),
    )


def _key(prefix: str, number: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), (F.col(number) if isinstance(number, str) else number))


def _doc(prefix: str, number: str) -> Column:
    return F.concat(F.lit(f"kb/{prefix}/"), F.col(number), F.lit(".md"))


def _entity(df, prefix, number, title=None, aliases=(), kind=None, ident=None) -> DataFrame:
    ident = _key(prefix, number) if ident is None else ident
    listed = F.array(*[F.col(a) for a in aliases]) if aliases else F.array()
    return df.select(
        ident.alias("id"),
        (F.lit(prefix.capitalize()) if kind is None else kind).alias("kind"),
        (ident if title is None else F.col(title)).alias("title"),
        listed.cast("array<string>").alias("aliases"),
        _doc(prefix, number).alias("document"),
    )


def _event_types(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("event_type").distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return _union(frames[:half]).unionByName(_union(frames[half:]))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    return _union(
        [
            _entity(t("region"), "region", "r_regionkey", "r_name"),
            _entity(t("nation"), "nation", "n_nationkey", "n_name"),
            _entity(t("customer"), "customer", "c_custkey", "c_name", ["c_mktsegment"]),
            _entity(t("supplier"), "supplier", "s_suppkey", "s_name"),
            _entity(t("part"), "part", "p_partkey", "p_name", ["p_brand", "p_type"]),
            _entity(t("orders"), "order", "o_orderkey"),
            _entity(_event_types(spark, folder), "event", "event_type", "event_type"),
        ]
    )


def entities_with_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Entities with bad ids, unknown kinds and repeated ids."""
    t = lambda name: table(spark, folder, name)
    number = F.col("p_partkey")
    part_id = F.when(number % 83 == 7, F.concat(F.lit("part "), number)).otherwise(
        _key("part", "p_partkey")
    )
    part_kind = F.when(number % 89 == 11, F.lit("Widget")).otherwise(F.lit("Part"))
    again = t("customer").filter(F.col("c_custkey") % 97 == 5).select(
        _key("customer", "c_custkey").alias("id"),
        F.lit("Supplier").alias("kind"),
        F.col("c_name").alias("title"),
        F.array("c_mktsegment").alias("aliases"),
        _doc("zz", "c_custkey").alias("document"),
    )
    return _union(
        [
            _entity(t("region"), "region", "r_regionkey", "r_name"),
            _entity(t("nation"), "nation", "n_nationkey", "n_name"),
            _entity(t("customer"), "customer", "c_custkey", "c_name", ["c_mktsegment"]),
            again,
            _entity(t("supplier"), "supplier", "s_suppkey", "s_name"),
            _entity(
                t("part"), "part", "p_partkey", "p_name", ["p_brand", "p_type"],
                kind=part_kind, ident=part_id,
            ),
            _entity(t("orders"), "order", "o_orderkey"),
            _entity(_event_types(spark, folder), "event", "event_type", "event_type"),
        ]
    )


def _edge(df, src, relation, dst, declaration, ordinal=None) -> DataFrame:
    return df.select(
        src.alias("src"),
        (F.lit(relation) if isinstance(relation, str) else relation).alias("relation"),
        dst.alias("dst"),
        declaration.alias("declaration"),
        (F.lit(0) if ordinal is None else ordinal).cast("bigint").alias("decl_ordinal"),
        F.array().cast(f"array<{SELECTOR}>").alias("evidence"),
    )


def _line_ordinal(lines: DataFrame) -> Column:
    """A number for each line of an order; only its being distinct matters."""
    return F.xxhash64(*lines.columns)


def _contains(lines: DataFrame) -> DataFrame:
    return _edge(
        lines, _key("order", "l_orderkey"), "contains", _key("part", "l_partkey"),
        _doc("order", "l_orderkey"), _line_ordinal(lines),
    )


def peers(suppliers: DataFrame) -> DataFrame:
    """Each supplier names the next one and is named back."""
    pair = suppliers.select(
        F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b")
    ).join(suppliers.select(F.col("s_suppkey").alias("b")), "b", "left_semi")
    return _edge(
        pair, _key("supplier", "a"), "peer", _key("supplier", "b"), _doc("supplier", "a"), F.lit(1)
    ).unionByName(
        _edge(
            pair, _key("supplier", "b"), "peer", _key("supplier", "a"), _doc("supplier", "b"),
            F.lit(2),
        )
    )


def _precedes(nations: DataFrame) -> DataFrame:
    last = nations.select((F.col("n_nationkey") - 1).alias("n_nationkey"))
    return _edge(
        nations.join(last, "n_nationkey", "left_semi"),
        _key("nation", "n_nationkey"), "precedes", _key("nation", F.col("n_nationkey") + 1),
        _doc("nation", "n_nationkey"), F.lit(1),
    )


def _follows(events: DataFrame) -> DataFrame:
    """Which event type comes right after which other one, by event number."""
    after = events.select(
        (F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("next_type")
    )
    pairs = (
        events.select("event_id", "event_type")
        .join(after, "event_id")
        .filter(F.col("event_type") != F.col("next_type"))
        .select("event_type", "next_type")
        .distinct()
    )
    return _edge(
        pairs, _key("event", "event_type"), "follows", _key("event", "next_type"),
        _doc("event", "event_type"), F.xxhash64("next_type"),
    )


def _refers(customers: DataFrame) -> DataFrame:
    """Each customer k refers to customer (k*k + 1) mod n, a quadratic map with loops and tails."""
    size = customers.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    sized = customers.withColumn("one", F.lit(1)).join(F.broadcast(size), "one")
    target = (F.col("c_custkey") * F.col("c_custkey") + 1) % F.col("n")
    return _edge(
        sized, _key("customer", "c_custkey"), "refers", _key("customer", target),
        _doc("customer", "c_custkey"), F.lit(3),
    )


def caused_by(events: DataFrame) -> DataFrame:
    """Event k was caused by event k div 2: a forest as deep as the logarithm of the table."""
    return _edge(
        events.filter(F.col("event_id") > 0),
        _key("event", "event_id"), "caused_by",
        _key("event", F.floor(F.col("event_id") / 2).cast("bigint")),
        _doc("event", "event_id"),
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    customer, supplier, orders = t("customer"), t("supplier"), t("orders")
    supply = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    return _union(
        [
            _edge(
                t("nation"), _key("nation", "n_nationkey"), "in_region",
                _key("region", "n_regionkey"), _doc("nation", "n_nationkey"),
            ),
            _edge(
                customer, _key("customer", "c_custkey"), "in_nation",
                _key("nation", "c_nationkey"), _doc("customer", "c_custkey"),
            ),
            _edge(
                supplier, _key("supplier", "s_suppkey"), "in_nation",
                _key("nation", "s_nationkey"), _doc("supplier", "s_suppkey"),
            ),
            _edge(
                orders, _key("order", "o_orderkey"), "placed_by",
                _key("customer", "o_custkey"), _doc("order", "o_orderkey"),
            ),
            _contains(t("lineitem")),
            _edge(
                supply, _key("part", "l_partkey"), "supplied_by", _key("supplier", "l_suppkey"),
                _doc("part", "l_partkey"), F.col("l_suppkey"),
            ),
        ]
    )


def cyclic_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the relations declared acyclic, three of them sound and two of them not."""
    t = lambda name: table(spark, folder, name)
    return _union(
        [
            _precedes(t("nation")),
            _follows(t("events")),
            _refers(t("customer")),
            caused_by(t("events")),
        ]
    )


def cycle_schema(spark: SparkSession) -> GraphSchema:
    relations = ["precedes", "follows", "refers", "caused_by", "unused"]
    return schema_from_tables(
        spark.createDataFrame([("Thing", None)], TYPES_TABLE),
        spark.createDataFrame(
            [(r, None, ["*"], ["*"], False, True) for r in relations], RELATIONS_TABLE
        ),
        spark.createDataFrame([], SHAPES_TABLE),
    )


def edges_with_faults(spark: SparkSession, folder: str) -> DataFrame:
    """All edges and peers with dangling ends, unknown relations and wrong kinds."""
    t = lambda name: table(spark, folder, name)
    customer, supplier, orders = t("customer"), t("supplier"), t("orders")
    number = F.col("o_orderkey")
    placed = _edge(
        orders,
        F.when(number % 223 == 4, F.concat(F.lit("order:none-"), number)).otherwise(
            _key("order", "o_orderkey")
        ),
        F.when(number % 227 == 6, F.lit("ships_to")).otherwise(F.lit("placed_by")),
        F.when(number % 211 == 3, F.lit("customer:none")).otherwise(_key("customer", "o_custkey")),
        _doc("order", "o_orderkey"),
    )
    return _union(
        [
            _edge(
                customer, _key("customer", "c_custkey"), "in_nation",
                _key("nation", "c_nationkey"), _doc("customer", "c_custkey"),
            ),
            _edge(
                supplier, _key("supplier", "s_suppkey"), "in_nation",
                F.when(F.col("s_suppkey") % 7 == 2, F.lit("region:0")).otherwise(
                    _key("nation", "s_nationkey")
                ),
                _doc("supplier", "s_suppkey"),
            ),
            _edge(
                t("nation"), _key("region", "n_regionkey"), "in_nation",
                _key("nation", "n_nationkey"), _doc("nation", "n_nationkey"), F.lit(7),
            ),
            _edge(
                t("region"), _key("region", "r_regionkey"), "placed_by", F.lit("region:0"),
                _doc("region", "r_regionkey"),
            ),
            placed,
            _contains(t("lineitem")),
            peers(supplier),
        ]
    )


def graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(entities(spark, folder), edges(spark, folder))


def whole_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph with quoted documents and with the declared acyclic relations, sound and not."""
    t = lambda name: table(spark, folder, name)
    all_entities = entities(spark, folder).unionByName(quote_entities(spark, folder))
    more = _union([_precedes(t("nation")), _follows(t("events")), _refers(t("customer"))])
    all_edges = edges(spark, folder).unionByName(more).unionByName(quote_edges(spark, folder))
    return Graph(all_entities, all_edges)


# ---- schema with faults, one relation per supplier and one shape per customer pair ------------


def derived_schema(spark: SparkSession, folder: str) -> GraphSchema:
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    customer = table(spark, folder, "customer")
    types = nation.select(
        F.when(F.col("n_nationkey") % 6 == 4, F.concat(F.lit("bad "), "n_name"))
        .otherwise(F.col("n_name"))
        .alias("type"),
        F.lit(None).cast("string").alias("description"),
    )
    named = supplier.join(
        nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey"
    )
    key = F.col("s_suppkey")
    other = F.concat(F.lit("NATION_"), (F.col("s_nationkey") + 1) % 25)
    relations = named.select(
        F.when(key % 13 == 5, F.col("s_name")).otherwise(F.concat(F.lit("r"), key)).alias("relation"),
        F.lit(None).cast("string").alias("description"),
        F.when(key % 11 == 0, F.array().cast("array<string>"))
        .when(key % 11 == 1, F.array(F.lit("*")))
        .when(key % 11 == 2, F.array("n_name", other, F.lit("NOWHERE"), F.lit("NOWHERE")))
        .otherwise(F.array("n_name", other))
        .alias("from"),
        F.when(key % 7 == 0, F.array().cast("array<string>"))
        .when(key % 7 == 1, F.array("n_name"))
        .otherwise(F.array(other, F.col("n_name"), other))
        .alias("to"),
        (key % 3 == 0).alias("symmetric"),
        (key % 4 == 0).alias("acyclic"),
    )
    at = customer.select(
        F.concat(F.lit("NATION_"), "c_nationkey").alias("type"),
        F.concat(F.lit("r"), F.col("c_custkey") % 200).alias("relation"),
        "c_custkey",
    )
    shapes = at.groupBy("type", "relation").agg(
        F.min(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 5)).alias("min"),
        F.max(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 4)).alias("max"),
    )
    return schema_from_tables(types, relations, shapes)


# ---- evidence --------------------------------------------------------------------------------


def _selector(exact, source=None, prefix=None, suffix=None, start=None, end=None) -> Column:
    text = lambda v: F.lit(None).cast("string") if v is None else v
    hint = F.lit(None).cast("struct<start:bigint,end:bigint>")
    if start is not None:
        hint = F.struct(
            F.lit(start).cast("bigint").alias("start"), F.lit(end).cast("bigint").alias("end")
        )
    return F.struct(
        text(source).alias("source"), exact.alias("exact"), text(prefix).alias("prefix"),
        text(suffix).alias("suffix"), hint.alias("hint"),
    )


def quote_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per document to its source, with a quote of a class chosen by its number."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id")
    lines = F.split("text", "\n")
    first, last = F.element_at(lines, 1), F.element_at(lines, -1)
    path = F.concat(F.lit("docs/"), number, F.lit(".txt"))
    odd = F.floor(number / 8) % 3
    by_class = (
        F.when(number % 8 == 0, _selector(first, path))
        .when(number % 8 == 1, _selector(first, path, start=1, end=1))
        .when(number % 8 == 2, _selector(first, path, start=2, end=2))
        .when(number % 8 == 3, _selector(first, path, prefix=F.lit("zzz ")))
        .when(number % 8 == 4, _selector(F.concat(first, F.lit("#gone")), path))
        .when(number % 8 == 5, _selector(first, F.concat(F.lit("docs/x"), number, F.lit(".txt"))))
        .when(
            number % 8 == 6,
            F.when(odd == 0, _selector(F.lit(""), path))
            .when(odd == 1, _selector(first, path, start=0, end=1))
            .otherwise(_selector(first, F.concat(F.lit("../"), number))),
        )
        .otherwise(_selector(last, path, prefix=F.lit("\n"), suffix=F.lit("")))
    )
    return docs.select(
        _key("doc", "doc_id").alias("src"),
        F.lit("quotes").alias("relation"),
        _key("source", "source").alias("dst"),
        F.concat(F.lit("kb/doc/"), number, F.lit(".md")).alias("declaration"),
        F.lit(0).cast("bigint").alias("decl_ordinal"),
        F.array(by_class.cast(SELECTOR), _selector(last, path).cast(SELECTOR)).alias("evidence"),
    )


def quote_entities(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return _entity(docs, "doc", "doc_id").unionByName(
        _entity(docs.select("source").distinct(), "source", "source")
    )


def text_sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")
    )


def line_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-empty line of every document quoted from that document, with its line number
    as the hint."""
    path = F.concat(F.lit("docs/"), "doc_id", F.lit(".txt"))
    lines = table(spark, folder, "documents").select(
        "doc_id", path.alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "line")
    ).filter(F.col("line") != "")
    number = (F.col("at") + 1).cast("bigint")
    return lines.select(
        _key("doc", "doc_id").alias("src"),
        F.lit("quotes").alias("relation"),
        F.col("path").alias("dst"),
        F.concat(F.lit("kb/doc/"), "doc_id", F.lit(".md")).alias("declaration"),
        F.lit(0).cast("bigint").alias("decl_ordinal"),
        F.col("at").alias("sel_ordinal"),
        F.struct(
            F.col("path").alias("source"),
            F.col("line").alias("exact"),
            F.lit(None).cast("string").alias("prefix"),
            F.lit(None).cast("string").alias("suffix"),
            F.struct(number.alias("start"), number.alias("end")).alias("hint"),
        ).alias("selector"),
    )


# ---- documents as Markdown -------------------------------------------------------------------


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as Markdown with frontmatter, in DOS line ends for odd numbers and with a
    fault for some numbers."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id")
    title = F.regexp_replace(F.element_at(F.split("text", "\n"), 1), r"[\\\"\p{Cntrl}]", " ")
    ident = F.when(number % 10 == 5, F.lit('" "')).otherwise(_key("doc", "doc_id"))
    extra = F.when(number % 10 == 6, F.lit("colour: red\n")).otherwise(F.lit(""))
    head = F.concat(
        F.lit("id: "), ident, F.lit("\ntype: Doc\ntitle: \""), title,
        F.lit("\"\naliases: ["), F.col("lang"), F.lit(", yes, 017]\n"), extra,
        F.lit("relations:\n  - relation: quotes\n    target: source:"), F.col("source"),
        F.lit("\n    evidence:\n      - exact: x\n        hint: {start: 1, end: 2}\n"),
        F.lit("      - exact: \"a\\nb\"\n        suffix: ''\n"),
    )
    content = (
        F.when(number % 10 == 3, F.col("text"))
        .when(number % 10 == 4, F.concat(F.lit("---\n"), head))
        .otherwise(F.concat(F.lit("---\n"), head, F.lit("---\n"), F.col("text")))
    )
    return docs.select(
        _doc("doc", "doc_id").alias("document"),
        F.when(number % 2 == 1, F.replace(content, F.lit("\n"), F.lit("\r\n")))
        .otherwise(content)
        .alias("content"),
    )


def order_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as parsed documents, with two or three relations and their evidence nested."""
    orders = table(spark, folder, "orders")
    quote = F.array(_selector(F.col("o_orderpriority")).cast(SELECTOR))

    def declared(relation, target):
        return F.struct(
            F.lit(relation).alias("relation"), target.alias("target"), quote.alias("evidence")
        )

    fixed = [
        declared("placed_by", _key("customer", "o_custkey")),
        declared("billed_in", _key("nation", F.col("o_custkey") % 25)),
    ]
    checked = declared("checked_by", _key("supplier", F.col("o_orderkey") % 10))
    relations = F.when(F.col("o_orderstatus") == "F", F.array(checked, *fixed)).otherwise(
        F.array(*fixed)
    )
    return orders.select(
        _doc("order", "o_orderkey").alias("document"),
        F.struct(
            _key("order", "o_orderkey").alias("id"),
            F.lit("Order").alias("type"),
            F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("title"),
            F.array("o_orderstatus").alias("aliases"),
            relations.alias("relations"),
        ).alias("meta"),
        F.lit(None).cast("string").alias("error"),
    )


# ---- requests --------------------------------------------------------------------------------


def roots(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with depth 1, every nation and region with depth 2, and one unknown root
    per region."""
    t = lambda name: table(spark, folder, name)

    def request(df, prefix, number, depth):
        root = _key(prefix, number)
        return df.select(root.alias("request_id"), root.alias("root"), F.lit(depth).alias("depth"))

    return _union(
        [
            request(t("customer"), "customer", "c_custkey", 1),
            request(t("nation"), "nation", "n_nationkey", 2),
            request(t("region"), "region", "r_regionkey", 2),
            request(t("region"), "planet", "r_regionkey", 1),
        ]
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Parts to regions, customers to regions, suppliers and themselves, unknown ends."""
    t = lambda name: table(spark, folder, name)

    def request(df, start, goal):
        return df.select(
            F.concat(start, F.lit("->"), goal).alias("request_id"),
            start.alias("from"), goal.alias("to"),
        )

    part, customer, region = t("part"), t("customer"), t("region")
    return _union(
        [
            request(part, _key("part", "p_partkey"), _key("region", F.col("p_partkey") % 5)),
            request(
                customer, _key("customer", "c_custkey"), _key("region", F.col("c_custkey") % 5)
            ),
            request(
                customer, _key("customer", "c_custkey"), _key("supplier", F.col("c_custkey") % 10)
            ),
            request(customer, _key("customer", "c_custkey"), _key("customer", "c_custkey")),
            request(region, _key("region", "r_regionkey"), _key("planet", "r_regionkey")),
        ]
    )


def lookups(spark: SparkSession, folder: str) -> DataFrame:
    """Names, brands, types, segments and ids of the data set as needles, some in other case or
    with blanks around, and needles without match."""
    t = lambda name: table(spark, folder, name)
    texts = _union(
        [
            t("region").select(F.concat(F.lit("  "), F.lower("r_name")).alias("text")),
            t("nation").select(F.col("n_name").alias("text")),
            t("supplier").select(F.upper("s_name").alias("text")),
            t("customer").select(F.col("c_name").alias("text")),
            t("customer").select(F.concat("c_mktsegment", F.lit(" ")).alias("text")),
            t("part").select(F.col("p_name").alias("text")),
            t("part").select(F.col("p_brand").alias("text")),
            t("part").select(F.col("p_type").alias("text")),
            t("part").select(F.split("p_name", " ")[1].alias("text")),
            t("customer").select(F.concat(F.lit("order:"), "c_custkey").alias("text")),
            t("region").select(F.concat(F.lit("nothing-like-"), "r_regionkey").alias("text")),
            t("region").select(F.col("r_regionkey").cast("string").alias("text")),
            t("region").select(F.lit("\u3000 \t").alias("text")),
        ]
    ).distinct()
    return texts.select(F.col("text").alias("query_id"), "text")
