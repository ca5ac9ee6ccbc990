"""ANSI SQL for the registered queries, written against the raw tables.

The statements state the expected results independently of the Spark operators: windows and
nested loops are fine here, since they run on the small check data only.
"""

from __future__ import annotations

from graphproof.fixed_values import EVIDENCE_MESSAGES, MESSAGES
from graphproof.testbed.tables import KINDS, RELATIONS, SHAPES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _say(code: str, *values: str) -> str:
    """A message of the report as a SQL expression."""
    pieces = MESSAGES.get(code, EVIDENCE_MESSAGES.get(code)).split("{}")
    parts = []
    for i, piece in enumerate(pieces):
        if piece:
            parts.append(_text(piece))
        if i < len(values):
            parts.append(values[i])
    return "concat(" + ", ".join(parts) + ")"


def _rows(name: str, columns: str, rows: list[tuple]) -> str:
    def cell(value):
        if value is None:
            return "NULL"
        if isinstance(value, list):
            return "[" + ", ".join(map(cell, value)) + "]"
        return _text(value) if isinstance(value, str) else str(value).lower()

    values = ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {values})"


SCHEMA = ",\n".join(
    [
        _rows("types", "kind", [(k,) for k in KINDS]),
        _rows(
            "relations", "relation, from_types, to_types, mutual, acyclic",
            [(name, *spec) for name, spec in RELATIONS.items()],
        ),
        _rows("shapes", "kind, relation, lo, hi", SHAPES),
    ]
)


def _entity(source, prefix, number, title=None, aliases=()):
    listed = "[" + ", ".join(aliases) + "]" if aliases else "[]"
    return (
        f"SELECT concat('{prefix}:', {number}) AS id, '{prefix.capitalize()}' AS kind, "
        f"{title or f'concat({_text(prefix + chr(58))}, {number})'} AS title, "
        f"{listed}::VARCHAR[] AS aliases, concat('kb/{prefix}/', {number}, '.md') AS document "
        f"FROM {source}"
    )


_TYPES_OF_EVENTS = "(SELECT DISTINCT event_type FROM events)"
_COMMON_ENTITIES = [
    _entity("region", "region", "r_regionkey", "r_name"),
    _entity("nation", "nation", "n_nationkey", "n_name"),
    _entity("customer", "customer", "c_custkey", "c_name", ["c_mktsegment"]),
    _entity("supplier", "supplier", "s_suppkey", "s_name"),
    _entity("orders", "order", "o_orderkey"),
    _entity(_TYPES_OF_EVENTS, "event", "event_type", "event_type"),
]
ENTITIES = "entities AS (" + "\nUNION ALL ".join(
    [*_COMMON_ENTITIES, _entity("part", "part", "p_partkey", "p_name", ["p_brand", "p_type"])]
) + ")"
FAULTY_ENTITIES = "entities AS (" + "\nUNION ALL ".join(
    [
        *_COMMON_ENTITIES,
        "SELECT concat('customer:', c_custkey), 'Supplier', c_name, [c_mktsegment], "
        "concat('kb/zz/', c_custkey, '.md') FROM customer WHERE c_custkey % 97 = 5",
        "SELECT CASE WHEN p_partkey % 83 = 7 THEN concat('part ', p_partkey) "
        "ELSE concat('part:', p_partkey) END, "
        "CASE WHEN p_partkey % 89 = 11 THEN 'Widget' ELSE 'Part' END, p_name, "
        "[p_brand, p_type], concat('kb/part/', p_partkey, '.md') FROM part",
    ]
) + ")"


def _edge(source, src, relation, dst, declaration, ordinal="0"):
    key = lambda pair: f"concat('{pair[0]}:', {pair[1]})" if isinstance(pair, tuple) else pair
    doc = f"concat('kb/{declaration[0]}/', {declaration[1]}, '.md')"
    relation = relation if " " in relation else f"'{relation}'"
    return (
        f"SELECT {key(src)} AS src, {relation} AS relation, {key(dst)} AS dst, "
        f"{doc} AS declaration, CAST({ordinal} AS BIGINT) AS ordinal FROM {source}"
    )


_CONTAINS = _edge(
    "lineitem", ("order", "l_orderkey"), "contains", ("part", "l_partkey"),
    ("order", "l_orderkey"), "l_linenumber * 1000000 + l_suppkey",
)
EDGES = "edges AS (" + "\nUNION ALL ".join(
    [
        _edge("nation", ("nation", "n_nationkey"), "in_region", ("region", "n_regionkey"),
              ("nation", "n_nationkey")),
        _edge("customer", ("customer", "c_custkey"), "in_nation", ("nation", "c_nationkey"),
              ("customer", "c_custkey")),
        _edge("supplier", ("supplier", "s_suppkey"), "in_nation", ("nation", "s_nationkey"),
              ("supplier", "s_suppkey")),
        _edge("orders", ("order", "o_orderkey"), "placed_by", ("customer", "o_custkey"),
              ("order", "o_orderkey")),
        _CONTAINS,
        _edge("(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)", ("part", "l_partkey"),
              "supplied_by", ("supplier", "l_suppkey"), ("part", "l_partkey"), "l_suppkey"),
    ]
) + ")"
_PEERS = (
    "(SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a "
    "JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)"
)
FAULTY_EDGES = "edges AS (" + "\nUNION ALL ".join(
    [
        _edge("customer", ("customer", "c_custkey"), "in_nation", ("nation", "c_nationkey"),
              ("customer", "c_custkey")),
        _edge("supplier", ("supplier", "s_suppkey"), "in_nation",
              "CASE WHEN s_suppkey % 7 = 2 THEN 'region:0' ELSE concat('nation:', s_nationkey) END",
              ("supplier", "s_suppkey")),
        _edge("nation", ("region", "n_regionkey"), "in_nation", ("nation", "n_nationkey"),
              ("nation", "n_nationkey"), "7"),
        _edge("region", ("region", "r_regionkey"), "placed_by", "'region:0'",
              ("region", "r_regionkey")),
        _edge("orders",
              "CASE WHEN o_orderkey % 223 = 4 THEN concat('order:none-', o_orderkey) "
              "ELSE concat('order:', o_orderkey) END",
              "CASE WHEN o_orderkey % 227 = 6 THEN 'ships_to' ELSE 'placed_by' END",
              "CASE WHEN o_orderkey % 211 = 3 THEN 'customer:none' "
              "ELSE concat('customer:', o_custkey) END",
              ("order", "o_orderkey")),
        _CONTAINS,
        _edge(_PEERS, ("supplier", "a"), "peer", ("supplier", "b"), ("supplier", "a"), "1"),
        _edge(_PEERS, ("supplier", "b"), "peer", ("supplier", "a"), ("supplier", "b"), "2"),
    ]
) + ")"
_ACYCLIC = [
    _edge("nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1",
          ("nation", "a.n_nationkey"), "precedes", ("nation", "b.n_nationkey"),
          ("nation", "a.n_nationkey"), "1"),
    _edge("(SELECT DISTINCT a.event_type AS a, b.event_type AS b FROM events a JOIN events b "
          "ON b.event_id = a.event_id + 1 WHERE a.event_type <> b.event_type)",
          ("event", "a"), "follows", ("event", "b"), ("event", "a")),
    _edge("customer", ("customer", "c_custkey"), "refers",
          ("customer", "((c_custkey * c_custkey + 1) % (SELECT count(*) FROM customer))"),
          ("customer", "c_custkey"), "3"),
]
CYCLIC_EDGES = "edges AS (" + "\nUNION ALL ".join(
    [
        *_ACYCLIC,
        _edge("(SELECT * FROM events WHERE event_id > 0)", ("event", "event_id"), "caused_by",
              ("event", "event_id // 2"), ("event", "event_id")),
    ]
) + ")"


WHOLE_ENTITIES = ENTITIES[:-1] + "\nUNION ALL " + "\nUNION ALL ".join(
    [
        _entity("documents", "doc", "doc_id"),
        _entity("(SELECT DISTINCT source FROM documents)", "source", "source"),
    ]
) + ")"
WHOLE_EDGES = EDGES[:-1] + "\nUNION ALL " + "\nUNION ALL ".join(
    [*_ACYCLIC, _edge("documents", ("doc", "doc_id"), "quotes", ("source", "source"), ("doc", "doc_id"))]
) + ")"

JUDGED = """
last_kind AS (SELECT id, max_by(kind, document) AS kind FROM entities GROUP BY id),
linked AS (
  SELECT e.*, s.kind AS src_kind, d.kind AS dst_kind, r.from_types, r.to_types, r.mutual,
    CASE WHEN s.kind IS NULL THEN 'edge.missing_source' WHEN d.kind IS NULL THEN
      'edge.missing_target' WHEN r.relation IS NULL THEN 'edge.unknown_relation' END AS fault
  FROM edges e LEFT JOIN last_kind s ON s.id = e.src LEFT JOIN last_kind d ON d.id = e.dst
  LEFT JOIN relations r ON r.relation = e.relation),
numbered AS (
  SELECT *, CASE WHEN fault IS NULL THEN row_number() OVER (
    PARTITION BY fault IS NULL, relation,
      CASE WHEN mutual THEN least(src, dst) ELSE src END,
      CASE WHEN mutual THEN greatest(src, dst) ELSE dst END
    ORDER BY src, relation, dst, declaration, ordinal) END AS nth FROM linked),
judged AS (
  SELECT *, coalesce(nth = 1, false) AS checked,
    coalesce(nth = 1 AND (list_contains(from_types, '*') OR list_contains(from_types, src_kind)),
      false) AS domain_ok,
    coalesce(nth = 1 AND (list_contains(to_types, '*') OR list_contains(to_types, dst_kind)),
      false) AS range_ok
  FROM numbered)
"""
_SUBJECT = "concat(src, ' --', relation, '--> ', dst)"
_PLAIN = "concat_ws(' | ', concat('declaration>', declaration), concat_ws('>', 'assertion', src, relation, dst))"
EDGE_VERDICTS = f"""
edge_verdicts AS (
  SELECT 'violated' AS status, fault AS code, {_SUBJECT} AS subject,
    CASE fault WHEN 'edge.missing_source' THEN {_say("edge.missing_source", "src")}
      WHEN 'edge.missing_target' THEN {_say("edge.missing_target", "dst")}
      ELSE {_say("edge.unknown_relation", "relation")} END AS message, {_PLAIN} AS witness
  FROM judged WHERE fault IS NOT NULL
  UNION ALL SELECT 'violated', 'edge.duplicate_assertion', {_SUBJECT},
    {_say("edge.duplicate_assertion")}, {_PLAIN} FROM judged WHERE nth > 1
  UNION ALL SELECT 'violated', 'edge.domain_mismatch', {_SUBJECT},
    {_say("edge.domain_mismatch", "relation", "src_kind")},
    concat('schema>schema.yaml:relations.', relation, '.from | ', {_PLAIN})
    FROM judged WHERE checked AND NOT domain_ok
  UNION ALL SELECT 'violated', 'edge.range_mismatch', {_SUBJECT},
    {_say("edge.range_mismatch", "relation", "dst_kind")},
    concat('schema>schema.yaml:relations.', relation, '.to | ', {_PLAIN})
    FROM judged WHERE checked AND NOT range_ok
  UNION ALL SELECT 'satisfied', 'edge.structure', {_SUBJECT}, {_say("edge.structure")},
    concat('schema>schema.yaml:relations.', relation, ' | ', {_PLAIN})
    FROM judged WHERE domain_ok AND range_ok
  UNION ALL SELECT 'unknown', 'edge.evidence', {_SUBJECT}, {_say("edge.evidence")}, {_PLAIN}
    FROM judged WHERE checked)
"""
ENTITY_VERDICTS = f"""
ranked_entities AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY document) AS nth FROM entities),
entity_verdicts AS (
  SELECT 'violated' AS status, 'entity.invalid_id' AS code, id AS subject,
    {_say("entity.invalid_id")} AS message, concat('declaration>', document) AS witness
  FROM entities WHERE NOT regexp_full_match(id, '[A-Za-z0-9._:-]+')
  UNION ALL SELECT 'violated', 'entity.duplicate_id', id, {_say("entity.duplicate_id", "id")},
    concat('declaration>', document) FROM ranked_entities WHERE nth > 1
  UNION ALL SELECT 'satisfied', 'entity.type', id, {_say("entity.type", "kind")},
    concat('schema>schema.yaml:types.', kind, ' | declaration>', document)
    FROM ranked_entities WHERE nth = 1 AND kind IN (SELECT kind FROM types)
  UNION ALL SELECT 'violated', 'entity.unknown_type', id, {_say("entity.unknown_type", "kind")},
    concat('declaration>', document)
    FROM ranked_entities WHERE nth = 1 AND kind NOT IN (SELECT kind FROM types))
"""
CARDINALITY = f"""
degrees AS (SELECT src, relation, count(*) AS n FROM judged WHERE domain_ok AND range_ok
  GROUP BY src, relation),
shape_verdicts AS (
  SELECT CASE WHEN bad THEN 'violated' ELSE 'satisfied' END AS status,
    'shape.cardinality' AS code, concat(id, ':', relation) AS subject,
    CASE WHEN bad THEN {_say("shape.cardinality.violated", "relation", "n", '''
        CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN concat(lo, '..=', hi)
          WHEN lo IS NOT NULL THEN concat('>=', lo) ELSE concat('<=', hi) END''')}
      ELSE {_say("shape.cardinality.satisfied", "relation", "n")} END AS message,
    concat('schema>schema.yaml:types.', kind, '.constraints.', relation) AS witness
  FROM (SELECT e.id, e.kind, s.relation, s.lo, s.hi, coalesce(d.n, 0) AS n,
      coalesce(coalesce(d.n, 0) < s.lo, false) OR coalesce(coalesce(d.n, 0) > s.hi, false) AS bad
    FROM entities e JOIN shapes s ON s.kind = e.kind
    LEFT JOIN degrees d ON d.src = e.id AND d.relation = s.relation))
"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n"


# ---- evidence --------------------------------------------------------------------------------

_FIRST = "string_split(text, chr(10))[1]"
_LAST = "string_split(text, chr(10))[-1]"
QUOTES = f"""
quotes AS (
  SELECT doc_id, source AS topic, 0 AS sel, text,
    CASE doc_id % 8 WHEN 4 THEN concat({_FIRST}, '#gone') WHEN 7 THEN {_LAST}
      WHEN 6 THEN CASE WHEN (doc_id // 8) % 3 = 0 THEN '' ELSE {_FIRST} END
      ELSE {_FIRST} END AS exact,
    CASE WHEN doc_id % 8 = 5 THEN concat('docs/x', doc_id, '.txt')
      WHEN doc_id % 8 = 6 AND (doc_id // 8) % 3 = 2 THEN concat('../', doc_id)
      ELSE concat('docs/', doc_id, '.txt') END AS path,
    CASE doc_id % 8 WHEN 3 THEN 'zzz ' WHEN 7 THEN chr(10) END AS prefix,
    CASE doc_id % 8 WHEN 7 THEN '' END AS suffix,
    CASE WHEN doc_id % 8 = 1 THEN 1 WHEN doc_id % 8 = 2 THEN 2
      WHEN doc_id % 8 = 6 AND (doc_id // 8) % 3 = 1 THEN 0 END AS hint_start,
    CASE WHEN doc_id % 8 = 1 THEN 1 WHEN doc_id % 8 = 2 THEN 2
      WHEN doc_id % 8 = 6 AND (doc_id // 8) % 3 = 1 THEN 1 END AS hint_end
  FROM documents
  UNION ALL
  SELECT doc_id, source, 1, text, {_LAST}, concat('docs/', doc_id, '.txt'), NULL, NULL, NULL, NULL
  FROM documents),
selectors AS (
  SELECT concat('doc:', doc_id) AS src, concat('source:', topic) AS dst,
    concat('kb/doc/', doc_id, '.md') AS declaration, sel, exact, path, prefix, suffix,
    hint_start, hint_end, CASE WHEN doc_id % 8 = 5 AND sel = 0 THEN NULL ELSE text END AS content
  FROM quotes)
"""
LINES = """
selectors AS (
  SELECT concat('doc:', doc_id) AS src, concat('docs/', doc_id, '.txt') AS dst,
    concat('kb/doc/', doc_id, '.md') AS declaration, nth - 1 AS sel, lines[nth] AS exact,
    concat('docs/', doc_id, '.txt') AS path, NULL::VARCHAR AS prefix, NULL::VARCHAR AS suffix,
    nth AS hint_start, nth AS hint_end, text AS content
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS nth
    FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents))
  WHERE lines[nth] <> '')
"""


def _clean(column: str) -> str:
    return f"nfc_normalize(replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10)))"


RESOLVED = f"""
texts AS (
  SELECT *, {_clean("content")} AS body, {_clean("exact")} AS quote,
    {_clean("prefix")} AS before_quote, {_clean("suffix")} AS after_quote FROM selectors),
fronts AS (
  SELECT *, CASE WHEN starts_with(body, '---' || chr(10))
      AND strpos(substr(body, 5), chr(10) || '---' || chr(10)) > 0
    THEN strpos(substr(body, 5), chr(10) || '---' || chr(10)) + 8 ELSE 0 END AS front FROM texts),
regions AS (SELECT *, substr(body, front + 1) AS region FROM fronts),
counted AS (
  SELECT *, CASE WHEN quote = '' THEN 0 ELSE
    CAST((length(region) - length(replace(region, quote, ''))) / length(quote) AS BIGINT) END
    AS hits,
    CASE WHEN before_quote IS NULL AND after_quote IS NULL THEN NULL
      ELSE string_split(region, quote) END AS pieces FROM regions),
ends AS (
  SELECT *, CASE WHEN pieces IS NOT NULL THEN [CAST(
      list_sum([length(p) for p in pieces[1:i]]) + (i - 1) * length(quote) AS BIGINT)
      for i in range(1, hits + 1)] END AS stops FROM counted),
fitted AS (
  SELECT *, [stop for stop in stops
      if ends_with(substr(region, 1, stop), coalesce(before_quote, ''))
      and starts_with(substr(region, stop + length(quote) + 1), coalesce(after_quote, ''))]
    AS good FROM ends),
placed AS (
  SELECT *, CASE WHEN pieces IS NULL THEN hits ELSE len(good) END AS fits,
    CASE WHEN pieces IS NULL THEN substr(region, 1, strpos(region, quote) - 1)
      ELSE substr(region, 1, good[1]) END AS ahead FROM fitted),
faulted AS (
  SELECT *, CASE WHEN exact = '' THEN {_say("empty_exact")}
      WHEN hint_start = 0 OR hint_end < hint_start THEN {_say("bad_hint")}
      WHEN starts_with(path, '/') THEN {_say("absolute", "path")}
      WHEN list_contains(string_split(path, '/'), '..') THEN {_say("escape", "path")} END AS fault
  FROM placed),
lined AS (
  SELECT *, CASE WHEN fault IS NULL AND content IS NOT NULL AND fits = 1 THEN
      1 + len(string_split(substr(body, 1, front), chr(10))) - 1
        + len(string_split(ahead, chr(10))) - 1 END AS start_line FROM faulted),
ended AS (
  SELECT *, start_line + len(string_split(quote, chr(10))) - 1 AS end_line FROM lined),
resolved AS (
  SELECT src, 'quotes' AS relation, dst, declaration, sel, path AS source, exact,
    CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
    CASE WHEN fault IS NOT NULL THEN 'invalid' WHEN content IS NULL THEN 'missing'
      WHEN fits = 0 THEN 'stale' WHEN fits > 1 THEN 'ambiguous'
      WHEN hint_start <> start_line OR hint_end <> end_line THEN 'relocated' ELSE 'valid' END
      AS state,
    CASE WHEN fault IS NOT NULL THEN fault WHEN content IS NULL THEN {_say("missing")}
      WHEN hits = 0 THEN {_say("gone")} WHEN fits = 0 THEN {_say("context")}
      WHEN fits > 1 AND pieces IS NOT NULL THEN {_say("ambiguous_context", "fits")}
      WHEN fits > 1 THEN {_say("ambiguous", "fits")}
      WHEN hint_start <> start_line OR hint_end <> end_line THEN {_say("relocated")} END AS message
  FROM ended)
"""
EVIDENCE_VERDICTS = f"""
evidence_verdicts AS (
  SELECT CASE state WHEN 'valid' THEN 'satisfied' WHEN 'relocated' THEN 'satisfied'
      WHEN 'invalid' THEN 'violated' ELSE 'unknown' END AS status,
    CASE state WHEN 'valid' THEN 'evidence.resolved' WHEN 'relocated' THEN 'evidence.relocated'
      WHEN 'invalid' THEN 'evidence.invalid' ELSE 'evidence.unresolved' END AS code,
    {_SUBJECT} AS subject, coalesce(message, {_say("evidence.resolved")}) AS message,
    concat({_PLAIN}, ' | ', concat_ws('>', 'evidence', source, state, exact, start_line, end_line))
      AS witness
  FROM resolved)
"""

# ---- schema rules ----------------------------------------------------------------------------

SCHEMA_RULES = f"""
WITH types AS (
  SELECT CASE WHEN n_nationkey % 6 = 4 THEN concat('bad ', n_name) ELSE n_name END AS type
  FROM nation),
named AS (
  SELECT s.s_suppkey AS k, s.s_name, n.n_name,
    concat('NATION_', (s.s_nationkey + 1) % 25) AS other
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey),
relations AS (
  SELECT CASE WHEN k % 13 = 5 THEN s_name ELSE concat('r', k) END AS relation,
    CASE WHEN k % 11 = 0 THEN []::VARCHAR[] WHEN k % 11 = 1 THEN ['*']
      WHEN k % 11 = 2 THEN [n_name, other, 'NOWHERE', 'NOWHERE'] ELSE [n_name, other] END AS f,
    CASE WHEN k % 7 = 0 THEN []::VARCHAR[] WHEN k % 7 = 1 THEN [n_name]
      ELSE [other, n_name, other] END AS t,
    k % 3 = 0 AS mutual, k % 4 = 0 AS acyclic FROM named),
shapes AS (
  SELECT concat('NATION_', c_nationkey) AS type, concat('r', c_custkey % 200) AS relation,
    min(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 5 END) AS lo,
    max(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 4 END) AS hi
  FROM customer GROUP BY 1, 2),
unknown AS (
  SELECT relation, t AS type FROM (SELECT relation, unnest(list_concat(f, t)) AS t FROM relations)
  WHERE t <> '*' AND t NOT IN (SELECT type FROM types)),
checks AS (
  SELECT *, NOT regexp_full_match(relation, '[A-Za-z0-9._:-]+') AS bad_name,
    len(f) = 0 AS no_from, len(t) = 0 AS no_to, mutual AND acyclic AS bad_policy,
    mutual AND len(f) > 0 AND len(t) > 0
      AND list_sort(list_distinct(f)) <> list_sort(list_distinct(t)) AS mismatch,
    relation IN (SELECT relation FROM unknown) AS has_unknown FROM relations),
broken AS (
  SELECT relation, code, tail FROM (
    SELECT relation, 'relation.invalid_name' AS code, '' AS tail FROM checks WHERE bad_name
    UNION ALL SELECT relation, 'relation.missing_domain', '.from' FROM checks WHERE no_from
    UNION ALL SELECT relation, 'relation.missing_range', '.to' FROM checks WHERE no_to
    UNION ALL SELECT relation, 'relation.invalid_policy', '' FROM checks WHERE bad_policy
    UNION ALL SELECT relation, 'relation.symmetric_type_mismatch', '' FROM checks
      WHERE mismatch)),
judged_shapes AS (
  SELECT s.*, CASE WHEN r.relation IS NULL THEN 'shape.unknown_relation'
      WHEN lo IS NULL AND hi IS NULL THEN 'shape.empty' WHEN lo > hi THEN 'shape.invalid_range'
      WHEN NOT (list_contains(r.f, '*') OR list_contains(r.f, s.type)) THEN 'shape.invalid_domain'
      ELSE 'shape.contract' END AS code
  FROM shapes s LEFT JOIN relations r ON r.relation = s.relation)
SELECT 'satisfied' AS status, 'schema.version' AS code, 'schema' AS subject,
  'schema version 1 is supported' AS message, 'schema>schema.yaml:version' AS witness
UNION ALL SELECT 'violated', 'type.invalid_name', concat('type:', type),
  {_say("type.invalid_name")}, concat('schema>schema.yaml:types.', type)
  FROM types WHERE NOT regexp_full_match(type, '[A-Za-z0-9._:-]+')
UNION ALL SELECT 'violated', code, concat('relation:', relation),
  CASE code WHEN 'relation.invalid_name' THEN {_say("relation.invalid_name")}
    WHEN 'relation.missing_domain' THEN {_say("relation.missing_domain")}
    WHEN 'relation.missing_range' THEN {_say("relation.missing_range")}
    WHEN 'relation.invalid_policy' THEN {_say("relation.invalid_policy")}
    ELSE {_say("relation.symmetric_type_mismatch")} END,
  concat('schema>schema.yaml:relations.', relation, tail) FROM broken
UNION ALL SELECT 'violated', 'relation.unknown_type', concat('relation:', relation),
  {_say("relation.unknown_type", "type")}, concat('schema>schema.yaml:relations.', relation)
  FROM unknown
UNION ALL SELECT 'satisfied', 'relation.contract', concat('relation:', relation),
  {_say("relation.contract")}, concat('schema>schema.yaml:relations.', relation) FROM checks
  WHERE NOT (bad_name OR no_from OR no_to OR bad_policy OR mismatch OR has_unknown)
UNION ALL SELECT CASE code WHEN 'shape.contract' THEN 'satisfied' ELSE 'violated' END, code,
  concat('shape:', type, '.', relation),
  CASE code WHEN 'shape.unknown_relation' THEN {_say("shape.unknown_relation", "relation")}
    WHEN 'shape.empty' THEN {_say("shape.empty")}
    WHEN 'shape.invalid_range' THEN {_say("shape.invalid_range")}
    WHEN 'shape.invalid_domain' THEN {_say("shape.invalid_domain", "type", "relation")}
    ELSE {_say("shape.contract")} END,
  concat('schema>schema.yaml:types.', type, '.constraints.', relation) FROM judged_shapes
"""

# ---- graph queries ---------------------------------------------------------------------------

ROOTS = """
asked AS (
  SELECT concat('customer:', c_custkey) AS root, 1 AS depth FROM customer
  UNION ALL SELECT concat('nation:', n_nationkey), 2 FROM nation
  UNION ALL SELECT concat('region:', r_regionkey), 2 FROM region
  UNION ALL SELECT concat('planet:', r_regionkey), 1 FROM region),
arcs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (
  SELECT root, root AS node, 0 AS level FROM asked WHERE root IN (SELECT id FROM entities)
  UNION
  SELECT r.root, a.b, r.level + 1 FROM reach r JOIN asked q ON q.root = r.root
  JOIN arcs a ON a.a = r.node WHERE r.level < q.depth),
members AS (SELECT root, node, min(level) AS level FROM reach GROUP BY root, node)
"""

PATHS = """
asked AS (
  SELECT concat('part:', p_partkey) AS a, concat('region:', p_partkey % 5) AS b FROM part
  UNION ALL SELECT concat('customer:', c_custkey), concat('region:', c_custkey % 5) FROM customer
  UNION ALL SELECT concat('customer:', c_custkey), concat('supplier:', c_custkey % 10)
    FROM customer
  UNION ALL SELECT concat('customer:', c_custkey), concat('customer:', c_custkey) FROM customer
  UNION ALL SELECT concat('region:', r_regionkey), concat('planet:', r_regionkey) FROM region),
arcs AS (
  SELECT src AS a, dst AS b, min(struct_pack(relation := relation, declaration := declaration))
    AS via FROM edges GROUP BY src, dst),
starts AS (SELECT DISTINCT a FROM asked WHERE a IN (SELECT id FROM entities)),
search AS (
  SELECT a AS start, a AS node, [a] AS path FROM starts
  UNION
  SELECT s.start, x.b, min(list_append(s.path, x.b)) FROM search s JOIN arcs x ON x.a = s.node
  WHERE NOT list_contains(s.path, x.b) GROUP BY s.start, x.b),
best AS (
  SELECT start, node, arg_min(path, struct_pack(n := len(path), p := path)) AS path
  FROM search GROUP BY start, node)
"""

LOOKUP_KEYS = r"""
texts AS (
  SELECT DISTINCT text FROM (
    SELECT concat('  ', lower(r_name)) AS text FROM region
    UNION ALL SELECT n_name FROM nation
    UNION ALL SELECT upper(s_name) FROM supplier
    UNION ALL SELECT c_name FROM customer
    UNION ALL SELECT concat(c_mktsegment, ' ') FROM customer
    UNION ALL SELECT p_name FROM part
    UNION ALL SELECT p_brand FROM part
    UNION ALL SELECT p_type FROM part
    UNION ALL SELECT string_split(p_name, ' ')[2] FROM part
    UNION ALL SELECT concat('order:', c_custkey) FROM customer
    UNION ALL SELECT concat('nothing-like-', r_regionkey) FROM region
    UNION ALL SELECT CAST(r_regionkey AS VARCHAR) FROM region
    UNION ALL SELECT concat(chr(12288), ' ', chr(9)) FROM region)),
needles AS (
  SELECT text AS query_id, text,
    lower(nfc_normalize(trim(text, concat(' ', chr(9), chr(12288))))) AS needle FROM texts),
keyed AS (
  SELECT *, lower(nfc_normalize(trim(id))) AS id_key, lower(nfc_normalize(trim(title))) AS title_key,
    [lower(nfc_normalize(trim(a))) for a in aliases] AS alias_keys FROM entities)
"""
ALL_MATCHES = """
matches AS (
  SELECT * FROM (
    SELECT n.query_id, k.id, k.kind, k.title, k.document,
      CASE WHEN k.id_key = n.needle THEN 0 WHEN k.title_key = n.needle THEN 1
        WHEN list_contains(k.alias_keys, n.needle) THEN 2
        WHEN contains(k.id_key, n.needle) OR contains(k.title_key, n.needle)
          OR len([a for a in k.alias_keys if contains(a, n.needle)]) > 0 THEN 3 END AS rank
    FROM needles n JOIN keyed k ON n.needle <> '' AND (contains(k.id_key, n.needle)
      OR contains(k.title_key, n.needle)
      OR contains(array_to_string(k.alias_keys, chr(10)), n.needle)))
  WHERE rank IS NOT NULL)
"""
EXACT_MATCHES = """
exact AS (
  SELECT n.query_id, k.id, k.kind, k.title, k.document, min(k.rank) AS rank
  FROM needles n JOIN (
    SELECT *, id_key AS key, 0 AS rank FROM keyed
    UNION ALL SELECT *, title_key, 1 FROM keyed
    UNION ALL SELECT *, unnest(alias_keys), 2 FROM keyed) k
  ON n.needle <> '' AND k.key = n.needle
  GROUP BY n.query_id, k.id, k.kind, k.title, k.document),
counts AS (
  SELECT n.query_id, n.text, n.needle, count(e.id) AS exact_count
  FROM needles n LEFT JOIN exact e ON e.query_id = n.query_id
  GROUP BY n.query_id, n.text, n.needle)
"""


# ---- statements per registered query ---------------------------------------------------------

_EDGE_GRAPH = (SCHEMA, FAULTY_ENTITIES, FAULTY_EDGES, JUDGED)
_COLUMNS = "status, code, subject, message, witness"
_LOOKUP = (ENTITIES, LOOKUP_KEYS)

NORMALIZED = f"""
raw AS (
  SELECT 'documents' AS origin, doc_id AS number, text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages),
spread AS (
  SELECT origin, number, concat(' ', chr(12288), replace(replace(replace(replace(text, 'é',
    concat('e', chr(769))), 'ü', concat('u', chr(776))), 'ñ', concat('n', chr(771))), chr(10),
    concat(chr(13), chr(10))), chr(13)) AS text FROM raw)
SELECT origin, number, md5({_clean("text")}) AS clean,
  md5(lower(nfc_normalize(trim(text, concat(' ', chr(9), chr(10), chr(13), chr(12288))))))
    AS lookup_key,
  CAST(length({_clean("text")}) AS BIGINT) AS n_chars,
  CAST(len(string_split({_clean("text")}, chr(10))) AS BIGINT) AS n_lines
FROM spread
"""

MARKDOWN = r"""
SELECT concat('kb/doc/', doc_id, '.md') AS document,
  CASE WHEN ok THEN concat('doc:', doc_id) END AS id, CASE WHEN ok THEN 'Doc' END AS kind,
  CASE WHEN ok THEN regexp_replace(string_split(text, chr(10))[1], '[\\"[:cntrl:]]', ' ', 'g')
    END AS title,
  CASE WHEN ok THEN concat(lang, ',yes,017') END AS aliases,
  CASE WHEN ok THEN concat('quotes>source:', source, '>x>1-2>a', chr(10), 'b>') END AS relations,
  CASE fault WHEN 3 THEN 'must start with YAML frontmatter'
    WHEN 4 THEN 'YAML frontmatter is missing closing delimiter'
    WHEN 5 THEN 'id must not be empty' WHEN 6 THEN 'invalid frontmatter' END AS error
FROM (SELECT *, doc_id % 10 AS fault, doc_id % 10 NOT IN (3, 4, 5, 6) AS ok FROM documents)
"""

CYCLES = """
reach AS (
  SELECT relation, src AS a, dst AS b FROM edges
  UNION SELECT r.relation, r.a, e.dst FROM reach r JOIN edges e
    ON e.relation = r.relation AND e.src = r.b),
looping AS (SELECT DISTINCT relation, a AS node FROM reach WHERE a = b),
upstream AS (
  SELECT relation, node FROM looping
  UNION SELECT r.relation, r.a FROM reach r JOIN looping l
    ON l.relation = r.relation AND l.node = r.b),
declared(relation) AS (VALUES ('precedes'), ('follows'), ('refers'), ('caused_by'), ('unused'))
"""
WITNESS_WALK = """
least AS (
  SELECT e.relation, e.src, min(e.dst) AS next FROM edges e
  JOIN upstream s ON s.relation = e.relation AND s.node = e.src
  JOIN upstream d ON d.relation = e.relation AND d.node = e.dst GROUP BY e.relation, e.src),
walk AS (
  SELECT relation, [min(src)] AS path FROM least GROUP BY relation
  UNION SELECT w.relation, list_append(w.path, l.next) FROM walk w JOIN least l
    ON l.relation = w.relation AND l.src = w.path[-1]
  WHERE NOT list_contains(w.path[1:len(w.path) - 1], w.path[-1])),
closed AS (
  SELECT relation, path[list_position(path, path[-1]):] AS loop FROM walk
  WHERE list_contains(path[1:len(path) - 1], path[-1]))
"""

_VALID_CYCLES = """
ordered AS (SELECT relation, src, dst FROM judged WHERE domain_ok AND range_ok
  AND relation IN (SELECT relation FROM relations WHERE acyclic)),
reach AS (
  SELECT relation, src AS a, dst AS b FROM ordered
  UNION SELECT r.relation, r.a, e.dst FROM reach r JOIN ordered e
    ON e.relation = r.relation AND e.src = r.b),
looping AS (SELECT DISTINCT relation FROM reach WHERE a = b)
"""
_VALID_GRAPH = (
    SCHEMA, WHOLE_ENTITIES, WHOLE_EDGES, JUDGED, EDGE_VERDICTS, ENTITY_VERDICTS, CARDINALITY, QUOTES,
    RESOLVED, EVIDENCE_VERDICTS, _VALID_CYCLES,
)
_EVERY_VERDICT = """
SELECT status, code FROM entity_verdicts
UNION ALL SELECT status, code FROM edge_verdicts
  WHERE code <> 'edge.evidence' OR NOT contains(subject, ' --quotes--> ')
UNION ALL SELECT status, code FROM evidence_verdicts
UNION ALL SELECT status, code FROM shape_verdicts
UNION ALL SELECT 'satisfied', 'schema.version'
UNION ALL SELECT 'satisfied', 'relation.contract' FROM relations
UNION ALL SELECT 'satisfied', 'shape.contract' FROM shapes
UNION ALL SELECT CASE WHEN l.relation IS NULL THEN 'satisfied' ELSE 'violated' END,
  CASE WHEN l.relation IS NULL THEN 'relation.acyclic' ELSE 'relation.cycle' END
  FROM relations r LEFT JOIN looping l ON l.relation = r.relation WHERE r.acyclic
"""


def _compile() -> dict[str, str]:
    return {
        "compile_entities": """
          SELECT concat('order:', o_orderkey) AS id, 'Order' AS kind,
            CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE concat('order:', o_orderkey)
              END AS title, o_orderstatus AS aliases,
            concat('kb/order/', o_orderkey, '.md') AS document FROM orders""",
        "compile_edges": """
          SELECT concat('order:', o_orderkey) AS src, relation, dst,
            concat('kb/order/', o_orderkey, '.md') AS declaration,
            CAST(decl_ordinal AS BIGINT) AS decl_ordinal, o_orderpriority AS quote
          FROM (
            SELECT *, 'placed_by' AS relation, concat('customer:', o_custkey) AS dst,
              CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS decl_ordinal FROM orders
            UNION ALL SELECT *, 'billed_in', concat('nation:', o_custkey % 25),
              CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END FROM orders
            UNION ALL SELECT *, 'checked_by', concat('supplier:', o_orderkey % 10), 0 FROM orders
              WHERE o_orderstatus = 'F')""",
        "selector_explode": _with(QUOTES) + """
          SELECT src, 'quotes' AS relation, dst, declaration, CAST(sel AS BIGINT) AS sel_ordinal,
            path AS source, exact, prefix, suffix, CAST(hint_start AS BIGINT) AS hint_start,
            CAST(hint_end AS BIGINT) AS hint_end FROM selectors""",
        "ingest_markdown": MARKDOWN,
        "normalize_text": "WITH " + NORMALIZED.strip(),
    }


def _rules() -> dict[str, str]:
    edge_rules = _with(*_EDGE_GRAPH, EDGE_VERDICTS)
    return {
        "schema_rules": SCHEMA_RULES,
        "entity_rules": _with(SCHEMA, FAULTY_ENTITIES, ENTITY_VERDICTS)
        + f"SELECT {_COLUMNS} FROM entity_verdicts",
        "report_json": _with(SCHEMA, FAULTY_ENTITIES, ENTITY_VERDICTS) + """
          SELECT concat('{"status":"', status, '","code":"', code, '","subject":"', subject,
            '","message":"', message, '","witness":[',
            CASE WHEN starts_with(witness, 'schema>') THEN concat('{"kind":"schema","path":"',
              split_part(split_part(witness, ' | ', 1), '>', 2), '"},') ELSE '' END,
            '{"kind":"declaration","path":"', split_part(witness, 'declaration>', 2), '"}]}') AS json
          FROM entity_verdicts""",
        "report_rows": _with(SCHEMA, FAULTY_ENTITIES, ENTITY_VERDICTS, CYCLIC_EDGES, CYCLES, recursive=True) + f"""
          SELECT row_number() OVER (ORDER BY phase, key, document, code <> 'entity.invalid_id', code) AS position,
            concat('{{"status":"', status, '","code":"', code, '","subject":"', subject, '","message":"', message,
              '","witness":[', CASE WHEN path <> '' THEN concat('{{"kind":"schema","path":"', path, '"}}') ELSE '' END,
              CASE WHEN path <> '' AND document <> '' THEN ',' ELSE '' END,
              CASE WHEN document <> '' THEN concat('{{"kind":"declaration","path":"', document, '"}}') ELSE '' END, ']}}') AS json
          FROM (
            SELECT 4 AS phase, subject AS key, status, code, subject, message, split_part(witness, 'declaration>', 2) AS document,
              CASE WHEN starts_with(witness, 'schema>') THEN split_part(split_part(witness, ' | ', 1), '>', 2) ELSE '' END AS path
            FROM entity_verdicts
            UNION ALL
            SELECT 7, d.relation, CASE WHEN c.relation IS NULL THEN 'satisfied' ELSE 'violated' END,
              CASE WHEN c.relation IS NULL THEN 'relation.acyclic' ELSE 'relation.cycle' END, concat('relation:', d.relation),
              CASE WHEN c.relation IS NULL THEN {_say("relation.acyclic")} ELSE {_say("relation.cycle", "d.relation")} END, '',
              concat('schema.yaml:relations.', d.relation, '.acyclic')
            FROM declared d LEFT JOIN (SELECT DISTINCT relation FROM looping) c ON c.relation = d.relation)""",
        "entity_order": _with(SCHEMA, FAULTY_ENTITIES)
        + "SELECT id, document, row_number() OVER (ORDER BY id, document) AS position FROM entities",
        "edge_order": _with(*_EDGE_GRAPH) + """
          SELECT src, relation, dst, declaration, row_number() OVER (ORDER BY src, relation, dst, declaration) AS position FROM edges""",
        "edge_rules": edge_rules + f"SELECT {_COLUMNS} FROM edge_verdicts",
        "open_verdicts": edge_rules
        + f"SELECT {_COLUMNS} FROM edge_verdicts WHERE status <> 'satisfied'",
        "edge_duplicates": _with(*_EDGE_GRAPH)
        + "SELECT src, relation, dst, declaration FROM judged WHERE nth > 1",
        "cardinality": _with(*_EDGE_GRAPH, CARDINALITY) + f"SELECT {_COLUMNS} FROM shape_verdicts",
        "cardinality_assertions": _with(*_EDGE_GRAPH) + """
          SELECT concat(src, ':', j.relation) AS subject, k.kind, j.relation, j.src, j.dst,
            j.declaration
          FROM judged j JOIN (SELECT DISTINCT id, kind FROM entities) k ON k.id = j.src
          JOIN shapes s ON s.kind = k.kind AND s.relation = j.relation
          WHERE domain_ok AND range_ok""",
        "cycle_detect": _with(CYCLIC_EDGES, CYCLES, recursive=True) + f"""
          SELECT CASE WHEN c.relation IS NULL THEN 'satisfied' ELSE 'violated' END AS status,
            CASE WHEN c.relation IS NULL THEN 'relation.acyclic' ELSE 'relation.cycle' END AS code,
            concat('relation:', d.relation) AS subject,
            CASE WHEN c.relation IS NULL THEN {_say("relation.acyclic")}
              ELSE {_say("relation.cycle", "d.relation")} END AS message,
            concat('schema>schema.yaml:relations.', d.relation, '.acyclic') AS witness
          FROM declared d LEFT JOIN (SELECT DISTINCT relation FROM looping) c
            ON c.relation = d.relation""",
        "cycle_witness": _with(CYCLIC_EDGES, CYCLES, WITNESS_WALK, recursive=True) + """
          SELECT relation, CAST(nth - 1 AS BIGINT) AS position, loop[nth] AS node
          FROM (SELECT *, unnest(range(1, len(loop) + 1)) AS nth FROM closed)""",
        "validate_codes": _with(*_VALID_GRAPH, recursive=True)
        + f"SELECT status, code, count(*) AS n FROM ({_EVERY_VERDICT}) GROUP BY status, code",
        "report_summary": _with(*_VALID_GRAPH, recursive=True) + f"""
          SELECT count(*) FILTER (status = 'satisfied') AS satisfied,
            count(*) FILTER (status = 'violated') AS violated,
            count(*) FILTER (status = 'unknown') AS unknown,
            count(*) FILTER (status = 'violated') = 0 AS can_query,
            count(*) FILTER (status <> 'satisfied') = 0 AS is_complete
          FROM ({_EVERY_VERDICT})""",
    }


def _evidence() -> dict[str, str]:
    return {
        "evidence_resolve": _with(QUOTES, RESOLVED) + """
          SELECT src, dst, declaration, CAST(sel AS BIGINT) AS sel_ordinal, state, source, exact,
            start_line, end_line, message FROM resolved""",
        "evidence_corpus": _with(LINES, RESOLVED) + """
          SELECT src, CAST(sel AS BIGINT) AS sel_ordinal, state, start_line, end_line, message
          FROM resolved""",
        "evidence_verdicts": _with(QUOTES, RESOLVED, EVIDENCE_VERDICTS)
        + f"SELECT {_COLUMNS} FROM evidence_verdicts",
        "explain": _with(QUOTES, RESOLVED) + """
          SELECT request_id, src, relation, dst, declaration, CAST(sel AS BIGINT) AS sel_ordinal,
            state, source, exact, start_line, end_line, message
          FROM (SELECT src AS request_id, * FROM resolved
            UNION ALL SELECT dst, * FROM resolved)""",
    }


def _graph() -> dict[str, str]:
    neighbourhood = _with(ENTITIES, EDGES, ROOTS, recursive=True)
    paths = _with(ENTITIES, EDGES, PATHS, recursive=True)
    return {
        "adjacency": _with(FAULTY_EDGES) + """
          SELECT 'undirected' AS view, src AS node, dst AS next, NULL AS relation,
            NULL AS declaration FROM edges
          UNION SELECT 'undirected', dst, src, NULL, NULL FROM edges
          UNION ALL SELECT 'directed', src, dst, relation, declaration FROM edges
          UNION ALL SELECT 'directed', dst, src, relation, declaration FROM edges
            WHERE relation = 'peer'""",
        "neighborhood_nodes": neighbourhood + """
          SELECT m.root AS request_id, e.id, m.level, e.kind, e.title, e.document
          FROM members m JOIN entities e ON e.id = m.node""",
        "neighborhood_edges": neighbourhood + """
          SELECT s.root AS request_id, e.src, e.relation, e.dst, e.declaration
          FROM edges e JOIN members s ON s.node = e.src
          JOIN members d ON d.node = e.dst AND d.root = s.root""",
        "shortest_path": paths + """
          SELECT concat(a, '->', b) AS request_id, a AS "from", b AS "to",
            CASE WHEN bad THEN NULL ELSE a = b OR path IS NOT NULL END AS found,
            CASE WHEN bad THEN NULL WHEN a = b THEN 0 ELSE CAST(len(path) - 1 AS INTEGER) END
              AS hops,
            CASE WHEN a NOT IN (SELECT id FROM entities)
                THEN concat('unknown entity ', chr(39), a, chr(39))
              WHEN b NOT IN (SELECT id FROM entities)
                THEN concat('unknown entity ', chr(39), b, chr(39)) END AS error
          FROM (SELECT *, a NOT IN (SELECT id FROM entities)
              OR b NOT IN (SELECT id FROM entities) AS bad
            FROM asked LEFT JOIN best ON best.start = a AND best.node = b)""",
        "shortest_path_steps": paths + """
          SELECT concat(p.a, '->', p.b) AS request_id, CAST(nth - 1 AS INTEGER) AS hop,
            path[nth] AS src, x.via.relation AS relation, path[nth + 1] AS dst,
            x.via.declaration AS declaration
          FROM (SELECT asked.*, best.path, unnest(range(1, len(best.path))) AS nth
            FROM asked JOIN best ON best.start = asked.a AND best.node = asked.b
            WHERE asked.b IN (SELECT id FROM entities)) p
          JOIN arcs x ON x.a = p.path[p.nth] AND x.b = p.path[p.nth + 1]""",
    }


def _lookups() -> dict[str, str]:
    exact = _with(*_LOOKUP, EXACT_MATCHES)
    return {
        "lookup": _with(*_LOOKUP, ALL_MATCHES) + """
          SELECT query_id, match, CAST(position AS INTEGER) AS position, id, kind, title, document
          FROM (SELECT *, ['id', 'title', 'alias', 'contains'][rank + 1] AS match, row_number() OVER
            (PARTITION BY query_id ORDER BY rank, id, document) AS position FROM matches)
          WHERE position <= 10""",
        "lookup_all": _with(*_LOOKUP, ALL_MATCHES) + """
          SELECT query_id, ['id', 'title', 'alias', 'contains'][rank + 1] AS match,
            count(*) AS n, min(id) AS first_id, max(id) AS last_id
          FROM matches GROUP BY query_id, rank""",
        "decide_requests": exact + """
          SELECT query_id, needle, exact_count,
            CASE exact_count WHEN 0 THEN 'all' ELSE 'exact' END AS scope
          FROM counts WHERE exact_count <> 1""",
        "decide_candidates": exact + """
          SELECT DISTINCT c.needle, CAST(e.rank AS INTEGER) AS rank, e.id, e.kind, e.title,
            e.document
          FROM exact e JOIN counts c ON c.query_id = e.query_id WHERE c.exact_count > 1""",
        "decide_apply": exact + """,
          firsts AS (SELECT query_id, min(id) AS first_id, bool_or(id = 'region:0') AS has_region
            FROM exact GROUP BY query_id)
          SELECT query_id, CASE WHEN error IS NULL THEN picked END AS entity_id,
            CASE WHEN error IS NULL THEN e.kind END AS kind,
            CASE WHEN error IS NULL THEN e.document END AS document,
            CASE WHEN error IS NULL THEN confidence END AS confidence, error
          FROM (SELECT *, CASE case_no WHEN 1 THEN 'region:0' WHEN 7 THEN first_id END AS picked,
              CASE case_no WHEN 1 THEN 0.25::DOUBLE WHEN 7 THEN 0.5::DOUBLE END AS confidence,
              CASE WHEN case_no = 1 AND exact_count > 0 AND NOT has_region THEN
                  concat('decision adapter returned entity ', chr(39), 'region:0', chr(39),
                    ' outside the candidate set')
                WHEN case_no = 2 THEN
                  concat('decision adapter returned entity ', chr(39), 'nope', chr(39),
                    ' outside the candidate set')
                WHEN case_no = 3 THEN
                  'decision adapter confidence must be finite and within 0..=1'
                WHEN case_no = 4 THEN 'invalid decision response: unknown field `note`'
                WHEN case_no = 5 THEN
                  'invalid decision response: entity_id must be a string or null'
                WHEN case_no = 8 THEN 'no answer for this request' END AS error
            FROM (SELECT c.query_id, c.exact_count, f.first_id, f.has_region,
                length(c.text) % 9 AS case_no
              FROM counts c LEFT JOIN firsts f ON f.query_id = c.query_id
              WHERE exact_count <> 1)) q
          LEFT JOIN entities e ON e.id = q.picked""",
    }


def statements() -> dict[str, str]:
    """The oracle of every registered query that plain SQL can express."""
    return {**_compile(), **_rules(), **_evidence(), **_graph(), **_lookups()}
