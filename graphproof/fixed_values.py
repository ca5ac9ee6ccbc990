"""Fixed values.

Everything in this module has to equal the published format of the evidence graph
(verdict codes, message texts, protocol constants), so it is kept together as plain text.
``{}`` marks an interpolated value.
"""

SCHEMA_VERSION = 1

STATUS_SATISFIED = "satisfied"
STATUS_VIOLATED = "violated"
STATUS_UNKNOWN = "unknown"

STATE_VALID = "valid"
STATE_RELOCATED = "relocated"
STATE_STALE = "stale"
STATE_AMBIGUOUS = "ambiguous"
STATE_MISSING = "missing"
STATE_INVALID = "invalid"

# fixed values: machine keys (ids, type names, relation names)
KEY_PATTERN = r"\A[A-Za-z0-9._:-]+\z"

# fixed values: frontmatter delimiters
FRONT_OPEN = "---\n"
FRONT_CLOSE = "\n---\n"

# fixed values: verdict messages, keyed by verdict code
MESSAGES = {
    "schema.version": "schema version {} is supported",
    "schema.version.unsupported": "unsupported schema version {}; expected {}",
    "type.invalid_name": "type name must contain only ASCII letters, digits, '.', '_', ':', or '-'",
    "relation.invalid_name": "relation name must contain only ASCII letters, digits, '.', '_', ':', or '-'",
    "relation.missing_domain": "relation must declare from; use ['*'] for any source type",
    "relation.missing_range": "relation must declare to; use ['*'] for any target type",
    "relation.invalid_policy": "a symmetric relation cannot also be acyclic",
    "relation.symmetric_type_mismatch": "a symmetric relation must declare the same source and target type set",
    "relation.unknown_type": "relation references unknown type '{}'",
    "relation.contract": "relation contract is valid",
    "shape.unknown_relation": "constraint references unknown relation '{}'",
    "shape.empty": "constraint must declare min and/or max",
    "shape.invalid_range": "constraint min must not exceed max",
    "shape.invalid_domain": "type '{}' cannot be a source of relation '{}'",
    "shape.contract": "cardinality constraint is valid",
    "entity.invalid_id": "entity id must contain only ASCII letters, digits, '.', '_', ':', or '-'",
    "entity.duplicate_id": "entity '{}' is declared more than once",
    "entity.type": "entity type '{}' is declared by schema",
    "entity.unknown_type": "unknown entity type '{}'",
    "edge.missing_source": "source entity '{}' does not exist",
    "edge.missing_target": "target entity '{}' does not exist",
    "edge.unknown_relation": "relation '{}' is not declared by schema",
    "edge.duplicate_assertion": "the same semantic assertion is declared more than once",
    "edge.domain_mismatch": "relation '{}' does not accept source type '{}'",
    "edge.range_mismatch": "relation '{}' does not accept target type '{}'",
    "edge.structure": "typed relation is structurally valid",
    "edge.evidence": "relation is declared but has no evidence selector",
    "evidence.resolved": "evidence quote resolves uniquely",
    "shape.cardinality.violated": "relation '{}' count is {}; expected {}",
    "shape.cardinality.satisfied": "relation '{}' count {} satisfies shape",
    "relation.cycle": "relation '{}' must be acyclic",
    "relation.acyclic": "no cycle found",
}

# fixed values: evidence messages
EVIDENCE_MESSAGES = {
    "empty_exact": "evidence exact quote must not be empty",
    "bad_hint": "evidence hint must be a valid one-based inclusive line range",
    "absolute": "evidence source must be relative: {}",
    "escape": "evidence source may not escape workspace: {}",
    "missing": "evidence source does not exist",
    "not_utf8": "stream did not contain valid UTF-8",
    "directory": "Is a directory (os error 21)",
    "gone": "exact quote is no longer present",
    "context": "exact quote exists but declared prefix/suffix context no longer matches",
    "ambiguous_context": "selector matches {} locations; provide more distinguishing context",
    "ambiguous": "exact quote appears {} times; add prefix/suffix context",
    "relocated": "quote resolved uniquely at a different line range; the hint is stale but evidence is valid",
}

# fixed values: schema paths shown in witnesses
PATH_VERSION = "schema.yaml:version"
PATH_TYPE = "schema.yaml:types.{}"
PATH_SHAPE = "schema.yaml:types.{}.constraints.{}"
PATH_RELATION = "schema.yaml:relations.{}"
PATH_RELATION_FROM = "schema.yaml:relations.{}.from"
PATH_RELATION_TO = "schema.yaml:relations.{}.to"
PATH_RELATION_ACYCLIC = "schema.yaml:relations.{}.acyclic"

# fixed values: verdict subjects
SUBJECT_SCHEMA = "schema"
SUBJECT_TYPE = "type:{}"
SUBJECT_RELATION = "relation:{}"
SUBJECT_SHAPE = "shape:{}.{}"
SUBJECT_ASSERTION = "{} --{}--> {}"
SUBJECT_COUNT = "{}:{}"

# fixed values: ingest errors
DOCUMENT_ERRORS = {
    "no_frontmatter": "{}: knowledge document must start with YAML frontmatter",
    "no_close": "{}: YAML frontmatter is missing closing delimiter",
    "invalid": "{}: invalid frontmatter: {}",
    "blank_id": "{}: id must not be empty",
    "blank_type": "{}: type must not be empty",
    "not_utf8": "stream did not contain valid UTF-8",
}

# fixed values: graph request errors
UNKNOWN_ENTITY = "unknown entity '{}'"
GATE_ERROR = "knowledge graph has {} structural violation(s)"

# fixed values: lookup
MATCH_KINDS = ("id", "title", "alias", "contains")
DEFAULT_LIMIT = 10

# fixed values: decision protocol
DECISION_VERSION = 1
DECISION_SECONDS = 30
DECISION_BYTES = 65_536
DECISION_TASK = "select_entity"
DECISION_ERRORS = {
    "confidence": "decision adapter confidence must be finite and within 0..=1",
    "timeout": "decision adapter '{}' timed out after {} seconds",
    "too_long": "decision adapter '{}' exceeded {} bytes",
    "outside": "decision adapter returned entity '{}' outside the candidate set",
}
