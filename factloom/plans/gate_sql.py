"""DuckDB SQL of the gate, the review flagship, contextual patterns, folded cases and page confidences."""

from __future__ import annotations

from factloom.functions.text import normalized_label
from factloom.operators import extract, gates
from factloom.plans.catalog import ORACLES, PATTERNS, VIEWS


def _oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = f"WITH {', '.join(f'{v} AS ({VIEWS[v]})' for v in views)}{', ' if views else ''}{sql}"


def _list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"


_TEXT = r"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[_\-:;,.()\[\]{{}}©]+', ' ', 'g'), '\s+', ' ', 'g'))"
_EVERY = gates.LABELS + gates.MORE_LABELS + gates.BAD_VALUES
_OWN = " OR ".join(f"(fact_type = '{k}' AND norm IN {_list(words)})" for k, words in gates.ALIASES.items())
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS fact_type, unnest(m) AS value, unnest(range(len(m))) + {n * 1_000_000} AS ord, {confidence}::DOUBLE AS confidence FROM (SELECT doc_id, regexp_extract_all(text, '{regex}') AS m FROM {{0}})" for n, (kind, regex, confidence) in enumerate(PATTERNS))
_GATED = rf"""found AS ({_FOUND}),
    normed AS (SELECT *, CASE WHEN fact_type IN ('iban', 'document_number') THEN upper(regexp_replace(value, '\s+', '', 'g')) ELSE trim(regexp_replace(value, '\s+', ' ', 'g')) END AS value_norm FROM found),
    keyed AS (SELECT *, {_TEXT.format('value_norm')} AS norm, regexp_replace(value_norm, '[^0-9]', '', 'g') AS digits, replace(upper(value_norm), ' ', '') AS compact FROM normed),
    gated AS (SELECT *, CASE
      WHEN norm = '' THEN 'empty'
      WHEN norm = fact_type OR norm IN {_list(_EVERY)} OR contains(norm, 'religious name') OR contains(norm, 'pseudonym') OR contains(norm, 'prenoms') OR contains(norm, 'prénoms') OR starts_with(norm, 'residence') OR {_OWN}
        OR (fact_type = 'phone_number' AND regexp_matches(norm, '\b(?:{'|'.join(sorted(set(_EVERY)))})\b')) THEN 'label'
      WHEN len(norm) <= 1 OR regexp_matches(value_norm, '[©\[\]{{{{}}}}]') OR (contains(value_norm, '<<') AND NOT (regexp_full_match(compact, '[A-Z0-9<]{{{{25,44}}}}') AND contains(compact, '<'))) OR norm IN {_list(gates.GARBLED)}
        OR (len(regexp_replace(value_norm, '[^A-Za-z]', '', 'g')) >= 7 AND NOT regexp_matches(regexp_replace(value_norm, '[^A-Za-z]', '', 'g'), '[aeiouAEIOU]')) THEN 'junk'
      WHEN NOT CASE fact_type
        WHEN 'phone_number' THEN NOT regexp_matches(value_norm, '\b\d{{{{1,2}}}}[./-]\d{{{{1,2}}}}[./-]\d{{{{2,4}}}}\b') AND NOT regexp_matches(value_norm, '\d+[.]\d+') AND regexp_matches(value_norm, '(^|\s|\()(\+|00)\d') AND len(digits) BETWEEN 9 AND 16 AND len(list_distinct(string_split(digits, ''))) > 2
        WHEN 'date' THEN regexp_matches(value_norm, '\b\d{{{{1,2}}}}[./-]\d{{{{1,2}}}}[./-]\d{{{{2,4}}}}\b') WHEN 'document_number' THEN regexp_full_match(upper(value_norm), '[A-Z]{{{{1,3}}}}\d{{{{5,10}}}}') WHEN 'iban' THEN regexp_full_match(compact, '[A-Z]{{{{2}}}}\d{{{{2}}}}[A-Z0-9]{{{{10,30}}}}')
        WHEN 'email' THEN regexp_full_match(value_norm, '(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{{{{2,}}}}') ELSE regexp_matches(value_norm, '\d') AND regexp_matches(norm, 'eur|€') END THEN fact_type END AS reject_reason FROM keyed)""".replace("{{", "{").replace("}}", "}")

_oracle("quality_gate", _GATED.replace("{0}", "texts") + " SELECT doc_id, fact_type, value_norm, confidence, reject_reason FROM gated", "texts")
_oracle(
    "review_flagship",
    _GATED.replace("{0}", "documents")
    + """, once AS (SELECT * FROM gated WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id, fact_type, lower(value_norm) ORDER BY ord) = 1),
    held AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 0 WHEN confidence >= 0.8 THEN 1 WHEN confidence >= 0.7 THEN 2 WHEN confidence >= 0.6 THEN 3 WHEN confidence >= 0.5 THEN 4 ELSE 5 END AS bucket FROM once),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY confidence DESC, ord) AS rank FROM held)
    SELECT doc_id AS entity_id, fact_type, value_norm AS value, confidence, CASE WHEN confidence < 0.4 THEN 'HIGH' WHEN confidence < 0.6 THEN 'NORMAL' ELSE 'LOW' END AS priority, bucket, rank FROM ranked WHERE rank <= 20""",
)
_CONTEXTS = " UNION ALL ".join(
    f"SELECT doc_id, line, '{p.fact_type}' AS fact_type, upper(unnest(regexp_extract_all(l, '{p.regex}'))) AS value, {p.confidence}::DOUBLE AS confidence FROM k WHERE regexp_matches({_TEXT.format('l')}, '\\b(?:{'|'.join(normalized_label(x) for x in labels)})\\b')"
    for p, labels in extract.CONTEXTUAL
)
_oracle(
    "contextual_patterns",
    rf"""c AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(lower(x), 'https?://|www\.')) AS ls FROM texts),
    k AS (SELECT doc_id, unnest(ls) AS l, CAST(unnest(range(len(ls))) AS INT) AS line FROM c) {_CONTEXTS}""",
    "texts",
)
ORACLES["case_states"] = """SELECT * FROM (WITH RECURSIVE e AS (
      SELECT user_id AS case_id, ['assign', 'start', 'escalate', 'complete', 'cancel'][CAST(event_id % 5 AS INT) + 1] AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, action) AS n FROM events
    ), s AS (
      SELECT DISTINCT case_id, 0::BIGINT AS n, 'PENDING' AS status, 'NORMAL' AS priority, 0 AS refused FROM e
      UNION ALL
      SELECT case_id, n, coalesce(target, status), CASE WHEN action = 'escalate' AND target IS NOT NULL THEN 'CRITICAL' ELSE priority END, refused + (target IS NULL)::INT FROM (
        SELECT s.case_id, e.n, s.status, s.priority, s.refused, e.action, CASE WHEN action = 'assign' THEN 'ASSIGNED' WHEN action = 'start' AND status = 'ASSIGNED' THEN 'IN_REVIEW' WHEN action = 'complete' AND status = 'IN_REVIEW' THEN 'COMPLETED'
          WHEN action = 'escalate' AND status = 'IN_REVIEW' THEN 'PENDING' WHEN action = 'cancel' AND status NOT IN ('COMPLETED', 'CANCELLED') THEN 'CANCELLED' END AS target FROM s JOIN e ON e.case_id = s.case_id AND e.n = s.n + 1)
    ) SELECT case_id, status, priority, refused FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC) = 1)"""
_MEAN = "((2 * sum(CAST(round({0} * 100000000) AS BIGINT)) + count(*) * 10000) // (2 * count(*) * 10000)) / 10000.0::DOUBLE"
ORACLES["page_confidences"] = f"SELECT doc_id, {_MEAN.format('conf')} AS conf, count(*) AS pages FROM (SELECT l_orderkey AS doc_id, l_linenumber, {_MEAN.format('l_discount')} AS conf FROM lineitem GROUP BY ALL) GROUP BY doc_id"
