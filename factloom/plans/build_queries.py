"""Queries of decisions about candidates and of the build of knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import build, decisions
from factloom.operators.hints import CONTEXT_KEYS, FIELDS, HINTS, JUNK, LABELS, OTHER_PARTY, PHONE_PREFIXES, TITLES, WEAK_JUNK
from factloom.plans.catalog import VIEWS, query
from factloom.sources import candidates as _  # noqa: F401  registers candidate_rows
from factloom.sources.records import record, sql
from factloom.sources.tables import spread

VIEWS["candidate_rows"] = sql("candidate_rows")
#: Today, for the queries.
AS_OF = "2024-06-15"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(record(spark, d, "candidate_rows"))
    rows = decisions.held(rows, **{c: F.col(c) for c in rows.columns})  # long lists of cases
    keys = {"target_field": "target_field", "line_text": "around", "source": "source", "auto_accept": "auto_accept", "role": "role", "is_person_fact": "is_person", "store_as_knowledge_evidence": "as_evidence"}
    metadata = F.map_filter(F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), F.col(c))]), lambda k, v: v.isNotNull())
    return rows.select("candidate_id", "entity_id", "document_id", "source_id", "fact_type", F.col("value").alias("raw_value"), F.col("value").alias("normalized_value"), "source_stage", "confidence", metadata.alias("metadata"))


def _in(field: str, group: str) -> str:
    return f"{field} IN ({', '.join(repr(x) for x in FIELDS[group])})"


def _words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _near(side: str, *families: str) -> str:
    return f"list_has_any({side}, {list(families)})"


_HINT_ROWS = ", ".join(f"('{family}', '{word.replace(chr(39), chr(39) * 2)}')" for family, words in HINTS.items() for word in words)
_OTHERS = _near("c", *OTHER_PARTY)
_ADDRESS = rf"(regexp_matches(lv, '\b\d{{5}}\s+[a-zäöüß][a-zäöüß\-\s]{{2,}}\b') OR ({_near('n', 'street')} AND regexp_matches(lv, '\b\d+[a-z]?\b')) OR (regexp_matches(lv, '\b\d{{5}}\b') AND words >= 2))"
_DATE = r"regexp_matches(trim(value), '^(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{6}|\d{8})$')"
_PERSONAL = rf"""(({_in('f', 'name')} AND ({_near('c', 'birth')} OR regexp_full_match(v, '[A-ZÄÖÜ][a-zäöüß]+([-\s][A-ZÄÖÜ][a-zäöüß]+){{0,3}}')))
  OR (f = 'date_of_birth' AND {_DATE}) OR ({_in('f', 'address')} AND {_ADDRESS}))"""
_CONTACT = f"({_in('f', 'contact')} AND ({_OTHERS} OR ({_in('f', 'phone')} AND {_near('c', 'phone_noise')}) OR (f IN ('email', 'contact_email') AND {_near('n', 'office_mail', 'organization')})))"
_ORG_NAME = rf"({_in('f', 'name')} AND ({_near('n', 'organization')} OR ({_OTHERS} AND words >= 2) OR regexp_matches(lv, '\b[a-zäöüß]+straße\b') OR regexp_matches(lv, '\b[a-zäöüß]+str\.\b') OR regexp_matches(lv, '\b\d{{5}}\b')))"
_ORG_IBAN = f"(f IN ('iban', 'organization_iban') AND ({_OTHERS} OR {_near('c', 'payee')}))"
_PHONE = rf"""({_in('f', 'phone')} AND (len(digits) < 10 OR len(digits) > 16 OR {' OR '.join(f"starts_with(lv, '{p}')" for p in PHONE_PREFIXES)} OR f = 'fax' OR {_OTHERS} OR {_near('c', 'phone_noise')}
  OR regexp_matches(ctx, '\bfax\b') OR regexp_matches(v, '\b\d{{3,5}}\s*/\s*\d{{3,8}}\b') OR regexp_matches(v, '\b\d{{3,5}}\s*-\s*\d{{3,8}}\s*-\s*\d{{1,5}}\b') OR regexp_full_match(v, '0\d{{2,5}}[-\s]\d{{3,8}}([-\s]\d{{1,5}})?')
  OR (regexp_matches(v, '\b\d{{2,5}}[-\s]\d{{3,8}}([-\s]\d{{1,5}})?\b') AND NOT (starts_with(lv, '+49') OR starts_with(lv, '0049') OR starts_with(lv, '01')))))"""
_REFERENCE = rf"({_in('f', 'reference')} AND (len(v) <= 3 OR {_near('n', 'reference_noise')} OR {_near('c', 'form', 'authority', 'health', 'tax', 'bank')} OR NOT regexp_matches(lv, '[0-9a-zäöüß]') OR regexp_full_match(lv, '[a-zäöüß\s\-]{{4,}}')))"
_LABEL = f"(v = '' OR lv IN {_words(LABELS)} OR (len(v) <= 2 AND NOT regexp_full_match(v, '[0-9]+')))"
_JUNK = rf"""(len(v) <= 2 OR lv IN {_words(JUNK)} OR NOT regexp_matches(lv, '[0-9a-zäöüß]') OR (regexp_full_match(v, '[-–—]*[a-zA-Z]{{1,3}}[-–—]*') AND f NOT IN ('sex', 'gender')) OR ({_in('f', 'weak')} AND lv IN {_words(WEAK_JUNK)})
  OR (contains(v, '@') AND f NOT IN ('email', 'contact_email')) OR (f IN ('surname', 'given_names', 'first_name', 'last_name') AND regexp_matches(v, '\d')) OR {_near('n', 'form_value')}
  OR (len(v) >= 5 AND ((words >= 8 AND NOT regexp_matches(v, '\d')) OR len(regexp_replace(v, '[^(]', '', 'g')) <> len(regexp_replace(v, '[^)]', '', 'g')) OR regexp_matches(v, '[|{{}}<>]') OR regexp_matches(lv, '\b[a-z]{{1,2}}\s+[a-z]{{1,2}}\s+[a-z]{{1,2}}\b'))))"""
_DATE_CASES = "\n".join(f"WHEN {_near('c', family)} THEN ['near_{family}', '{name}']" for family, name in decisions.DATE_FAMILIES)
_CALLED = "\n".join(f"WHEN field IN {_words(names)} THEN ['called_{name}', '{name}']" if len(names) > 1 else f"WHEN field = '{names[0]}' THEN ['called_{name}', '{name}']" for name, names in decisions.DATE_NAMES)
_YEARS = f"(year(DATE '{AS_OF}') - year(day) - CASE WHEN strftime(DATE '{AS_OF}', '%m%d') < strftime(day, '%m%d') THEN 1 ELSE 0 END)"
_DECISION_SQL = rf"""
  hint(family, word) AS (VALUES {_HINT_ROWS}),
  k0 AS (
    SELECT *, trim(regexp_replace(value, '\s+', ' ', 'g')) AS v, trim(lower(CASE WHEN coalesce(target_field, '') <> '' THEN target_field ELSE fact_type END)) AS field, lower(trim(coalesce(target_field, ''))) AS target,
      lower(trim(concat_ws(' ', fact_type, value, value, source_stage, target_field, around))) AS ctx, regexp_replace(value, '\D', '', 'g') AS digits
    FROM candidate_rows
  ), contexts AS (
    SELECT ctx, list(DISTINCT family) AS c FROM (SELECT DISTINCT ctx FROM k0) JOIN hint ON contains(ctx, word) GROUP BY ctx
  ), in_values AS (
    SELECT v, list(DISTINCT family) AS n FROM (SELECT DISTINCT v FROM k0) JOIN hint ON contains(lower(v), word) GROUP BY v
  ), k1 AS (
    SELECT k0.*, lower(k0.v) AS lv, len(string_split(k0.v, ' ')) AS words, coalesce(c, []) AS c, coalesce(n, []) AS n,
      TRY_CAST(CASE WHEN regexp_matches(v, '^\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}$') THEN
          CASE WHEN len(regexp_extract(v, '(\d+)$', 1)) = 2 THEN CASE WHEN CAST(regexp_extract(v, '(\d+)$', 1) AS INT) > 30 THEN '19' ELSE '20' END ELSE '' END || regexp_extract(v, '(\d+)$', 1) || '-' || regexp_extract(v, '^\d+[./-](\d+)', 1) || '-' || regexp_extract(v, '^(\d+)', 1)
        WHEN regexp_matches(v, '^\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}$') THEN regexp_replace(v, '[./]', '-', 'g')
        WHEN len(digits) = 8 AND CAST(digits[1:4] AS INT) BETWEEN 1900 AND 2100 THEN digits[1:4] || '-' || digits[5:6] || '-' || digits[7:8]
        WHEN len(digits) = 8 THEN digits[5:8] || '-' || digits[3:4] || '-' || digits[1:2]
        WHEN len(digits) = 6 THEN CASE WHEN CAST(digits[5:6] AS INT) > 30 THEN '19' ELSE '20' END || digits[5:6] || '-' || digits[3:4] || '-' || digits[1:2] END AS DATE) AS day
    FROM k0 LEFT JOIN contexts USING (ctx) LEFT JOIN in_values USING (v)
  ), k2 AS (
    SELECT *, field AS f, ({_in('field', 'date')} OR {_in('fact_type', 'date')} OR {_DATE}) AS dated,
      CASE WHEN target IN ('date_of_birth', 'date_of_issue', 'date_of_expiry') THEN ['named', target]
        {_DATE_CASES}
        WHEN target IN ('date', 'date_value') THEN ['target_date', 'date'] WHEN {_in('target', 'date')} THEN ['target', target]
        {_CALLED}
        WHEN day IS NULL THEN ['no_such_day', 'date'] WHEN day > DATE '{AS_OF}' AND year(day) >= year(DATE '{AS_OF}') + 2 THEN ['far_ahead', 'expiry_date'] WHEN day > DATE '{AS_OF}' THEN ['ahead', 'document_date']
        WHEN {_YEARS} BETWEEN 16 AND 120 AND {_near('c', 'birth', 'identity_document')} THEN ['birth_years', 'date_of_birth'] WHEN {_YEARS} BETWEEN 16 AND 120 THEN ['past_years', 'date']
        WHEN year(day) BETWEEN year(DATE '{AS_OF}') - 5 AND year(DATE '{AS_OF}') THEN ['recent', 'document_date'] ELSE ['date', 'date'] END AS by_date
    FROM k1
  ), k3 AS (
    SELECT *, CASE WHEN dated THEN ['date', by_date[2]]
        WHEN f = 'email' AND {_CONTACT} THEN ['contact_email', 'contact_email'] WHEN {_in('f', 'phone')} AND {_CONTACT} THEN ['contact_phone', 'contact_phone'] WHEN {_PHONE} THEN ['phone_noise', 'contact_phone']
        WHEN {_ORG_NAME} THEN ['organization_name', 'organization_name'] WHEN f = 'iban' AND {_ORG_IBAN} THEN ['organization_iban', 'organization_iban']
        WHEN {_in('f', 'address')} AND ({_OTHERS} OR {_near('n', 'organization')}) THEN ['organization_address', 'organization_address']
        WHEN {_in('f', 'reference')} AND ({_OTHERS} OR {_near('n', 'organization')}) THEN ['organization_reference', 'organization_reference'] WHEN {_REFERENCE} THEN ['reference_noise', 'reference_noise']
        WHEN {_near('c', 'health')} AND NOT {_in('f', 'protected')} THEN ['health', 'health_reference'] WHEN {_near('c', 'tax')} AND NOT {_in('f', 'protected')} THEN ['tax', 'tax_reference']
        WHEN {_near('c', 'business')} AND NOT {_in('f', 'protected')} THEN ['business', 'business_reference'] WHEN {_near('c', 'bank')} AND f NOT IN ('iban', 'organization_iban') THEN ['bank', 'bank_reference']
        WHEN {_near('c', 'authority')} AND NOT {_in('f', 'protected')} THEN ['authority', 'public_authority_reference'] WHEN {_near('c', 'form')} AND NOT {_in('f', 'protected')} THEN ['form', 'form_instruction'] ELSE ['own', f] END AS by_field
    FROM k2
  ), k4 AS (SELECT * REPLACE (by_field[2] AS f) FROM k3), decided AS (
    SELECT *, f AS field_name, by_field[1] AS field_rule, CASE WHEN dated THEN by_date[1] END AS date_rule,
      CASE WHEN (coalesce(source, '') = 'llm_extraction_structurer' OR contains(source_stage, 'llm_structured')) AND coalesce(auto_accept, '') <> 'true' AND NOT {_LABEL} AND ({_in('f', 'model_review')} OR {_in('fact_type', 'model_review')}) THEN [1, 1]
        WHEN {_in('fact_type', 'evidence_only')} THEN [2, 0] WHEN {_in('f', 'evidence_only')} THEN [3, 0] WHEN fact_type = 'review_candidate' THEN [4, 0] WHEN role = 'document_label' THEN [5, 0] WHEN is_person = 'false' THEN [6, 0] WHEN as_evidence = 'true' THEN [7, 0]
        WHEN {_LABEL} THEN [8, 0] WHEN {_JUNK} THEN [9, 0] WHEN {_CONTACT} THEN [10, 0] WHEN {_ORG_NAME} THEN [11, 0] WHEN {_ORG_IBAN} THEN [12, 0]
        WHEN {_in('f', 'weak')} AND (len(v) < 4 OR lv IN {_words(WEAK_JUNK)} OR regexp_matches(v, '[@:/\\]')) THEN [13, 0]
        WHEN {_in('f', 'address')} AND (len(v) < 8 OR {_near('n', 'address_junk')} OR NOT {_ADDRESS}) THEN [14, 0] WHEN {_PHONE} THEN [15, 0] WHEN {_REFERENCE} THEN [16, 0]
        WHEN NOT ({_in('f', 'protected')} AND {_PERSONAL}) AND ({_near('n', 'form_value')} OR ({_near('c', 'form')} AND NOT {_in('f', 'protected')}) OR (words >= 7 AND NOT {_ADDRESS}) OR regexp_matches(lv, '\b(bitte|ankreuzen|ausfüllen|ausfuellen)\b')) THEN [17, 0]
        WHEN {_in('f', 'name')} AND ({_near('n', 'name_noise')} OR {_near('c', 'name_noise', 'authority')} OR regexp_matches(v, '[-–—]$') OR regexp_matches(v, '\d') OR regexp_matches(v, '[&@:/\\|{{}}<>]') OR words >= 4
          OR regexp_matches(lv, '^({'|'.join(TITLES)})( |$)') OR ({_near('c', 'business')} AND f <> 'full_name')) THEN [18, 0]
        WHEN NOT ({_in('f', 'protected')} AND {_PERSONAL}) AND (({_near('c', 'form')} AND NOT {_in('f', 'protected')}) OR ({_near('c', 'health', 'tax', 'bank', 'authority')} AND f IN ('name', 'address', 'reference', 'number', 'case_number')) OR ({_near('c', 'health')} AND f = 'organization')
          OR ({_near('c', 'tax')} AND f IN ('date', 'document_date')) OR ({_near('c', 'business')} AND f IN ('address', 'employer', 'employee', 'occupation', 'job_title', 'reference', 'number'))
          OR ({_in('f', 'phone')} AND {_near('c', 'phone_noise', 'authority', 'health', 'tax', 'business')}) OR ({_in('f', 'reference')} AND {_OTHERS}) OR (f IN ('address', 'name', 'reference', 'number') AND {_near('n', *OTHER_PARTY)})) THEN [19, 0]
        ELSE [20, 1] END AS kept
    FROM k4
  )"""
_REASONS = ", ".join(f"'{name}'" for name in ("model_review", "evidence_type", "evidence_field", "review_type", "document_label", "not_of_person", "stored_as_evidence", "label", "junk", "contact", "organization_name", "iban", "weak", "address", "phone", "reference", "form_value", "name", "domain", "kept"))


@query(f"WITH {_DECISION_SQL} SELECT candidate_id, field_name, field_rule, date_rule, kept[2] = 1 AS is_fact, kept[1] AS fact_rule, CASE WHEN kept[2] = 0 THEN [{_REASONS}][kept[1]] END AS reject_reason FROM decided", "candidate_rows")
def candidate_decisions(spark: SparkSession, d: str) -> DataFrame:
    found = decisions.decide(candidates(spark, d), F.lit(AS_OF).cast("date"))
    return found.select("candidate_id", "field_name", "field_rule", "date_rule", "is_fact", "fact_rule", "reject_reason")


def _built(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return build.build(decisions.decide(candidates(spark, d), F.lit(AS_OF).cast("date")), F.lit(AS_OF).cast("timestamp"))


def _id(kind: str, *of: str) -> str:
    return f"substr(sha256(concat_ws('|', '{kind}', {', '.join(f'CAST({c} AS VARCHAR)' for c in of)})), 1, 32)"


_FACT, _EVIDENCE = _id("fact", "candidate_id"), _id("evidence", "candidate_id")


@query(f"WITH {_DECISION_SQL} SELECT {_FACT} AS fact_id, entity_id, field_name, value AS canonical_value, value AS display_value, source_stage, confidence FROM decided WHERE kept[2] = 1", "candidate_rows")
def knowledge_facts(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)["facts"].drop("created_at")


@query(
    f"""WITH {_DECISION_SQL} SELECT {_EVIDENCE} AS evidence_id, source_id, entity_id, field_name, value AS raw_value, source_stage AS extraction_method, confidence,
      concat_ws('|', document_id, candidate_id, fact_type, field_name) AS own_metadata,
      4 + (target_field IS NOT NULL)::INT + (around IS NOT NULL)::INT + (source IS NOT NULL)::INT + (auto_accept IS NOT NULL)::INT + (role IS NOT NULL)::INT + (is_person IS NOT NULL)::INT + (as_evidence IS NOT NULL)::INT AS n_metadata FROM decided""",
    "candidate_rows",
)
def knowledge_evidence(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat_ws("|", *[F.col("metadata")[k] for k in ("document_id", "candidate_fact_id", "fact_type", "resolved_field_name")])
    found = _built(spark, d)["evidence"].withColumns({"own_metadata": own, "n_metadata": F.size("metadata")})
    return found.drop("metadata", "location")


@query(f"WITH {_DECISION_SQL} SELECT {_FACT} AS fact_id, {_EVIDENCE} AS evidence_id, 'PRIMARY' AS role FROM decided WHERE kept[2] = 1", "candidate_rows")
def knowledge_links(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)["links"]


@query(
    f"""WITH {_DECISION_SQL} SELECT {_id('provenance', 'candidate_id')} AS provenance_id, {_FACT} AS fact_id, entity_id, 1 AS n_steps,
      CASE source_stage WHEN 'ocr_regex' THEN 'OCR' WHEN 'manual_entry' THEN 'USER' ELSE 'SYSTEM' END AS actor, {_EVIDENCE} AS evidence_id, concat('raw_value=''', value, ''' confidence=', confidence) AS note,
      concat('Fact ''', field_name, ''' extracted from source ''', source_id, ''' with confidence ', confidence) AS summary FROM decided WHERE kept[2] = 1""",
    "candidate_rows",
)
def knowledge_provenance(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("decision_chain")[0]
    return _built(spark, d)["provenance"].select("provenance_id", "fact_id", "entity_id", F.size("decision_chain").alias("n_steps"), step["actor"].alias("actor"), step["evidence_id"].alias("evidence_id"), step["note"].alias("note"), "summary")


@query(
    f"""WITH {_DECISION_SQL}, split AS (SELECT entity_id, fact_type FROM decided GROUP BY ALL HAVING count(DISTINCT value) > 1),
    held AS (SELECT d.*, count(*) OVER (PARTITION BY entity_id, fact_type) AS n_facts FROM decided d SEMI JOIN split USING (entity_id, fact_type) WHERE kept[2] = 1)
    SELECT {_id('conflict', 'entity_id', 'fact_type')} AS conflict_id, entity_id, fact_type AS field_name, {_FACT} AS fact_id, n_facts FROM held WHERE n_facts >= 2""",
    "candidate_rows",
)
def knowledge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)["conflict_facts"]
