"""Queries behind screens: dashboards, profiles, advice, forms, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import chat, dashboards, forms, knowledge as K
from factloom.plans.catalog import query
from factloom.sources.records import record


def as_of() -> Column:
    """The day on which the queries look at ages and expiries."""
    return F.lit("1998-08-01").cast("date")


@query(
    """SELECT * , CASE WHEN entities = 0 THEN 'Entity Start' WHEN documents = 0 THEN 'Document Intake' WHEN facts = 0 THEN 'Extraction'
        WHEN pending_cases > 0 AND accepted_facts = 0 THEN 'Human Review' WHEN accepted_facts > 0 AND profiles = 0 THEN 'Profile Build'
        WHEN profiles > 0 AND outputs = 0 THEN 'Forms and Output' ELSE 'Operational' END AS stage
    FROM (SELECT count(*) AS entities FROM entity_rows WHERE status = 'active'), (SELECT count(*) AS documents FROM document_rows),
      (SELECT count(*) AS facts, count(*) FILTER (status = 'accepted') AS accepted_facts FROM fact_rows),
      (SELECT count(*) FILTER (status = 'PENDING') AS pending_cases, count(*) FILTER (status = 'ACCEPTED') AS accepted_cases, count(*) FILTER (status = 'REJECTED') AS rejected_cases FROM case_rows),
      (SELECT count(DISTINCT entity_id) AS profiles FROM profile_rows), (SELECT count(*) AS outputs FROM output_rows),
      (SELECT count(*) AS noise, count(*) FILTER (status IN ('open', 'processing', 'failed')) AS open_noise FROM noise_rows), (SELECT count(*) AS audit_entries FROM audit_rows)""",
    "entity_rows", "document_rows", "fact_rows", "case_rows", "profile_rows", "output_rows", "noise_rows", "audit_rows",
)
def health_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.health(*[record(spark, d, f"{t}_rows") for t in ("entity", "document", "fact", "case", "profile", "output", "noise", "audit")])


@query(
    """WITH n AS (
      SELECT entity_id, (SELECT count(*) FROM document_rows d WHERE d.entity_id = e.entity_id) AS documents,
        (SELECT count(*) FROM case_rows c WHERE c.entity_id = e.entity_id AND status = 'PENDING') AS pending,
        (SELECT count(*) FROM fact_rows f WHERE f.entity_id = e.entity_id AND status = 'accepted') AS accepted,
        EXISTS (SELECT 1 FROM profile_rows p WHERE p.entity_id = e.entity_id) AS profile_exists
      FROM entity_rows e
    )
    SELECT *, CASE WHEN documents = 0 THEN 'Upload documents for this entity.' WHEN pending > 0 THEN 'Review pending extracted facts.'
      WHEN accepted = 0 THEN 'Accept facts before building a trusted profile.' WHEN NOT profile_exists THEN 'Build the profile from accepted facts.' ELSE 'Profile is ready.' END AS next_step
    FROM n""",
    "entity_rows", "document_rows", "fact_rows", "case_rows", "profile_rows",
)
def profile_status(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.profile_status(*[record(spark, d, f"{t}_rows") for t in ("entity", "document", "fact", "case", "profile")])


@query(
    """SELECT entity_id, field_name, CASE WHEN field_name IN ('given_names', 'surname', 'date_of_birth', 'place_of_birth', 'nationality') THEN 'identity' WHEN field_name IN ('address', 'new_address') THEN 'address'
      WHEN field_name IN ('passport_number', 'valid_until') THEN 'passport' WHEN field_name = 'email' THEN 'contact' WHEN field_name = 'tax_id' THEN 'tax_insurance' WHEN field_name IN ('employer', 'job_title') THEN 'work' ELSE 'other' END AS section FROM profile_rows""",
    "profile_rows",
)
def profile_sections(spark: SparkSession, d: str) -> DataFrame:
    return record(spark, d, "profile_rows").select("entity_id", "field_name", dashboards.section_of(F.col("field_name")).alias("section"))


@query(
    """WITH need(section, field_name) AS (VALUES ('identity', 'given_names'), ('identity', 'surname'), ('identity', 'date_of_birth'), ('identity', 'place_of_birth'), ('identity', 'nationality'), ('address', 'address'), ('address', 'new_address'), ('passport', 'passport_number')),
    e AS (SELECT DISTINCT entity_id FROM profile_rows)
    SELECT e.entity_id, section, CAST(count(*) AS INT) AS total_required, CAST(count(p.value) AS INT) AS filled_required, round(count(p.value) / count(*)::DOUBLE, 2) AS completeness
    FROM e CROSS JOIN need n LEFT JOIN profile_rows p ON p.entity_id = e.entity_id AND p.field_name = n.field_name AND trim(p.value) <> '' GROUP BY e.entity_id, section""",
    "profile_rows",
)
def profile_section_summaries(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.section_summaries(record(spark, d, "profile_rows"))


@query(
    """WITH f AS (SELECT entity_id, count(*) FILTER (trim(value) <> '' AND field_name IN ('given_names', 'surname', 'date_of_birth', 'place_of_birth', 'nationality', 'address', 'new_address', 'passport_number')) AS n FROM profile_rows GROUP BY entity_id)
    SELECT entity_id, round(n / 8.0::DOUBLE, 2) AS completeness, 8 - n AS missing FROM f""",
    "profile_rows",
)
def required_completeness(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.profile_completeness(record(spark, d, "profile_rows"))


ADVICE_SQL = """WITH c AS (
      SELECT entity_id, max(value) FILTER (field_name = 'date_of_birth') AS born, max(value) FILTER (field_name = 'iban') AS iban, max(value) FILTER (field_name = 'bank_name') AS bank,
        max(value) FILTER (field_name = 'employer') AS employer, max(value) FILTER (field_name = 'job_title') AS job,
        8 - count(*) FILTER (field_name IN ('given_names', 'surname', 'date_of_birth', 'place_of_birth', 'nationality', 'address', 'new_address', 'passport_number')) AS missing
      FROM profile_rows GROUP BY entity_id
    ), o AS (SELECT entity_id, count(*) AS n FROM conflict_rows WHERE status = 'open' GROUP BY entity_id),
    a AS (
      SELECT *, 1998 - year(b) - CASE WHEN strftime(DATE '1998-08-01', '%m%d') < strftime(b, '%m%d') THEN 1 ELSE 0 END AS age FROM (SELECT *, TRY_CAST(born AS DATE) AS b FROM c)
    ), d AS (
      SELECT entity_id, date_diff('day', DATE '1998-08-01', TRY_CAST(value AS DATE)) AS n FROM profile_rows WHERE field_name = 'valid_until'
    ), items AS (
      SELECT entity_id, 'documents' AS category, CASE WHEN n <= 30 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN n < 0 THEN 'doc_expired' ELSE 'doc_expiring' END AS rule, abs(n) AS n FROM d WHERE n <= 90
      UNION ALL SELECT entity_id, 'general', 'warning', 'missing_fields', missing FROM c WHERE missing > 0
      UNION ALL SELECT c.entity_id, 'conflicts', 'critical', 'open_conflicts', o.n FROM c JOIN o USING (entity_id)
      UNION ALL SELECT entity_id, 'health', 'info', 'health_checkup', age FROM a WHERE age >= 35
      UNION ALL SELECT entity_id, 'financial', 'info', 'financial_iban', NULL FROM c WHERE iban IS NOT NULL AND coalesce(bank, '') <> ''
      UNION ALL SELECT entity_id, 'employment', 'info', 'employment_update', NULL FROM c WHERE coalesce(employer, '') <> '' AND coalesce(job, '') <> ''
    )"""


@query(f"{ADVICE_SQL} SELECT * FROM items", "profile_rows", "conflict_rows")
def personal_advice(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.advice(record(spark, d, "profile_rows"), record(spark, d, "conflict_rows"), as_of())


@query(f"{ADVICE_SQL} SELECT category, severity, count(*) AS n, count(DISTINCT entity_id) AS entities FROM items GROUP BY ALL", "profile_rows", "conflict_rows")
def advice_by_category(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.advice_by_category(dashboards.advice(record(spark, d, "profile_rows"), record(spark, d, "conflict_rows"), as_of()))


@query(
    f"""{ADVICE_SQL} SELECT entity_id, rule, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, rule) AS INT) AS place FROM items""",
    "profile_rows",
    "conflict_rows",
)
def advice_order(spark: SparkSession, d: str) -> DataFrame:
    items = dashboards.advice(record(spark, d, "profile_rows"), record(spark, d, "conflict_rows"), as_of())
    place = F.expr("row_number() OVER (PARTITION BY entity_id ORDER BY severity_rank, rule)")
    return items.withColumn("severity_rank", dashboards.severity_rank(F.col("severity"))).select("entity_id", "rule", place.alias("place"))


_PLACE_SQL = r"""
    p AS (
      SELECT *, regexp_extract(field_name, '\.p(\d+)\.x(-?\d+(?:\.\d+)?)\.y(-?\d+(?:\.\d+)?)', 1) AS pp, regexp_extract(field_name, '\.p(\d+)\.x(-?\d+(?:\.\d+)?)\.y(-?\d+(?:\.\d+)?)', 2) AS px,
        regexp_extract(field_name, '\.p(\d+)\.x(-?\d+(?:\.\d+)?)\.y(-?\d+(?:\.\d+)?)', 3) AS py FROM form_rows
    ), q AS (
      SELECT *, CASE WHEN pp = '' THEN 1 ELSE CAST(pp AS INT) + 1 END AS at_page, CASE WHEN pp = '' THEN 0 ELSE CAST(px AS DOUBLE) END AS at_x, CASE WHEN pp = '' THEN 0 ELSE CAST(py AS DOUBLE) END AS at_y FROM p
    )"""


@query(f"WITH {_PLACE_SQL} SELECT field_id, at_page AS page, CAST(at_x AS DOUBLE) AS x, CAST(at_y AS DOUBLE) AS y FROM q", "form_rows")
def form_field_positions(spark: SparkSession, d: str) -> DataFrame:
    at = forms.position(F.col("field_name"))
    return record(spark, d, "form_rows").select("field_id", at["page"].alias("page"), at["x"].alias("x"), at["y"].alias("y"))


_KNOWN_SQL = """
    k AS (
      SELECT *, at_page = 1 AND at_x = 22 AND at_y = 85 OR at_page = 2 AND at_x = 22 AND at_y = 148 AS known, profile_field_name <> '' AS mapped,
        contains(upper(field_name), 'SYSTEM') OR (field_type = 'checkbox' AND profile_field_name = '' AND confidence < 0.5) AS helper FROM q
    ), g AS (
      SELECT *, CASE WHEN known AND at_page = 1 THEN 'person' WHEN known THEN 'signature' WHEN mapped THEN 'mapped' WHEN helper THEN 'hidden' WHEN confidence >= 0.65 THEN 'suggested' ELSE 'unknown' END AS grp FROM k
    ), s AS (
      SELECT *, grp NOT IN ('hidden', 'unknown') AS visible, CASE WHEN mapped THEN 'mapped' WHEN grp NOT IN ('hidden', 'unknown') THEN 'needs_review' ELSE 'hidden' END AS state FROM g
    )"""


@query(f"WITH {_PLACE_SQL}, {_KNOWN_SQL} SELECT field_id, grp AS \"group\", state AS status, visible, state = 'needs_review' AS needs_review FROM s", "form_rows")
def smart_fields(spark: SparkSession, d: str) -> DataFrame:
    return forms.smart_fields(record(spark, d, "form_rows")).select("field_id", "group", "status", "visible", "needs_review")


@query(
    f"""WITH {_PLACE_SQL}, {_KNOWN_SQL} SELECT template_id, count(*) AS total, count(*) FILTER (known) AS recognized, count(*) FILTER (known OR mapped) AS auto_mapped,
      count(*) FILTER (state = 'needs_review' AND NOT known) AS review, count(*) FILTER (NOT visible) AS hidden FROM s GROUP BY template_id""",
    "form_rows",
)
def smart_prepare(spark: SparkSession, d: str) -> DataFrame:
    return forms.prepare(record(spark, d, "form_rows"))


@query(
    r"""SELECT field_id, CASE label WHEN 'Familienname' THEN 'surname' WHEN 'Neue Adresse' THEN 'address' WHEN 'Geburtsdatum' THEN 'date_of_birth' WHEN 'Telefon privat' THEN 'phone' ELSE '' END AS suggested FROM form_rows""",
    "form_rows",
)
def label_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return record(spark, d, "form_rows").select("field_id", forms.suggest(F.col("label")).alias("suggested"))


@query(
    """WITH v AS (SELECT field_id, CASE WHEN field_id % 4 = 0 THEN '' ELSE CAST(field_id % 50 AS VARCHAR) END AS value, field_id % 3 = 0 AS required FROM form_rows)
    SELECT field_id, concat_ws(',', CASE WHEN required AND value = '' THEN 'required' END, CASE WHEN value <> '' AND len(value) < 2 THEN 'min_length' END,
      CASE WHEN TRY_CAST(value AS DOUBLE) > 40 THEN 'max_value' END, CASE WHEN value <> '' AND NOT regexp_full_match(value, '[0-46-9]+') THEN 'pattern' END, CASE WHEN value = '7' THEN 'allowed' END) AS violations FROM v""",
    "form_rows",
)
def form_field_rules(spark: SparkSession, d: str) -> DataFrame:
    key, none = F.col("field_id"), F.lit(None)
    allowed = F.array(*[F.lit(str(i)) for i in range(50) if i != 7])
    v = record(spark, d, "form_rows").select("field_id", F.when(key % 4 == 0, "").otherwise((key % 50).cast("string")).alias("value"), (key % 3 == 0).alias("required"), F.lit(2).alias("min_length"), F.lit(9).alias("max_length"), none.cast("double").alias("min_value"), F.lit(40.0).alias("max_value"), F.lit("[0-46-9]+").alias("pattern"), allowed.alias("allowed"))
    return forms.field_violations(v).select("field_id", F.array_join("violations", ",").alias("violations"))


@query(
    """WITH q AS (SELECT question_id, trim(regexp_replace(replace(replace(lower(trim(text)), '?', ''), '!', ''), '\\s+', ' ', 'g')) AS q FROM question_rows),
    has(o, intent, phrase) AS (VALUES (1, 'assistant', 'who are you'), (1, 'assistant', 'what are you'), (1, 'assistant', 'tell me about yourself'), (1, 'assistant', 'introduce yourself'),
      (2, 'assistant_age', 'how old are you'), (2, 'assistant_age', 'your age'), (2, 'assistant_age', 'are you old'), (4, 'noise', 'noise'),
      (6, 'identity', 'who am i'), (6, 'identity', 'who i am'), (6, 'identity', 'what do you know about me'), (6, 'identity', 'what you know about me'), (6, 'identity', 'tell me about me'), (6, 'identity', 'tell me about myself'),
      (6, 'identity', 'do you know me'), (6, 'identity', 'what is my profile'), (6, 'identity', 'summarize me'), (6, 'identity', 'describe me'), (7, 'profile', 'profile'),
      (8, 'review', 'review'), (8, 'review', 'pending facts'), (8, 'review', 'pending candidates'), (8, 'review', 'what should i accept'), (8, 'review', 'what should i fix')),
    hit AS (
      SELECT question_id, o, intent FROM q JOIN has ON contains(q, phrase)
      UNION ALL SELECT question_id, 3, 'greeting' FROM q WHERE q IN ('hi', 'hello', 'hey', 'hi there', 'hello there', 'good morning', 'good afternoon', 'good evening')
      UNION ALL SELECT question_id, 5, 'save_info' FROM q WHERE regexp_matches(q, 'save this info|will you save|can you save|remember this|store this|update my profile|add this to my profile') AND regexp_matches(q, 'i am |i''m |my name is |years old|my age is ')
    ), best AS (SELECT question_id, arg_min(intent, o) AS intent FROM hit GROUP BY question_id)
    SELECT q.question_id, coalesce(intent, 'llm') AS intent FROM q LEFT JOIN best USING (question_id)""",
    "question_rows",
)
def chat_intents(spark: SparkSession, d: str) -> DataFrame:
    return record(spark, d, "question_rows").select("question_id", chat.intent(F.col("text")).alias("intent"))


@query(
    "SELECT fact_id, CASE WHEN NOT (fact_id % 97 BETWEEN 5 AND 90) THEN 'FAILED' WHEN field_name = 'hobby' THEN 'WARNING' ELSE 'PASSED' END AS status FROM fact_rows",
    "fact_rows",
)
def validation_status(spark: SparkSession, d: str) -> DataFrame:
    """Each fact by two rules: a failed error outweighs a failed warning."""
    f = record(spark, d, "fact_rows")
    amounts = K.validate(f.select("fact_id", F.lit("amount").alias("fact_type"), (F.col("fact_id") % 97).cast("string").alias("value")), [{"rule_id": "range", "kind": "range", "fact_type": "amount", "least": 5.0, "most": 90.0}])
    names = K.validate(f.select("fact_id", F.lit("name").alias("fact_type"), F.col("field_name").alias("value")), [{"rule_id": "format", "kind": "format", "fact_type": "name", "regex": "(?!hobby).*", "severity": "WARNING"}])
    return K.rollup(amounts.unionByName(names), ["fact_id"])


@query(
    """WITH t(field_id, required) AS (VALUES ('surname', true), ('address', true), ('email', false)), p AS (
      SELECT e.entity_id, required, v.value FROM entity_rows e CROSS JOIN t LEFT JOIN profile_rows v ON v.entity_id = e.entity_id AND v.field_name = t.field_id
    ), m AS (SELECT entity_id, count(*) FILTER (required AND value IS NULL) AS missing FROM p GROUP BY entity_id)
    SELECT entity_id, missing, CASE WHEN missing = 0 THEN 'submitted' ELSE 'draft' END AS state FROM m""",
    "entity_rows",
    "profile_rows",
)
def form_submissions(spark: SparkSession, d: str) -> DataFrame:
    """A form of three fields for each entity: it is submitted once its required ones are filled."""
    fields = F.array(*[F.struct(F.lit(f).alias("field_id"), F.lit(required).alias("required")) for f, required in (("surname", True), ("address", True), ("email", False))])
    template = record(spark, d, "entity_rows").select("entity_id", F.inline(fields))
    mapping = spark.createDataFrame([(f, f) for f in ("surname", "address", "email")], "field_id string, fact_type string")
    facts = record(spark, d, "profile_rows").select("entity_id", F.col("field_name").alias("fact_type"), "value")
    return forms.submissions(K.form_preview(template, mapping, facts))
