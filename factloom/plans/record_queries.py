"""Queries of scans, changes and reports over the record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import dml, knowledge as K, reads, reports
from factloom.plans.catalog import query
from factloom.sources import tables as S
from factloom.sources.records import PROFILE_NAMES, record


def now() -> Column:
    """The time at which the queries' changes are made."""
    return F.lit("2000-01-01 00:00:00").cast("timestamp")


@query("SELECT fact_id, provenance_id, len(string_split(decision_chain, '>')) AS steps, contains(decision_chain, 'gate') AS gated FROM provenance_rows", "provenance_rows")
def provenance_scan(spark: SparkSession, d: str) -> DataFrame:
    chain = F.split("decision_chain", ">")
    return record(spark, d, "provenance_rows").select("fact_id", "provenance_id", F.size(chain).cast("long").alias("steps"), F.array_contains(chain, "gate").alias("gated"))


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    return record(spark, d, "conflict_rows").withColumn("fact_ids", F.array("fact_a", "fact_b"))


@query("SELECT DISTINCT fact_id, conflict_id, status FROM (SELECT fact_a AS fact_id, conflict_id, status FROM conflict_rows UNION ALL SELECT fact_b, conflict_id, status FROM conflict_rows)", "conflict_rows")
def conflicts_of_facts(spark: SparkSession, d: str) -> DataFrame:
    return reads.conflicts_of_facts(_conflicts(spark, d)).select("fact_id", "conflict_id", "status")


@query("SELECT conflict_id AS wanted_id, conflict_id FROM conflict_rows WHERE status = 'open'", "conflict_rows")
def same_open_conflict(spark: SparkSession, d: str) -> DataFrame:
    wanted = _conflicts(spark, d).select(F.col("conflict_id").alias("wanted_id"), F.array("fact_b", "fact_a", "fact_b").alias("fact_ids"))
    return reads.same_open_conflict(wanted, _conflicts(spark, d))


@query("SELECT case_id, decision_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY decided_at DESC, decision_id DESC) AS r FROM decision_rows) WHERE r = 1", "decision_rows")
def latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest(record(spark, d, "decision_rows"), ["case_id"], F.desc("decided_at"), F.desc("decision_id")).select("case_id", "decision_id", "outcome")


@query("SELECT subject_id, output_type, output_id, sha256(content) AS content_hash, 'outputs/' || output_type || '/' || output_id || '.' || format AS path FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, output_type ORDER BY created_at DESC, output_id DESC) AS r FROM output_rows) WHERE r = 1", "output_rows")
def latest_outputs(spark: SparkSession, d: str) -> DataFrame:
    last = reads.latest(record(spark, d, "output_rows"), ["subject_id", "output_type"], F.desc("created_at"), F.desc("output_id"))
    return reports.output_documents(last).select("subject_id", "output_type", "output_id", "content_hash", "path")


@query("SELECT subject_id, kind, path, sha256(path) AS path_hash FROM (SELECT subject_id, 'output' AS kind, 'outputs/' || output_type || '/' || output_id || '.' || format AS path FROM output_rows UNION ALL SELECT entity_id, 'document', 'documents/' || document_id || '_doc_' || document_id || '.pdf' FROM document_rows)", "output_rows", "document_rows")
def package_manifest(spark: SparkSession, d: str) -> DataFrame:
    return reports.manifest(reports.output_documents(record(spark, d, "output_rows")), record(spark, d, "document_rows"))


@query("SELECT entity_id, field_name, value FROM profile_rows", "profile_rows")
def profile_scan(spark: SparkSession, d: str) -> DataFrame:
    """Profiles as one map of fields each, unfolded again: each field is there once."""
    p = record(spark, d, "profile_rows").groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("fields"))  # a profile's fields are few
    return p.select("entity_id", F.explode("fields").alias("field_name", "value"))


@query("SELECT event_type, job_id, subject_id, sequence_number FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY sequence_number DESC) AS r FROM audit_rows) WHERE r = 1", "audit_rows")
def latest_audit_entries(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest(record(spark, d, "audit_rows"), ["subject_id"], F.desc("sequence_number")).select("event_type", "job_id", "subject_id", "sequence_number")


@query("SELECT noise_id, CAST(row_number() OVER (ORDER BY created_at DESC, noise_id) AS INT) AS place FROM noise_rows WHERE status IN ('open', 'processing', 'failed') ORDER BY created_at DESC, noise_id LIMIT 50", "noise_rows")
def newest_open_noise(spark: SparkSession, d: str) -> DataFrame:
    open_noise = record(spark, d, "noise_rows").where(F.col("status").isin("open", "processing", "failed"))
    return reads.latest_n(open_noise, 50, F.desc("created_at"), F.col("noise_id")).select("noise_id", "place")


@query("SELECT count(*) AS total, count(*) FILTER (status IN ('open', 'processing', 'failed')) AS open FROM noise_rows", "noise_rows")
def noise_counts(spark: SparkSession, d: str) -> DataFrame:
    return record(spark, d, "noise_rows").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("open", "processing", "failed")).alias("open"))


@query("SELECT template_id, field_id, CAST(row_number() OVER (PARTITION BY template_id ORDER BY page, y, x, field_id) AS INT) AS place FROM form_rows", "form_rows")
def form_field_order(spark: SparkSession, d: str) -> DataFrame:
    w = F.row_number().over(reads.Window.partitionBy("template_id").orderBy("page", "y", "x", "field_id"))
    return record(spark, d, "form_rows").select("template_id", "field_id", w.alias("place"))


@query("SELECT entity_id, display_name, CAST(row_number() OVER (ORDER BY created_at DESC, display_name) AS INT) AS place FROM entity_rows WHERE status = 'active'", "entity_rows")
def entity_picker(spark: SparkSession, d: str) -> DataFrame:
    return reads.active_entities(record(spark, d, "entity_rows")).select("entity_id", "display_name", "place")


@query("SELECT entity_id, CASE WHEN status = 'active' THEN entity_id ELSE (SELECT entity_id FROM entity_rows WHERE status = 'active' ORDER BY created_at DESC, display_name LIMIT 1) END AS resolved_id FROM entity_rows", "entity_rows")
def resolved_entity(spark: SparkSession, d: str) -> DataFrame:
    e = record(spark, d, "entity_rows")
    return reads.active_entities(e, e.select("entity_id"))


@query("SELECT job_id, status, coalesce(TRY_CAST(priority AS INT), 20) AS priority, retry_count < max_retries AS may_retry FROM job_rows", "job_rows")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    return reads.job_states(record(spark, d, "job_rows"))


@query("SELECT count(*) FILTER (status IN ('pending', 'retrying')) AS depth, count(*) AS total FROM job_rows", "job_rows")
def queue_depth(spark: SparkSession, d: str) -> DataFrame:
    return record(spark, d, "job_rows").agg(F.count_if(F.col("status").isin("pending", "retrying")).alias("depth"), F.count("*").alias("total"))


@query("SELECT case_id FROM case_rows WHERE contains(lower(raw_value), 'view 1') OR contains(lower(normalized_value), 'view 1') OR contains(lower(fact_type), 'view 1')", "case_rows")
def case_search(spark: SparkSession, d: str) -> DataFrame:
    return reads.search(record(spark, d, "case_rows"), "VIEW 1", ["raw_value", "normalized_value", "fact_type"]).select("case_id")


@query("SELECT c.case_id, coalesce(regexp_extract(x.file_path, '[^/]+$', 0), '') AS document_name FROM case_rows c LEFT JOIN evidence_rows e USING (evidence_id) LEFT JOIN source_rows s ON s.source_id = e.source_id LEFT JOIN document_rows x ON x.document_id = s.document_id", "case_rows", "evidence_rows", "source_rows", "document_rows")
def case_document_names(spark: SparkSession, d: str) -> DataFrame:
    return reads.document_names(*[record(spark, d, f"{t}_rows") for t in ("case", "evidence", "source", "document")])


@query("SELECT document_id, evidence_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY created_at, evidence_id) AS INT) AS place FROM evidence_rows JOIN source_rows USING (source_id) WHERE document_id IS NOT NULL", "evidence_rows", "source_rows")
def evidence_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return reads.evidence_of_documents(record(spark, d, "evidence_rows"), record(spark, d, "source_rows")).select("document_id", "evidence_id", "place")


@query("SELECT max_by(entity_id, (created_at, case_id)) AS entity_id FROM case_rows", "case_rows")
def latest_active_entity(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest_entity(F.lit(None).cast("long"), record(spark, d, "case_rows"), record(spark, d, "fact_rows"))


@query("SELECT case_id, CASE WHEN status IN ('PENDING', 'ASSIGNED', 'IN_REVIEW') THEN 'pending' WHEN status = 'COMPLETED' THEN 'accepted' WHEN status = 'CANCELLED' THEN 'rejected' ELSE 'pending' END AS shown FROM case_rows", "case_rows")
def shown_case_status(spark: SparkSession, d: str) -> DataFrame:
    return record(spark, d, "case_rows").select("case_id", reads.shown_status(F.col("status")).alias("shown"))


@query("SELECT document_id, x.entity_id, coalesce(n, 0) AS open_conflicts, EXISTS (SELECT 1 FROM case_rows c WHERE c.entity_id = x.entity_id AND c.status = 'PENDING') AS has_pending FROM document_rows x LEFT JOIN (SELECT entity_id, count(*) AS n FROM conflict_rows WHERE status = 'open' GROUP BY entity_id) USING (entity_id)", "document_rows", "case_rows", "conflict_rows")
def document_detail(spark: SparkSession, d: str) -> DataFrame:
    return reads.document_detail(record(spark, d, "document_rows"), record(spark, d, "conflict_rows"), record(spark, d, "case_rows"))


@query("SELECT document_id, coalesce(expires_in <= 0, false) AS expired, status IN ('processed', 'failed') AS terminal FROM document_rows", "document_rows")
def document_flags(spark: SparkSession, d: str) -> DataFrame:
    expires = F.date_add(F.to_date(now()), F.col("expires_in").cast("int"))
    return reads.document_flags(record(spark, d, "document_rows").withColumn("expires_at", expires), F.to_date(now()))


@query("SELECT fact_id, concat_ws(',', CASE WHEN confidence < 0.02 THEN 'confidence' END, CASE WHEN field_name = 'hobby' THEN 'field' END) AS broken FROM fact_rows WHERE confidence < 0.02 OR field_name = 'hobby'", "fact_rows")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    found = reads.violations(record(spark, d, "fact_rows"), {"confidence": F.col("confidence").between(0.02, 1), "field": F.col("field_name") != "hobby", "value": F.length("value") > 0})
    return found.where(F.size("violations") > 0).select("fact_id", F.array_join("violations", ",").alias("broken"))


@query(
    """WITH u AS (SELECT document_id + CASE WHEN document_id % 2 = 0 THEN 0 ELSE 100000000 END AS document_id, document_id AS file_key FROM document_rows WHERE document_id % 10 < 2)
    SELECT CASE WHEN u.document_id IS NULL THEN b.document_id ELSE u.document_id END AS document_id, b.document_id AS file_key, CASE WHEN u.document_id IS NULL THEN 'old' ELSE 'new' END AS state
    FROM document_rows b LEFT JOIN u ON u.file_key = b.document_id""",
    "document_rows",
)
def double_target_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Even documents are met by their id, odd ones come with a new id and are met by their file."""
    base = record(spark, d, "document_rows").select("document_id", F.col("document_id").alias("file_key"), F.lit("old").alias("state"))
    some = base.where("document_id % 10 < 2")
    updates = some.withColumns({"document_id": F.when(F.col("document_id") % 2 == 0, F.col("document_id")).otherwise(F.col("document_id") + 100_000_000), "state": F.lit("new")})
    return dml.upsert_by_either(base, updates, "document_id", "file_key")


@query("SELECT noise_id, CASE WHEN noise_id % 3 = 0 THEN 'dismissed' ELSE status END AS status, noise_id % 3 = 0 AS reviewed FROM noise_rows", "noise_rows")
def noise_status_update(spark: SparkSession, d: str) -> DataFrame:
    rows = record(spark, d, "noise_rows").withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    changes = rows.where("noise_id % 3 = 0").select("noise_id", F.lit("dismissed").alias("status"))
    return dml.set_status(rows, changes, "noise_id", now()).select("noise_id", "status", F.col("reviewed_at").isNotNull().alias("reviewed"))


@query("SELECT template_id, count(*) AS fields, template_id % 5 = 1 AS touched FROM form_rows WHERE template_id % 4 <> 0 GROUP BY template_id", "form_rows")
def form_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth template goes with its fields; of the rest, every fifth had a field edited."""
    fields = record(spark, d, "form_rows")
    templates = fields.select("template_id").distinct().withColumn("updated_at", F.lit(None).cast("timestamp"))
    templates, fields = dml.delete_with_parts(templates, fields, templates.where("template_id % 4 = 0"))
    templates = dml.touch(templates, fields.where("template_id % 5 = 1"), now())
    return templates.join(fields.groupBy("template_id").agg(F.count("*").alias("fields")), "template_id").select("template_id", "fields", F.col("updated_at").isNotNull().alias("touched"))


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cases = record(spark, d, "case_rows").withColumn("fact_id", F.col("case_id") * 4 + 1)
    facts = record(spark, d, "fact_rows").select("fact_id", "entity_id", "field_name", "value", "status")
    return dml.apply_decisions(cases, record(spark, d, "decision_rows"), facts, tuple(x for x in PROFILE_NAMES if x != "hobby"))


_DECIDED_SQL = """
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY decided_at DESC, decision_id DESC) AS r FROM decision_rows) WHERE r = 1),
    x AS (
      SELECT c.case_id, c.entity_id, c.case_id * 4 + 1 AS fact_id, outcome, CASE WHEN fact_type = 'hobby' THEN 'other' ELSE fact_type END AS field_name,
        CASE outcome WHEN 'accept' THEN coalesce(nullif(trim(edited_value), ''), normalized_value) WHEN 'edit' THEN nullif(trim(edited_value), '') END AS value
      FROM case_rows c JOIN last USING (case_id)
    ), results AS (
      SELECT *, CASE WHEN outcome = 'edit' AND value IS NULL THEN 'Edited value is empty' WHEN outcome = 'escalate' THEN 'Unknown decision' END AS error FROM x
    )"""


@query(f"WITH {_DECIDED_SQL} SELECT case_id, outcome, field_name, value, error FROM results", "case_rows", "decision_rows")
def decision_results(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[0].select("case_id", "outcome", "field_name", "value", "error")


@query(
    f"""WITH {_DECIDED_SQL}, done AS (SELECT * FROM results WHERE error IS NULL AND outcome IN ('accept', 'reject'))
    SELECT coalesce(f.fact_id, x.fact_id) AS fact_id, coalesce(f.entity_id, x.entity_id) AS entity_id, CASE WHEN outcome = 'accept' THEN x.field_name ELSE f.field_name END AS field_name,
      CASE WHEN outcome = 'accept' THEN x.value ELSE f.value END AS value, CASE outcome WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE status END AS status
    FROM fact_rows f FULL JOIN done x ON x.fact_id = f.fact_id WHERE status IS NOT NULL OR outcome = 'accept'""",
    "case_rows",
    "decision_rows",
    "fact_rows",
)
def facts_after_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[1]


@query(
    """WITH s AS (SELECT case_id, CASE WHEN case_id % 3 = 0 THEN 'supplier#1' WHEN case_id % 3 = 1 THEN upper('Customer#00000000') || (case_id % 9 + 1) ELSE '' END AS n FROM case_rows),
    k AS (SELECT s.case_id, n, e.entity_id FROM s LEFT JOIN entity_rows e ON lower(e.display_name) = lower(n) AND e.entity_type = 'person' AND e.status = 'active')
    SELECT case_id, CASE WHEN n <> '' THEN coalesce(CAST(entity_id AS VARCHAR), 'new-' || substr(sha256(lower(n) || '|person'), 1, 16)) END AS owner_id, n <> '' AND entity_id IS NULL AS is_new FROM k""",
    "case_rows",
    "entity_rows",
)
def decision_owners(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("case_id")
    name = F.when(key % 3 == 0, " supplier#1").when(key % 3 == 1, F.concat(F.lit("CUSTOMER#00000000"), (key % 9 + 1).cast("string"))).otherwise(" ")
    selections = record(spark, d, "case_rows").select("case_id", name.alias("owner_name"), F.lit("person").alias("owner_type"))
    return dml.owners(selections, record(spark, d, "entity_rows"))


@query("SELECT '1.0' AS schema_version, 'fact_export' AS report, entity_id AS owner_id, count(*) AS fact_count, min(created_at) AS first_at, max(created_at) AS last_at FROM fact_rows WHERE status = 'accepted' GROUP BY entity_id", "fact_rows")
def report_fact_export(spark: SparkSession, d: str) -> DataFrame:
    return reports.fact_export(record(spark, d, "fact_rows"))


def _items(spark: SparkSession, d: str, name: str, owner: str, order: list, fields: list[str], report: str) -> DataFrame:
    return reports.items(record(spark, d, name), owner, order, fields, report)


@query("""SELECT entity_id AS owner_id, 'knowledge_report' AS report, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY created_at, fact_id) AS INT) AS place,
    '{"fact_id":' || fact_id || ',"field_name":"' || field_name || '","value":"' || value || '"}' AS item FROM fact_rows WHERE status = 'accepted'""", "fact_rows")
def report_knowledge_items(spark: SparkSession, d: str) -> DataFrame:
    accepted = record(spark, d, "fact_rows").where("status = 'accepted'")
    return reports.items(accepted, "entity_id", [F.col("created_at"), F.col("fact_id")], ["fact_id", "field_name", "value"], "knowledge_report")


@query("""SELECT fact_id AS owner_id, 'evidence_report' AS report, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY created_at, evidence_id) AS INT) AS place,
    '{"evidence_id":' || evidence_id || ',"source_id":' || source_id || ',"line_no":' || line_no || '}' AS item FROM evidence_rows""", "evidence_rows")
def report_evidence_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "evidence_rows", "fact_id", [F.col("created_at"), F.col("evidence_id")], ["evidence_id", "source_id", "line_no"], "evidence_report")


@query("""SELECT fact_id AS owner_id, 'provenance_report' AS report, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY created_at, provenance_id, decision_chain) AS INT) AS place,
    '{"provenance_id":' || provenance_id || ',"decision_chain":["' || replace(decision_chain, '>', '","') || '"]}' AS item FROM provenance_rows""", "provenance_rows")
def report_provenance_items(spark: SparkSession, d: str) -> DataFrame:
    rows = record(spark, d, "provenance_rows").withColumns({"chain": F.col("decision_chain"), "decision_chain": F.split("decision_chain", ">")})
    return reports.items(rows, "fact_id", [F.col("created_at"), F.col("provenance_id"), F.col("chain")], ["provenance_id", "decision_chain"], "provenance_report")


@query("SELECT '1.0' AS schema_version, 'conflict_report' AS report, entity_id AS owner_id, count(*) AS conflict_count, count(*) FILTER (status = 'open') AS open_count, count(*) FILTER (status <> 'open') AS terminal_count FROM conflict_rows GROUP BY entity_id", "conflict_rows")
def report_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return reports.conflict_report(record(spark, d, "conflict_rows"))


@query("""SELECT entity_id AS owner_id, 'profile_report' AS report, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY field_name) AS INT) AS place,
    '{"field_name":"' || field_name || '","value":"' || value || '"}' AS item FROM profile_rows""", "profile_rows")
def report_profile_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "profile_rows", "entity_id", [F.col("field_name")], ["field_name", "value"], "profile_report")


@query("SELECT '1.0' AS schema_version, 'audit_report' AS report, subject_id AS owner_id, count(*) AS entry_count, count(*) FILTER (sequence_number % 89 <> 0) AS verified, count(*) FILTER (sequence_number % 89 = 0) AS failed, count(*) FILTER (sequence_number % 89 = 0) AS violations FROM audit_rows GROUP BY subject_id", "audit_rows")
def report_audit(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("sequence_number") % 89 == 0
    return reports.audit_report(record(spark, d, "audit_rows").withColumns({"verified": ~bad, "violation": F.when(bad, "INVALID_HMAC")}))


@query("WITH p AS (SELECT fact_id, entity_id, field_name, value, status, created_at FROM fact_rows) SELECT fact_id FROM p n WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM p a WHERE a.status = 'accepted' AND a.entity_id = n.entity_id AND a.field_name = n.field_name AND a.value = n.value) AND NOT EXISTS (SELECT 1 FROM p b WHERE b.status = 'pending' AND b.entity_id = n.entity_id AND b.field_name = n.field_name AND b.value = n.value AND (b.created_at, b.fact_id) < (n.created_at, n.fact_id))", "fact_rows")
def dedup_fact_values(spark: SparkSession, d: str) -> DataFrame:
    f = record(spark, d, "fact_rows")
    return K.new_rows(f.where("status = 'pending'"), f.where("status = 'accepted'"), ["entity_id", "field_name", "value"], [F.col("created_at"), F.col("fact_id")]).select("fact_id")


@query("SELECT fact_id, CAST(date_diff('day', DATE '1998-08-01', CAST(created_at AS DATE)) + 60 AS BIGINT) AS days, CASE WHEN date_diff('day', DATE '1998-08-01', CAST(created_at AS DATE)) + 60 <= 30 THEN 'critical' ELSE 'warning' END AS severity FROM facts WHERE date_diff('day', DATE '1998-08-01', CAST(created_at AS DATE)) + 60 <= 90", "facts")
def expiry_advisory(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d).select("fact_id", F.date_add(F.to_date("created_at"), 60).alias("expires_on"))
    return K.expiry_advice(f, F.lit("1998-08-01").cast("date")).select("fact_id", F.col("days").cast("long").alias("days"), "severity")
