"""Queries of connected entities, report items, merged lists, latest artifacts, vault filters, profile views and instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import values as V
from factloom.operators import classify, extract, fold, gates, queues, reads, reports
from factloom.plans.catalog import query
from factloom.plans.gate_sql import _GATED, _oracle
from factloom.plans.store_queries import _VAULT_SQL, _audit
from factloom.sources import tables as S
from factloom.sources.records import record
from factloom.sources.tables import spread


@query(
    """SELECT source_id, relation_type, target_id, display_name, fact_id, field_name, value, CASE WHEN fact_id IS NOT NULL THEN row_number() OVER (PARTITION BY source_id, target_id, relation_type ORDER BY field_name, fact_id) END AS place
    FROM relationship_rows JOIN entity_rows e ON e.entity_id = target_id LEFT JOIN (SELECT entity_id, fact_id, field_name, value FROM fact_rows WHERE status = 'accepted') f ON f.entity_id = target_id""",
    "relationship_rows", "entity_rows", "fact_rows",
)
def connected_entity_facts(spark: SparkSession, d: str) -> DataFrame:
    return reads.connected(*(record(spark, d, name) for name in ("relationship_rows", "entity_rows", "fact_rows")))


@query(
    """SELECT entity_id AS owner_id, 'fact_export' AS report, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY created_at, fact_id) AS INT) AS place,
    '{"fact_id":' || fact_id || ',"field_name":"' || field_name || '","value":"' || value || '","confidence":' || confidence || '}' AS item FROM fact_rows WHERE status = 'accepted'""",
    "fact_rows",
)
def report_fact_export_items(spark: SparkSession, d: str) -> DataFrame:
    accepted = record(spark, d, "fact_rows").where("status = 'accepted'")
    return reports.items(accepted, "entity_id", [F.col("created_at"), F.col("fact_id")], ["fact_id", "field_name", "value", "confidence"], "fact_export")


@query(
    """SELECT entity_id AS owner_id, 'conflict_report' AS report, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY conflict_id) AS INT) AS place,
    '{"conflict_id":' || conflict_id || ',"status":"' || status || '","facts":[' || fact_a || ',' || fact_b || ']}' AS item FROM conflict_rows""",
    "conflict_rows",
)
def report_conflict_items(spark: SparkSession, d: str) -> DataFrame:
    rows = record(spark, d, "conflict_rows").withColumn("facts", F.array("fact_a", "fact_b"))
    return reports.items(rows, "entity_id", [F.col("conflict_id")], ["conflict_id", "status", "facts"], "conflict_report")


_KEY = b"an invented key of thirty-two bytes."


@query(
    """WITH n AS (SELECT entity_id, case_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, case_id) AS n FROM cases), b AS (SELECT entity_id, min(n) AS n FROM n WHERE case_id % 499 = 0 GROUP BY entity_id)
    SELECT entity_id AS owner_id, 'audit_report' AS report, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY n.n) AS INT) AS place,
      '{"case_id":' || case_id || ',"signed":' || (case_id % 83 <> 0) || ',"chained":' || coalesce(n.n < b.n, true) || '}' AS item FROM n LEFT JOIN b USING (entity_id)""",
    "cases",
)
def report_audit_items(spark: SparkSession, d: str) -> DataFrame:
    """Each entry with what checks of its own find: every 83rd signature is of another text, and entries after a tampered one are no chain."""
    stored = fold.hash_chain(_audit(spark, d, False), "entity_id", ["created_at", "case_id"], "own").select("entity_id", "case_id", F.col("entry_hash").alias("stored"))
    now = fold.hash_chain(_audit(spark, d, True).join(stored, ["entity_id", "case_id"]), "entity_id", ["created_at", "case_id"], "own")
    text = F.concat_ws("|", "entity_id", "case_id")
    signature = V.hmac_sha256(_KEY, F.when(F.col("case_id") % 83 == 0, "another").otherwise(text))
    told = now.withColumns({"signed": signature == V.hmac_sha256(_KEY, text), "chained": F.col("stored") == F.col("entry_hash")})
    return reports.items(told, "entity_id", [F.col("created_at"), F.col("case_id")], ["case_id", "signed", "chained"], "audit_report")


_LISTS = ("o_orderkey % 3 = 0", "o_orderkey % 3 <> 0")


@query(
    """WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderpriority AS fact_type, CAST(o_orderkey % 9 AS VARCHAR) AS value, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS list FROM orders),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_type, value ORDER BY list, ord) AS r FROM c)
    SELECT doc_id, fact_type, value, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list, ord) AS k FROM f WHERE r = 1) WHERE k <= 20"""
)
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The own list before the universal one, the first of each type and value, 20 a document at most."""
    o = S.read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("fact_type"), (F.col("o_orderkey") % 9).cast("string").alias("value"))
    return reads.merged_first([o.where("ord % 3 = 0"), o.where("ord % 3 <> 0")], [F.col("fact_type"), F.col("value")], "doc_id", 20).select("doc_id", "fact_type", "value", "ord")


@query("SELECT user_id AS job_id, event_type AS artifact_type, event_id AS artifact_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_artifacts(spark: SparkSession, d: str) -> DataFrame:
    made = S.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("artifact_type"), F.col("event_id").alias("artifact_id"), "value")
    return reads.latest_of_type(made, ["job_id", "artifact_type"], "artifact_id")


@query(f"SELECT * FROM ({_VAULT_SQL}, z AS (SELECT * FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY vault_id, entity_id ORDER BY n DESC) = 1) SELECT vault_id, entity_id, CAST(len(list_filter(c, lambda x: x = 'open')) AS INT) AS n_open FROM z WHERE list_contains(c, 'open'))", "vault_updates")
def vault_open_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Entities of vaults that have open conflicts now, removed ones included, since history stays."""
    history = queues.vault_history(record(spark, d, "vault_updates"))
    last = history.groupBy("vault_id", "entity_id").agg(F.max_by("n_open", "seq").alias("n_open"))
    return last.where("n_open > 0")


@query("SELECT fact_id, field_name, value FROM (SELECT fact_id, lower(replace(field_name, '_', '_')) AS field_name, CASE WHEN fact_id % 3 = 0 THEN nullif(trim(value), '') WHEN fact_id % 5 <> 0 THEN 'shown ' || value END AS value FROM fact_rows WHERE status = 'accepted') WHERE value IS NOT NULL", "fact_rows")
def accepted_profile_view(spark: SparkSession, d: str) -> DataFrame:
    f = record(spark, d, "fact_rows")
    sides = {"field_name": F.upper(F.replace("field_name", F.lit("_"), F.lit(" - "))), "canonical_value": F.when(F.col("fact_id") % 3 == 0, F.col("value")).otherwise("  "), "display_value": F.when(F.col("fact_id") % 5 != 0, F.concat(F.lit("shown "), "value")).otherwise("")}
    return reads.profile_view(f.withColumns(sides).drop("value")).select("fact_id", "field_name", "value")


@query("SELECT case_id, fact_type, raw_value FROM case_rows WHERE fact_type IN ('iban', 'email')", "case_rows")
def requested_types(spark: SparkSession, d: str) -> DataFrame:
    return reads.requested(record(spark, d, "case_rows"), ["iban", "email"]).select("case_id", "fact_type", "raw_value")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, epoch_us(TIMESTAMP '2024-06-15') - epoch_us(ts) AS age_micros, epoch(TIMESTAMP '2024-06-15') - epoch(ts) >= 86400 * 30 AS expired FROM events")
def event_instants(spark: SparkSession, d: str) -> DataFrame:
    """Instants through their text and back, their age and whether they are thirty days old."""
    now = F.lit("2024-06-15 00:00:00").cast("timestamp")
    back = D.utc_time(D.utc_text(F.col("ts").cast("timestamp")))
    rows = S.read(spark, d, "events").withColumn("back", back)
    return rows.select("event_id", D.utc_text(F.col("back")).alias("text"), F.round(D.seconds_between(F.col("back"), now) * 1_000_000).cast("long").alias("age_micros"), D.is_expired(F.col("back"), now, F.lit(86400 * 30)).alias("expired"))


def _needs_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a model should look at again: passports, those with few candidates, and those of which the gate keeps few facts."""
    texts = spread(record(spark, d, "texts")).withColumn("kind", F.when(F.col("doc_id") % 50 == 0, " Passport").otherwise("invoice"))
    gated = extract.gate(extract.all_matches(texts)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("reject_reason").isNull()).alias("kept"))
    met = texts.join(gated, "doc_id", "left").fillna(0, ["n", "kept"])
    return met.select("doc_id", classify.needs_cleanup(F.col("kind"), F.col("text"), F.col("n"), F.col("kept")).alias("needs_cleanup"))


@query()
def cleanup_by_kept_facts(spark: SparkSession, d: str) -> DataFrame:
    return _needs_cleanup(spark, d)


_oracle(
    "cleanup_by_kept_facts",
    _GATED.replace("{0}", "texts")
    + ", c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (reject_reason IS NULL) AS kept FROM gated GROUP BY doc_id) SELECT t.doc_id, coalesce(t.doc_id % 50 = 0 OR contains(lower(text), 'passport') OR contains(lower(text), 'reisepass') OR coalesce(n, 0) < 6 OR coalesce(kept, 0) < 4, t.doc_id % 50 = 0) AS needs_cleanup FROM texts t LEFT JOIN c USING (doc_id)",
    "texts",
)


@query()
def second_gate(spark: SparkSession, d: str) -> DataFrame:
    """Facts that passed the gate once, judged again by another field's rule before a build: e-mail addresses as numbers of documents are none."""
    good = extract.gate(extract.all_matches(spread(record(spark, d, "texts")))).where("reject_reason is null")
    field = F.when((F.col("fact_type") == "email") & (F.col("ord") % 2 == 0), "document_number").otherwise(F.col("fact_type"))
    again = good.withColumn("field_name", field)
    return again.select("doc_id", "field_name", "value_norm", gates.reject_reason(F.col("field_name"), F.col("value_norm")).alias("reject_reason"))


_oracle(
    "second_gate",
    _GATED.replace("{0}", "texts")
    + " SELECT doc_id, CASE WHEN fact_type = 'email' AND ord % 2 = 0 THEN 'document_number' ELSE fact_type END AS field_name, value_norm, CASE WHEN fact_type = 'email' AND ord % 2 = 0 THEN 'document_number' END AS reject_reason FROM gated WHERE reject_reason IS NULL",
    "texts",
)
