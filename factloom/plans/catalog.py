"""All queries of the library over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import extract, geometry as G, knowledge as K, lifecycle as L
from factloom.sources import records as R
from factloom.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "review_flagship"

#: The views of ``factloom.sources.tables`` in SQL.
VIEWS = {
    "facts": "SELECT o_orderkey AS fact_id, o_custkey AS entity_id, o_orderpriority AS field_name, o_totalprice AS value, (o_orderkey * 37 % 101) / 100.0::DOUBLE AS confidence, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status, o_orderdate AS created_at FROM orders",
    "entities": "SELECT c_custkey AS entity_id, c_name AS display_name, c_mktsegment AS entity_type, c_nationkey AS nation_id FROM customer",
    "evidence": "SELECT l_orderkey AS fact_id, l_linenumber AS line_no, l_suppkey AS source_id, l_partkey AS part_id, l_shipdate AS created_at, l_discount AS confidence FROM lineitem",
    "sources": "SELECT s_suppkey AS source_id, s_name AS source_name, s_nationkey AS nation_id FROM supplier",
    "cases": "SELECT event_id AS case_id, user_id AS entity_id, event_type AS fact_type, (event_id * 37 % 101) / 100.0::DOUBLE AS confidence, ['PENDING','ASSIGNED','IN_REVIEW','COMPLETED','CANCELLED'][CAST(event_id % 5 AS INT) + 1] AS status, ts AS created_at, value FROM events",
    "docs": "SELECT doc_id, text, source, sha256(coalesce(text, '')) AS content_hash FROM documents",
}

VIEWS |= {name: R.sql(name) for name in R.RECORDS}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with its SQL over the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            with_views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
            ORACLES[f.__name__] = sql if not views else f"WITH {with_views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {with_views} {sql}"
        return f

    return add


#: The universal patterns as RE2 writes them: type, pattern, confidence.
PATTERNS = (
    ("email", r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", 0.80),
    ("iban", r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", 0.82),
    ("phone_number", r"(?:\+?\d[\d\s()./-]{7,}\d)", 0.55),
    ("date", r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", 0.55),
    ("amount", r"(?i)\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})\s?(?:EUR|€)\b", 0.45),
    ("document_number", r"(?i)\b[A-Z]{1,3}\d{5,10}\b", 0.45),
)
PATTERNS_SQL = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS fact_type, unnest(regexp_extract_all(text, '{regex}')) AS value, CAST({confidence} AS DOUBLE) AS confidence FROM texts" for kind, regex, confidence in PATTERNS)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents and the invented labelled ones, whose ids are negative."""
    return S.spread(R.record(spark, d, "texts"))


@query(PATTERNS_SQL, "texts")
def candidate_patterns(spark: SparkSession, d: str) -> DataFrame:
    return extract.all_matches(_texts(spark, d)).drop("ord")


@query()
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return extract.gate(extract.all_matches(_texts(spark, d))).select("doc_id", "fact_type", "value_norm", "confidence", "reject_reason")


@query(f"SELECT doc_id, fact_type, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_type, lower(value) ORDER BY value) AS r FROM ({PATTERNS_SQL})) WHERE r = 1", "texts")
def candidate_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    found = extract.all_matches(_texts(spark, d))
    return extract.first_wins(found, [F.col("doc_id"), F.col("fact_type"), F.lower("value")], [F.col("value")]).drop("ord")


@query()
def review_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents to review cases: patterns, gate, first-wins, priority, the best of each bucket."""
    good = extract.gate(extract.all_matches(S.spread(S.documents(spark, d).select("doc_id", "text")))).where("reject_reason is null")
    once = extract.first_wins(good, [F.col("doc_id"), F.col("fact_type"), F.lower("value_norm")], [F.col("ord")])
    rows = once.select(F.col("doc_id").alias("entity_id"), F.col("ord").alias("case_id"), "fact_type", F.col("value_norm").alias("value"), "confidence", K.priority_strict(F.col("confidence")).alias("priority"), F.lit(None).cast("timestamp").alias("created_at"))
    return K.bucket_top_k(rows).select("entity_id", "fact_type", "value", "confidence", "priority", "bucket", "rank")


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS n_words, length(coalesce(text, '')) AS n_chars, coalesce(text, '') <> '' AS has_text FROM documents")
def content_helpers(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return S.documents(spark, d).select("doc_id", F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("n_words"), F.length(text).cast("long").alias("n_chars"), (text != "").alias("has_text"))


@query("SELECT content_hash, min(doc_id) AS first_id, count(*) AS copies FROM docs GROUP BY content_hash", "docs")
def doc_dedup_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query(f"SELECT doc_id, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, count(DISTINCT fact_type) AS n_types, count(*) < 6 AS few FROM ({PATTERNS_SQL}) GROUP BY doc_id", "texts")
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    found = extract.all_matches(_texts(spark, d))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count_distinct("fact_type").alias("n_types"), (F.count("*") < 6).alias("few"))


@query("SELECT status, field_name, count(*) AS n FROM facts GROUP BY ALL", "facts")
def facts_by_status(spark: SparkSession, d: str) -> DataFrame:
    return S.facts(spark, d).groupBy("status", "field_name").agg(F.count("*").alias("n"))


@query("SELECT fact_id, entity_id, field_name, confidence FROM facts WHERE status IN ('pending', 'accepted') AND confidence >= 0.5 AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01'", "facts")
def facts_filtered(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d)
    return f.where(F.col("status").isin("pending", "accepted") & (F.col("confidence") >= 0.5) & (F.col("created_at") >= "1995-01-01") & (F.col("created_at") < "1997-01-01")).select("fact_id", "entity_id", "field_name", "confidence")


@query("SELECT entity_id, count(*) FILTER (o) AS pending, count(*) FILTER (status IN ('COMPLETED', 'ACCEPTED')) AS accepted, count(*) FILTER (status IN ('CANCELLED', 'REJECTED')) AS rejected, count(*) FILTER (o AND s) AS visible, count(*) FILTER (o AND NOT s) AS hidden FROM (SELECT *, status NOT IN ('COMPLETED', 'CANCELLED', 'ACCEPTED', 'REJECTED') AS o, confidence >= 0.5 AND fact_type NOT IN ('review_candidate', 'bic') AS s FROM cases) GROUP BY entity_id", "cases")
def review_metrics(spark: SparkSession, d: str) -> DataFrame:
    return K.review_metrics(S.cases(spark, d))


@query("SELECT entity_id, case_id, bucket, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id, bucket ORDER BY confidence DESC, created_at DESC, case_id) AS INT) AS rank FROM (SELECT *, CASE WHEN confidence >= 0.9 AND confidence < 1.01 THEN 0 WHEN confidence >= 0.8 AND confidence < 0.9 THEN 1 WHEN confidence >= 0.7 AND confidence < 0.8 THEN 2 WHEN confidence >= 0.6 AND confidence < 0.7 THEN 3 WHEN confidence >= 0.5 AND confidence < 0.6 THEN 4 WHEN confidence < 0.5 THEN 5 END AS bucket FROM cases)) WHERE rank <= 20 AND bucket IS NOT NULL", "cases")
def review_buckets_topk(spark: SparkSession, d: str) -> DataFrame:
    return K.bucket_top_k(S.cases(spark, d)).select("entity_id", "case_id", "bucket", "rank")


@query("SELECT case_id, CASE WHEN confidence < 0.4 THEN 'HIGH' WHEN confidence < 0.6 THEN 'NORMAL' ELSE 'LOW' END AS strict, CASE WHEN confidence < 0.6 THEN 'HIGH' WHEN confidence < 0.8 THEN 'NORMAL' ELSE 'LOW' END AS lenient, confidence < 0.75 AS needs_review FROM cases", "cases")
def priority_from_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return S.cases(spark, d).select("case_id", K.priority_strict(c).alias("strict"), K.priority_lenient(c).alias("lenient"), (c < 0.75).alias("needs_review"))


@query("SELECT entity_id, case_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN confidence < 0.4 THEN 2 WHEN confidence < 0.6 THEN 3 ELSE 4 END, created_at, case_id) AS INT) AS place FROM cases WHERE status NOT IN ('COMPLETED', 'CANCELLED')", "cases")
def review_queue_order(spark: SparkSession, d: str) -> DataFrame:
    open_cases = S.cases(spark, d).where(~F.col("status").isin("COMPLETED", "CANCELLED"))
    w = Window.partitionBy("entity_id").orderBy(K.priority_rank(K.priority_strict(F.col("confidence"))), "created_at", "case_id")
    return open_cases.select("entity_id", "case_id", F.row_number().over(w).alias("place"))


@query("SELECT DISTINCT fact_type FROM cases WHERE status = 'PENDING' AND confidence >= 0.5 UNION ALL SELECT 'All'", "cases")
def fact_types_distinct(spark: SparkSession, d: str) -> DataFrame:
    c = S.cases(spark, d).where((F.col("status") == "PENDING") & (F.col("confidence") >= 0.5)).select("fact_type").distinct()
    return c.unionByName(spark.range(1).select(F.lit("All").alias("fact_type")))


@query("SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM facts WHERE status = 'accepted') AS accepted, (SELECT count(*) FROM facts WHERE status = 'pending') AS pending, (SELECT count(DISTINCT entity_id) FROM facts) AS with_facts, (SELECT count(*) FROM cases WHERE status = 'PENDING') AS open_cases", "entities", "facts", "cases")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d).agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_distinct("entity_id").alias("with_facts"))
    return S.entities(spark, d).agg(F.count("*").alias("entities")).crossJoin(f).crossJoin(S.cases(spark, d).agg(F.count_if(F.col("status") == "PENDING").alias("open_cases")))


@query("SELECT entity_id, CASE WHEN coalesce(pending, 0) > 5 THEN 'review' WHEN coalesce(accepted, 0) = 0 THEN 'upload' WHEN coalesce(pending, 0) > 0 THEN 'check' ELSE 'ready' END AS step FROM entities LEFT JOIN (SELECT entity_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'accepted') AS accepted FROM facts GROUP BY entity_id) USING (entity_id)", "entities", "facts")
def next_step(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d).groupBy("entity_id").agg(F.count_if(F.col("status") == "pending").alias("p"), F.count_if(F.col("status") == "accepted").alias("a"))
    p, a = F.coalesce("p", F.lit(0)), F.coalesce("a", F.lit(0))
    return S.entities(spark, d).join(f, "entity_id", "left").select("entity_id", F.when(p > 5, "review").when(a == 0, "upload").when(p > 0, "check").otherwise("ready").alias("step"))


@query("SELECT entity_id, field_name, fact_id, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY confidence DESC, created_at, fact_id) AS r FROM facts WHERE status = 'accepted') WHERE r = 1", "facts")
def profile_best_fact(spark: SparkSession, d: str) -> DataFrame:
    return K.best_fact(S.facts(spark, d).where("status = 'accepted'"), ["entity_id", "field_name"]).select("entity_id", "field_name", "fact_id", "value", "confidence")


FIELDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"SELECT entity_id, CAST(count(DISTINCT field_name) AS INT) AS n_covered, round(count(DISTINCT field_name) / 5.0::DOUBLE, 4) AS completeness FROM facts WHERE field_name IN ({', '.join(repr(f) for f in FIELDS)}) GROUP BY entity_id", "facts")
def profile_completeness(spark: SparkSession, d: str) -> DataFrame:
    return K.completeness(S.facts(spark, d), FIELDS).where("n_covered > 0").select("entity_id", "n_covered", "completeness")


@query("SELECT count(*) AS n FROM (SELECT entity_id FROM facts WHERE status = 'accepted' UNION SELECT entity_id FROM cases)", "facts", "cases")
def profile_union_count(spark: SparkSession, d: str) -> DataFrame:
    return S.facts(spark, d).where("status = 'accepted'").select("entity_id").union(S.cases(spark, d).select("entity_id")).distinct().agg(F.count("*").alias("n"))


@query("SELECT e.entity_id, n_name AS nation, r_name AS region, count(f.fact_id) AS facts FROM entities e JOIN nation ON nation_id = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN facts f ON f.entity_id = e.entity_id AND f.status = 'accepted' GROUP BY ALL", "entities", "facts")
def connected_entities(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d).where("status = 'accepted'").groupBy("entity_id").agg(F.count("*").alias("k"))
    e = S.entities(spark, d).join(S.read(spark, d, "nation"), F.col("nation_id") == F.col("n_nationkey")).join(S.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return e.join(f, "entity_id", "left").select("entity_id", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("k", F.lit(0)).alias("facts"))


@query("SELECT source_id, source_name, count(*) AS n, min(created_at) AS first_at, max(confidence) AS best FROM evidence JOIN sources USING (source_id) GROUP BY ALL", "evidence", "sources")
def evidence_by_document(spark: SparkSession, d: str) -> DataFrame:
    return S.evidence(spark, d).join(S.sources(spark, d), "source_id").groupBy("source_id", "source_name").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("confidence").alias("best"))


@query("SELECT entity_id, field_name, count(DISTINCT value) AS n_values, len(list(DISTINCT fact_id)) AS n_facts FROM facts GROUP BY ALL HAVING count(DISTINCT value) > 1", "facts")
def conflict_details(spark: SparkSession, d: str) -> DataFrame:
    return S.facts(spark, d).groupBy("entity_id", "field_name").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("fact_id").alias("n_facts")).where("n_values > 1")


@query("SELECT fact_id, entity_id, field_name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at, fact_id) AS r FROM facts WHERE status = 'pending') p WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM facts a WHERE a.status = 'accepted' AND a.entity_id = p.entity_id AND a.field_name = p.field_name)", "facts")
def dedup_fact_keys(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d)
    return K.new_rows(f.where("status = 'pending'"), f.where("status = 'accepted'"), ["entity_id", "field_name"], [F.col("created_at"), F.col("fact_id")]).select("fact_id", "entity_id", "field_name")


@query("SELECT fact_id, line_no FROM evidence e WHERE EXISTS (SELECT 1 FROM facts f WHERE f.fact_id = e.fact_id AND status = 'accepted' AND confidence >= 0.9)", "evidence", "facts")
def kept_links_semijoin(spark: SparkSession, d: str) -> DataFrame:
    return S.evidence(spark, d).join(S.facts(spark, d).where((F.col("status") == "accepted") & (F.col("confidence") >= 0.9)), "fact_id", "left_semi").select("fact_id", "line_no")


@query("SELECT case_id AS job_id FROM cases WHERE status IN ('PENDING', 'ASSIGNED') ORDER BY CAST(value AS INT) DESC, created_at, case_id LIMIT 10", "cases")
def lease_order(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("status") == "PENDING", "pending").when(F.col("status") == "ASSIGNED", "retrying").otherwise("done")
    jobs = S.cases(spark, d).select(F.col("case_id").alias("job_id"), status.alias("status"), F.round("value").cast("int").alias("priority"), "created_at", F.col("created_at").alias("available_at"))
    return K.lease(jobs, F.lit("2100-01-01").cast("timestamp"), 10).select("job_id")


@query("SELECT job_id, n, CASE WHEN c THEN 'ABORT' WHEN r THEN 'RETRY' WHEN v THEN 'ESCALATE' ELSE 'ABORT' END AS decision FROM (SELECT entity_id AS job_id, count(*) AS n, bool_or(confidence < 0.01) AS c, bool_or(status = 'ASSIGNED') AS r, bool_or(status = 'IN_REVIEW') AS v FROM cases GROUP BY entity_id)", "cases")
def recovery_decision(spark: SparkSession, d: str) -> DataFrame:
    c = S.cases(spark, d)
    return K.recovery(c.select(F.col("entity_id").alias("job_id"), F.when(F.col("confidence") < 0.01, "CRITICAL").otherwise("ERROR").alias("severity"), (F.col("status") == "ASSIGNED").alias("is_retryable"), (F.col("status") == "IN_REVIEW").alias("requires_review")))


@query("SELECT fact_type, count(*) AS total, count(*) FILTER (confidence < 0.1) AS critical, count(*) FILTER (confidence >= 0.1 AND confidence < 0.5) AS error, count(*) FILTER (confidence >= 0.5) AS warning FROM cases GROUP BY fact_type", "cases")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return S.cases(spark, d).groupBy("fact_type").agg(F.count("*").alias("total"), F.count_if(c < 0.1).alias("critical"), F.count_if((c >= 0.1) & (c < 0.5)).alias("error"), F.count_if(c >= 0.5).alias("warning"))


@query(f"SELECT entity_id, count(*) FILTER (v IS NOT NULL) AS filled, round(count(*) FILTER (v IS NOT NULL) / 5.0::DOUBLE, 2) AS readiness FROM (SELECT e.entity_id, t.f, max(x.value) AS v FROM entities e CROSS JOIN (SELECT unnest({FIELDS!r}) AS f) t LEFT JOIN facts x ON x.entity_id = e.entity_id AND x.field_name = t.f AND x.status = 'accepted' GROUP BY ALL) GROUP BY entity_id", "entities", "facts")
def form_preview(spark: SparkSession, d: str) -> DataFrame:
    template = S.entities(spark, d).select("entity_id", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field_id")).withColumn("required", F.lit(True))
    mapping = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field_id")).withColumn("fact_type", F.col("field_id"))
    best = K.best_fact(S.facts(spark, d).where("status = 'accepted'"), ["entity_id", "field_name"]).select("entity_id", F.col("field_name").alias("fact_type"), "value")
    return K.readiness(K.form_preview(template, mapping, best)).select("entity_id", "filled", "readiness")


@query("SELECT fact_id, entity_id, CASE WHEN fact_id % 3 = 0 THEN 'superseded' ELSE status END AS status FROM facts", "facts")
def upsert_facts(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d).select("fact_id", "entity_id", "status")
    return K.upsert(f, f.where("fact_id % 3 = 0").withColumn("status", F.lit("superseded")), ["fact_id"], ["entity_id"])


@query("SELECT status, CASE WHEN fact_id % 2 = 0 THEN 'accepted' ELSE 'superseded' END AS wanted, (status || '>' || CASE WHEN fact_id % 2 = 0 THEN 'accepted' ELSE 'superseded' END) IN ('pending>accepted', 'pending>rejected', 'accepted>superseded') AS legal, count(*) AS n FROM facts GROUP BY ALL", "facts")
def fact_transitions(spark: SparkSession, d: str) -> DataFrame:
    asked = S.facts(spark, d).withColumn("wanted", F.when(F.col("fact_id") % 2 == 0, "accepted").otherwise("superseded"))
    return K.transitions(asked, [("pending", "accepted"), ("pending", "rejected"), ("accepted", "superseded")], "status", "wanted").groupBy("status", "wanted", "legal").agg(F.count("*").alias("n"))


@query("SELECT fact_id, rule, CASE rule WHEN 'range' THEN value BETWEEN 1000 AND 200000 ELSE regexp_full_match(CAST(field_name AS VARCHAR), '[1-5]-[A-Z ]+') END AS passed FROM facts, (SELECT unnest(['range', 'format']) AS rule)", "facts")
def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d)
    amounts = K.validate(f.select("fact_id", F.lit("amount").alias("fact_type"), F.col("value").cast("string").alias("value")), [{"rule_id": "range", "kind": "range", "fact_type": "amount", "least": 1000.0, "most": 200000.0}])
    names = K.validate(f.select("fact_id", F.lit("name").alias("fact_type"), F.col("field_name").alias("value")), [{"rule_id": "format", "kind": "format", "fact_type": "name", "regex": "[1-5]-[A-Z ]+"}])
    return amounts.unionByName(names).select("fact_id", F.col("rule_id").alias("rule"), "passed")


@query("SELECT doc_id, lower(trim(regexp_replace(coalesce(source, ''), '[-\\s_]+', '_', 'g'))) AS source_key FROM documents")
def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", T.normalize_key(F.coalesce("source", F.lit(""))).alias("source_key"))


@query(
    r"""SELECT doc_id, CAST(len(list_filter(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '' AND NOT regexp_matches(lower(x), 'https?://|www\.'))) AS INT) AS n_lines FROM documents"""
)
def clean_document_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", F.size(T.clean_lines(F.coalesce("text", F.lit("")))).alias("n_lines"))


@query(
    r"""WITH l AS (
      SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, unnest(range(len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))))) AS i FROM texts
    ), c AS (
      SELECT doc_id, i, upper(regexp_replace(line, '\s+', '', 'g')) AS value FROM l WHERE NOT regexp_matches(lower(line), 'https?://|www\.')
    ), m AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord FROM c WHERE regexp_full_match(value, '[A-Z0-9<]{25,44}') AND contains(value, '<')
    )
    SELECT doc_id, 'mrz_line' AS fact_type, value, 0.78::DOUBLE AS confidence, ord FROM m WHERE ord < 3""",
    "texts",
)
def mrz_line_candidates(spark: SparkSession, d: str) -> DataFrame:
    return extract.mrz_lines(_texts(spark, d))


@query()
def signed_audit_entries(spark: SparkSession, d: str) -> DataFrame:
    c = S.cases(spark, d).withColumn("payload", F.concat_ws("|", F.col("case_id").cast("string"), "fact_type", "status"))
    return c.select("case_id", V.hmac_sha256(b"key of the audit chain of a test", F.col("payload")).alias("signature"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, sum(value) > 0 AS any_value FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), (F.sum("value") > 0).alias("any_value"))


@query("SELECT o_orderkey AS fact_id, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-01') AS month, CAST(o_orderdate AS DATE) < DATE '1996-06-01' AS past, CAST(o_orderdate AS DATE) > DATE '1996-06-01' AS ahead FROM orders")
def fact_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in four spellings, read back; months of pay; birth and expiry checks."""
    o = S.read(spark, d, "orders")
    shape = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    day = D.knowledge_date(F.when(k == 0, shape("d.M.yyyy")).when(k == 1, shape("yyyy/MM/dd")).when(k == 2, shape("yyyyMMdd")).otherwise(shape("ddMMyy")))
    as_of = F.lit("1996-06-01").cast("date")
    return o.select(F.col("o_orderkey").alias("fact_id"), day.cast("string").alias("day"), D.pay_month(shape("M.yyyy"))["day"].alias("month"), D.birth_date_ok(day, as_of).alias("past"), D.expiry_date_ok(day, as_of).alias("ahead"))


@query("SELECT fact_id, value BETWEEN 100 AND 40000 AS ok, CASE WHEN value BETWEEN 100 AND 40000 THEN 0.90 ELSE 0.55 END::DOUBLE AS confidence FROM facts", "facts")
def amount_checks(spark: SparkSession, d: str) -> DataFrame:
    return S.facts(spark, d).select("fact_id", V.amount_check(F.lit("net_salary"), F.col("value").cast("string")).alias("c")).select("fact_id", "c.ok", "c.confidence")


@query("SELECT event_id, props AS answer FROM events")
def recovered_json(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "events").select("event_id", V.recover_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("answer"))


BOXES_SQL = "b AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_suppkey % 20 AS DOUBLE) AS x, CAST(l_partkey % 20 AS DOUBLE) AS y, l_quantity AS w, l_quantity AS h FROM lineitem)"


@query(f"WITH {BOXES_SQL}, p AS (SELECT a.k, a.n, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s, a.x <= b.x AND a.y <= b.y AND a.x + a.w >= b.x + b.w AND a.y + a.h >= b.y + b.h AS c FROM b a JOIN b ON a.k = b.k AND a.n + 1 = b.n) SELECT k AS doc_id, n AS line_no, i / (s - i) AS iou, c AS contains FROM p")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct((F.col("l_suppkey") % 20).cast("double").alias("x"), (F.col("l_partkey") % 20).cast("double").alias("y"), F.col("l_quantity").alias("width"), F.col("l_quantity").alias("height")).alias("box"))
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).cast("int").alias("l_linenumber"), F.col("box").alias("next"))
    a, b = F.col("box"), F.col("next")
    return rows.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), G.iou(a, b).alias("iou"), G.contains(a, b).alias("contains"))


@query(f"WITH {BOXES_SQL} SELECT k AS doc_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM b GROUP BY k")
def box_envelopes(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct((F.col("l_suppkey") % 20).cast("double").alias("x"), (F.col("l_partkey") % 20).cast("double").alias("y"), F.col("l_quantity").alias("width"), F.col("l_quantity").alias("height"))
    return G.envelope(S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), box.alias("box")), ["doc_id"]).select("doc_id", "box.*")


@query()
def page_confidences(spark: SparkSession, d: str) -> DataFrame:
    return G.page_confidence(S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_discount").alias("conf")))


@query("SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM (SELECT conv_id AS doc_id, turn // 2 AS page, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY ALL) GROUP BY doc_id")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    c = S.read(spark, d, "conversations")
    return G.page_text(c.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("block"), "text"))


@query("WITH c AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS value FROM conversations WHERE turn = 0) SELECT c.conv_id AS doc_id, value, count(DISTINCT t.turn) AS n_spans FROM c JOIN conversations t ON c.conv_id = t.conv_id AND contains(upper(t.text), upper(value)) AND trim(value) <> '' GROUP BY ALL")
def spans_of_values(spark: SparkSession, d: str) -> DataFrame:
    c = S.read(spark, d, "conversations")
    first = c.where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("value")).distinct().withColumn("candidate_id", F.xxhash64("doc_id", "value"))
    found = G.spans_with_value(first, c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("span_id"), "text"))
    return found.where(F.size("span_ids") > 0).select("doc_id", "value", F.size("span_ids").cast("long").alias("n_spans"))


@query()
def case_states(spark: SparkSession, d: str) -> DataFrame:
    """Each user's case after all of the user's events, folded in order of time."""
    action = F.element_at(F.array(*[F.lit(a) for a in ("assign", "start", "escalate", "complete", "cancel")]), (F.col("event_id") % 5 + 1).cast("int"))
    return L.fold_cases(S.read(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("ts").alias("at"), action.alias("action")))


@query("SELECT was, wanted, (was || '>' || wanted) IN (" + ", ".join(f"'{a}>{b}'" for a, b in L.DOCUMENT_STEPS) + ") AS legal, count(*) AS n FROM (SELECT ['PENDING','PROCESSING','PROCESSED','FAILED'][CAST(event_id % 4 AS INT) + 1] AS was, ['PENDING','PROCESSING','PROCESSED','FAILED'][CAST(user_id % 4 AS INT) + 1] AS wanted FROM events) GROUP BY ALL")
def document_transitions(spark: SparkSession, d: str) -> DataFrame:
    state = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("PENDING", "PROCESSING", "PROCESSED", "FAILED")]), (F.col(c) % 4 + 1).cast("int"))
    asked = S.read(spark, d, "events").select(state("event_id").alias("was"), state("user_id").alias("wanted"))
    return K.transitions(asked, L.DOCUMENT_STEPS, "was", "wanted").groupBy("was", "wanted", "legal").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT DISTINCT source_id, part_id AS entity_id FROM evidence WHERE source_id NOT IN (SELECT source_id FROM sources WHERE source_id % 2 = 0)), l AS (SELECT o_custkey AS entity_id, o_orderkey AS document_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT source_id, entity_id, document_id FROM m LEFT JOIN l USING (entity_id)", "evidence", "sources")
def source_backfill(spark: SparkSession, d: str) -> DataFrame:
    orders = S.read(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))
    evidence = S.evidence(spark, d).select("source_id", F.col("part_id").alias("entity_id"))
    return L.with_sources(evidence, S.sources(spark, d).where("source_id % 2 = 0"), orders).select("source_id", "entity_id", "document_id")


@query("SELECT DISTINCT entity_id, case_id % 7 AS document_id, fact_type AS stage FROM cases c WHERE NOT EXISTS (SELECT 1 FROM cases n WHERE n.confidence < 0.05 AND n.entity_id = c.entity_id AND n.case_id % 7 = c.case_id % 7 AND n.fact_type = c.fact_type)", "cases")
def deferred_noise(spark: SparkSession, d: str) -> DataFrame:
    c = S.cases(spark, d).select("entity_id", (F.col("case_id") % 7).alias("document_id"), F.lit(None).cast("string").alias("source_id"), F.col("fact_type").alias("stage"), "confidence")
    return L.deferred_noise(c, c.where("confidence < 0.05").withColumn("status", F.lit("open"))).select("entity_id", "document_id", "stage")


@query("SELECT case_id, coalesce(t, 0) + row_number() OVER (PARTITION BY c.entity_id ORDER BY created_at, case_id) AS sequence_number FROM cases c LEFT JOIN (SELECT entity_id, max(fact_id) AS t FROM facts GROUP BY entity_id) f ON c.entity_id = f.entity_id", "cases", "facts")
def next_sequences(spark: SparkSession, d: str) -> DataFrame:
    stored = S.facts(spark, d).select("entity_id", F.col("fact_id").alias("sequence_number"))
    return L.next_sequence(S.cases(spark, d), stored, ["entity_id"], [F.col("created_at"), F.col("case_id")]).select("case_id", "sequence_number")


@query("SELECT entity_id, field_name, fact_id FROM facts WHERE status = 'accepted' QUALIFY row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at DESC, fact_id DESC) = 1", "facts")
def profile_latest_fact(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_accepted(S.facts(spark, d)).select("entity_id", "field_name", "fact_id")


@query("SELECT fact_id, NOT EXISTS (SELECT 1 FROM facts a WHERE a.status = 'accepted' AND a.entity_id = f.entity_id AND a.field_name = f.field_name AND CAST(floor(a.value / 20000) AS BIGINT) = CAST(floor(f.value / 20000) AS BIGINT)) AS passed FROM facts f WHERE status = 'pending'", "facts")
def duplicate_rule(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d).withColumn("value", F.floor(F.col("value") / 20000))
    return L.duplicate_rule(f.where("status = 'pending'"), f).select("fact_id", "passed")


@query("WITH o AS (SELECT entity_id, count(*) AS n, any_value(value) AS v FROM facts WHERE status = 'accepted' AND field_name = '5-LOW' GROUP BY entity_id) SELECT fact_id, coalesce(n > 1, false) AND field_name = '1-URGENT' AS error, CASE WHEN field_name <> '1-URGENT' OR n IS NULL THEN true WHEN n > 1 THEN false ELSE value < v END AS passed FROM facts f LEFT JOIN o ON f.entity_id = o.entity_id WHERE status = 'pending'", "facts")
def consistency_rule(spark: SparkSession, d: str) -> DataFrame:
    f = S.facts(spark, d)
    return L.consistency_rule(f.where("status = 'pending'"), f, "1-URGENT", "5-LOW", "<", "number").select("fact_id", "error", "passed")


@query("SELECT fact_id, string_agg(DISTINCT CAST(source_id AS VARCHAR), ',' ORDER BY CAST(source_id AS VARCHAR)) AS evidence_ids, CAST(count(DISTINCT source_id) AS INT) AS n_evidence FROM evidence GROUP BY fact_id", "evidence")
def evidence_of_facts(spark: SparkSession, d: str) -> DataFrame:
    links = S.evidence(spark, d).select("fact_id", F.col("source_id").cast("string").alias("evidence_id"))
    return L.evidence_of_facts(links).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("SELECT DISTINCT o_custkey * 3 AS id FROM orders WHERE o_custkey * 3 NOT IN (SELECT entity_id FROM entities)", "entities")
def manifest_gaps(spark: SparkSession, d: str) -> DataFrame:
    entries = S.read(spark, d, "orders").select((F.col("o_custkey") * 3).alias("id")).distinct()
    return L.manifest_gaps(entries, S.entities(spark, d).select(F.col("entity_id").alias("id")))


@query("SELECT doc_id, fact_type, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS value, CAST(confidence AS DOUBLE) AS confidence FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{p.fact_type}' AS fact_type, regexp_extract(replace(text, chr(10), ' '), '{p.regex}') AS value, {p.confidence} AS confidence FROM documents" for p in extract.FALLBACK) + ") WHERE value <> ''")
def fallback_facts(spark: SparkSession, d: str) -> DataFrame:
    return extract.fallback_matches(S.documents(spark, d)).drop("ord")


@query()
def contextual_patterns(spark: SparkSession, d: str) -> DataFrame:
    return extract.contextual_matches(_texts(spark, d))


@query(
    r"""WITH q AS (SELECT question_id, trim(text) AS t FROM question_rows),
    n AS (SELECT question_id, 'name' AS fact_type, trim(regexp_replace(regexp_extract(t, '(?i)\b(?:i am|i''m|my name is)\s+([a-z][a-z\s''-]{1,80}?)(?:\s+\d{1,3}\s+years old|\s+and|\s+will|\s+can|\s+save|$)', 1), '\s+', ' ', 'g')) AS value FROM q),
    a AS (SELECT question_id, 'age' AS fact_type, TRY_CAST(coalesce(nullif(regexp_extract(t, '(?i)\b(\d{1,3})\s+years old\b', 1), ''), regexp_extract(t, '(?i)\bmy age is\s+(\d{1,3})\b', 1)) AS INT) AS age FROM q)
    SELECT question_id, fact_type, value, 0.5::DOUBLE AS confidence FROM n WHERE value <> ''
    UNION ALL SELECT question_id, fact_type, CAST(age AS VARCHAR), 0.5::DOUBLE FROM a WHERE age BETWEEN 1 AND 129""",
    "question_rows",
)
def self_declared_facts(spark: SparkSession, d: str) -> DataFrame:
    return extract.self_declared(R.record(spark, d, "question_rows")).select("question_id", "fact_type", "value", "confidence")


# the other modules of queries register theirs here
from factloom.plans import build_queries, classify_queries, gate_sql, knowledge_queries, passport_queries, read_queries, record_queries, scalar_queries, screen_queries, store_queries  # noqa: E402, F401
