"""Queries of entity resolution, acceptance and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import acceptance, knowledge as K, resolution
from factloom.plans.catalog import query
from factloom.sources import tables as S
from factloom.sources.records import record

#: Candidates of invented clusters: groups are customers' thirds, clusters the customers, types and values made from order numbers.
CANDIDATES = """
    SELECT o_custkey % 60 AS group_id, o_custkey AS entity_id, o_orderkey AS ord,
      CASE o_orderkey % 4 WHEN 0 THEN 'full_name' WHEN 1 THEN 'city' WHEN 2 THEN 'iban' ELSE 'job' END AS fact_type,
      CASE WHEN o_orderkey % 4 = 2 THEN CASE WHEN o_custkey % 60 < 20 THEN 'DE1' ELSE concat('DE', CAST(o_custkey % 3 AS STRING)) END
        WHEN o_custkey % 60 < 10 THEN 'same value' ELSE concat('value ', CAST(o_orderkey % 7 AS STRING)) END AS value,
      CAST(o_orderkey * 37 % 101 AS DOUBLE) / 100 AS confidence
    FROM {orders}"""
CANDIDATES_SQL = CANDIDATES.replace("{orders}", "orders")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CANDIDATES, orders=S.read(spark, d, "orders"))


#: Longest common subsequences of two of the invented values: they differ in their last character only, or are other words.
_MATCHES_SQL = """
    best AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, entity_id, fact_type ORDER BY confidence DESC, ord) AS r FROM candidates) WHERE r = 1
    ), held AS (
      SELECT group_id, fact_type, value, count(*) AS n FROM best GROUP BY ALL
    ), met AS (
      SELECT group_id, fact_type, value AS value_a, value AS value_b, n * (n - 1) // 2 AS pairs, 1.0::DOUBLE AS ratio FROM held WHERE n > 1
      UNION ALL
      SELECT a.group_id, a.fact_type, a.value, b.value, a.n * b.n, CASE WHEN a.fact_type = 'iban' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (len(a.value) - 1) / (len(a.value) + len(b.value)) END
      FROM held a JOIN held b ON a.group_id = b.group_id AND a.fact_type = b.fact_type AND a.value < b.value
    ), scored AS (
      SELECT *, CASE WHEN fact_type <> 'iban' AND ratio < 0.6 THEN ratio / 2 ELSE ratio END AS confidence FROM met
    ), signed AS (
      SELECT *, CASE WHEN fact_type = 'iban' AND value_a <> value_b THEN 'CONFLICT' WHEN confidence >= 0.9 THEN 'STRONG' WHEN confidence >= 0.7 THEN 'MODERATE' WHEN confidence >= 0.4 THEN 'WEAK' ELSE 'UNKNOWN' END AS signal FROM scored
    )"""


@query(f"WITH candidates AS ({CANDIDATES_SQL}), {_MATCHES_SQL} SELECT group_id, fact_type, value_a, value_b, pairs, CASE fact_type WHEN 'iban' THEN 'identifier' ELSE 'fuzzy' END AS strategy, confidence, signal FROM signed")
def entity_pair_matches(spark: SparkSession, d: str) -> DataFrame:
    best = resolution.best_of_clusters(_candidates(spark, d))
    return resolution.matches(best).select("group_id", "fact_type", "value_a", "value_b", "pairs", "strategy", "confidence", "signal")


#: Names that differ in several places, by customer; groups of them meet.
_NAMES_SQL = "SELECT c_nationkey AS group_id, c_custkey AS entity_id, 'full_name' AS fact_type, c_custkey AS ord, 0.5 AS confidence, concat(CASE c_custkey % 4 WHEN 0 THEN 'Anna ' WHEN 1 THEN 'Ann-Marie ' WHEN 2 THEN 'HANNAH ' ELSE '' END, CASE c_custkey % 5 WHEN 0 THEN 'Muster' WHEN 1 THEN 'Musterman' WHEN 2 THEN 'Mustard' WHEN 3 THEN 'Sumter' ELSE 'of the Mill' END, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' jr.' ELSE ' B' END) AS value FROM {customer}"


@query(
    f"""WITH RECURSIVE held AS (SELECT DISTINCT group_id, value FROM ({_NAMES_SQL.replace('{customer}', 'customer')})),
    pairs AS (SELECT DISTINCT a.value AS value_a, b.value AS value_b FROM held a JOIN held b USING (group_id) WHERE a.value < b.value),
    t AS (
      SELECT value_a, value_b, 0 AS i, list_transform(range(0, len(value_b) + 1), lambda j: 0) AS r FROM pairs
      UNION ALL
      SELECT value_a, value_b, i + 1, list_reduce(range(1, len(value_b) + 1), lambda acc, j: list_append(acc, greatest(acc[-1], r[j + 1], CASE WHEN lower(value_a)[i + 1] = lower(value_b)[j] THEN r[j] + 1 ELSE 0 END)), [0]) FROM t WHERE i < len(value_a)
    ), l AS (SELECT value_a, value_b, 2.0::DOUBLE * r[-1] / (len(value_a) + len(value_b)) AS ratio FROM t WHERE i = len(value_a)),
    scored AS (SELECT group_id, a.value AS value_a, b.value AS value_b, CASE WHEN ratio < 0.6 THEN ratio / 2 ELSE ratio END AS confidence FROM held a JOIN held b USING (group_id) JOIN l ON l.value_a = a.value AND l.value_b = b.value)
    SELECT *, CASE WHEN confidence >= 0.9 THEN 'STRONG' WHEN confidence >= 0.7 THEN 'MODERATE' WHEN confidence >= 0.4 THEN 'WEAK' ELSE 'UNKNOWN' END AS signal FROM scored"""
)
def fuzzy_name_matches(spark: SparkSession, d: str) -> DataFrame:
    """The distinct names of each group compared, by a longest common subsequence that the check works out cell by cell."""
    names = spark.sql(_NAMES_SQL, customer=S.read(spark, d, "customer"))
    return resolution.matches(names).where("value_a <> value_b").select("group_id", "value_a", "value_b", "confidence", "signal")


_RESOLVED_SQL = """
    clusters AS (
      SELECT group_id, entity_id, sum(confidence) AS total, min(ord) AS first FROM candidates GROUP BY ALL
    ), first_of AS (
      SELECT group_id, entity_id, count(*) OVER (PARTITION BY group_id) AS clusters, row_number() OVER (PARTITION BY group_id ORDER BY round(total, 9) DESC, first) AS r FROM clusters
    ), weighed AS (
      SELECT *, pairs * CASE fact_type WHEN 'iban' THEN 0.95 WHEN 'full_name' THEN 0.7 ELSE 0.5 END::DOUBLE AS w FROM signed
    ), found AS (
      SELECT group_id, sum(confidence * w) / sum(w) AS score, string_agg(DISTINCT fact_type, ',' ORDER BY fact_type) FILTER (signal = 'CONFLICT') AS conflict_types FROM weighed GROUP BY group_id
    ), resolved AS (
      SELECT p.group_id, clusters, entity_id AS primary_id,
        CASE WHEN clusters = 1 THEN 'single' WHEN conflict_types IS NOT NULL THEN 'conflict' WHEN coalesce(score, 0) < 0.65 THEN 'apart' ELSE 'merged' END AS decision, score, conflict_types
      FROM first_of p LEFT JOIN found USING (group_id) WHERE r = 1
    )"""


@query(
    f"""WITH candidates AS ({CANDIDATES_SQL}), {_MATCHES_SQL}, {_RESOLVED_SQL}
    SELECT group_id, clusters, primary_id, decision, round(CASE WHEN decision IN ('single', 'apart') THEN 1.0::DOUBLE ELSE coalesce(score, 0) END, 6) AS score,
      CASE WHEN decision = 'conflict' THEN conflict_types ELSE '' END AS conflict_types FROM resolved"""
)
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve_groups(_candidates(spark, d))


@query(
    f"""WITH candidates AS ({CANDIDATES_SQL}), {_MATCHES_SQL}, {_RESOLVED_SQL}
    SELECT group_id, fact_type, value AS canonical_value FROM (
      SELECT c.*, row_number() OVER (PARTITION BY c.group_id, fact_type ORDER BY confidence DESC, ord) AS r
      FROM candidates c JOIN resolved x ON x.group_id = c.group_id AND (decision = 'merged' OR primary_id = c.entity_id)) WHERE r = 1"""
)
def canonical_values(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return resolution.canonical_values(c, resolution.resolve_groups(c)).select("group_id", "fact_type", F.col("value").alias("canonical_value"))


@query(f"SELECT group_id, count(DISTINCT entity_id) AS entities, 'CRITICAL' AS severity FROM ({CANDIDATES_SQL}) GROUP BY group_id HAVING count(DISTINCT entity_id) > 1")
def single_entity_guard(spark: SparkSession, d: str) -> DataFrame:
    return resolution.several_entities(_candidates(spark, d))


@query(f"SELECT entity_id, round(sum(confidence * w) / sum(w), 6) AS score FROM (SELECT *, CASE fact_type WHEN 'iban' THEN 0.95 WHEN 'full_name' THEN 0.7 ELSE 0.5 END::DOUBLE AS w FROM ({CANDIDATES_SQL})) GROUP BY entity_id")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    return K.weighted_score(_candidates(spark, d), ["entity_id"], "fact_type").select("entity_id", F.round("score", 6).alias("score"))


@query(
    """WITH e AS (
      SELECT f.fact_id, f.field_name, f.confidence, min(v.line_no) AS first_line FROM fact_rows f LEFT JOIN evidence_rows v USING (fact_id) WHERE status = 'pending' GROUP BY ALL
    ), m AS (
      SELECT *, CASE WHEN fact_id % 3 = 0 THEN 'mrz' ELSE 'universal_regex' END AS source, fact_id % 5 <> 0 AS passed, fact_id % 7 <> 0 AS auto FROM e
    )
    SELECT fact_id, CASE
      WHEN first_line IS NOT NULL AND source = 'mrz' AND passed AND auto AND confidence >= 0.9 THEN 'accepted'
      WHEN first_line IS NOT NULL THEN 'case' ELSE 'rejected' END AS outcome,
      CASE WHEN confidence < 0.4 THEN 'HIGH' WHEN confidence < 0.6 THEN 'NORMAL' ELSE 'LOW' END AS priority FROM m""",
    "fact_rows",
    "evidence_rows",
)
def acceptance_split(spark: SparkSession, d: str) -> DataFrame:
    """Pending facts whose number tells source, check and permission of their evidence; facts without evidence carry no metadata."""
    n = record(spark, d, "evidence_rows").groupBy("fact_id").agg(F.count("*").alias("n_evidence"))
    f = record(spark, d, "fact_rows").where("status = 'pending'").join(n, "fact_id", "left").fillna(0, ["n_evidence"])
    key, known = F.col("fact_id"), F.col("n_evidence") > 0
    told = {"source": F.when(key % 3 == 0, "mrz").otherwise("universal_regex"), "mrz_check_passed": key % 5 != 0, "auto_accept": key % 7 != 0}
    return acceptance.split(f.withColumns({k: F.when(known, v) for k, v in told.items()} | {"role": F.lit(None).cast("string"), "is_person_fact": F.lit(None).cast("boolean")})).select("fact_id", "outcome", "priority")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Audit entries whose hashes hold the hash of the entry before, each subject a chain; every 97th was tampered with afterwards."""
    c = S.cases(spark, d).withColumn("own", F.sha2(F.concat_ws("|", "fact_type", F.col("case_id").cast("string")), 256))
    w = Window.partitionBy("entity_id").orderBy("created_at", "case_id")
    before = F.lag("own").over(w)
    e = c.withColumn("before", before).withColumn("entry_hash", K.entry_hash(F.col("before"), F.col("own")))
    e = e.withColumn("previous_hash", F.lag("entry_hash").over(w))
    tampered = F.when(F.col("case_id") % 97 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("entry_hash"))
    return e.select("entity_id", "case_id", "own", F.col("created_at").alias("occurred_at"), tampered.alias("entry_hash"), "previous_hash")


_CHAIN_SQL = """
    o AS (SELECT entity_id, case_id, created_at, sha256(fact_type || '|' || case_id) AS own FROM cases),
    b AS (SELECT *, lag(own) OVER w AS before FROM o WINDOW w AS (PARTITION BY entity_id ORDER BY created_at, case_id)),
    e AS (SELECT *, sha256(coalesce(before, '') || own) AS whole FROM b),
    p AS (SELECT *, lag(whole) OVER w AS previous_hash, CASE WHEN case_id % 97 = 0 THEN sha256('other') ELSE whole END AS entry_hash FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY created_at, case_id)),
    x AS (SELECT *, lag(entry_hash) OVER w AS stored FROM p WINDOW w AS (PARTITION BY entity_id ORDER BY created_at, case_id))"""


@query(f"WITH {_CHAIN_SQL} SELECT entity_id, case_id, entry_hash, previous_hash, CASE WHEN previous_hash IS DISTINCT FROM stored THEN 'link' END AS violation FROM x", "cases")
def audit_chain_links(spark: SparkSession, d: str) -> DataFrame:
    found = K.chain_violations(_entries(spark, d), ["entity_id"], F.struct("occurred_at", "case_id"))
    return found.select("entity_id", "case_id", "entry_hash", "previous_hash", "violation")


@query(f"WITH {_CHAIN_SQL} SELECT entity_id, count(*) AS n, min_by(case_id, (created_at, case_id)) FILTER (previous_hash IS DISTINCT FROM stored) AS first_bad, count(*) FILTER (previous_hash IS DISTINCT FROM stored) AS bad FROM x GROUP BY entity_id", "cases")
def audit_first_violation(spark: SparkSession, d: str) -> DataFrame:
    found = K.chain_violations(_entries(spark, d), ["entity_id"], F.struct("occurred_at", "case_id"))
    bad = F.col("violation").isNotNull()
    return found.groupBy("entity_id").agg(F.count("*").alias("n"), F.min(F.when(bad, F.struct("occurred_at", "case_id"))).getField("case_id").alias("first_bad"), F.count_if(bad).alias("bad"))


AUDIT_KEY = b"an invented key of thirty-two bytes."


@query("SELECT subject_id AS entity_id, count(*) AS n, count(*) FILTER (sequence_number % 89 <> 0) AS verified, count(*) FILTER (sequence_number % 89 = 0) AS failed FROM audit_rows GROUP BY subject_id", "audit_rows")
def audit_hmac_verification(spark: SparkSession, d: str) -> DataFrame:
    """Entries are signed, every 89th is changed afterwards; the check finds those."""
    a = record(spark, d, "audit_rows")
    payload = acceptance.canonical_json({"event_type": F.col("event_type"), "job_id": F.col("job_id").cast("string"), "previous_hash": F.lit(None).cast("string"), "subject_id": F.col("subject_id").cast("string")})
    signed = a.withColumn("signature", V.hmac_sha256(AUDIT_KEY, payload)).withColumn("event_type", F.when(F.col("sequence_number") % 89 == 0, "changed").otherwise(F.col("event_type")))
    return acceptance.verify(signed, AUDIT_KEY, payload, "subject_id").withColumnRenamed("subject_id", "entity_id")
