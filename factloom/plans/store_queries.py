"""Queries of pages and tables, evidence met by containment, imports, queues, vaults and recomputed audit chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evidence_match as E
from factloom.operators import fold as C
from factloom.operators import ocr, queues
from factloom.plans.catalog import VIEWS, query
from factloom.sources import store as _  # noqa: F401  registers its records
from factloom.sources import tables as S
from factloom.sources.records import record, sql
from factloom.sources.tables import EXTENSIONS, MAX_BYTES, spread
from factloom.streaming.imports import judged

VIEWS |= {name: sql(name) for name in ("box_rows", "match_candidates", "match_items", "file_rows", "job_events", "vault_updates")}

_CELLS_SQL = """
  r0 AS (SELECT *, CASE WHEN y > max(y + height) OVER (PARTITION BY doc_id, page ORDER BY y, y + height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opened FROM box_rows),
  r1 AS (SELECT * EXCLUDE opened, CAST(sum(opened) OVER (PARTITION BY doc_id, page ORDER BY y, y + height) AS INT) AS row FROM r0),
  c0 AS (SELECT *, CASE WHEN x > max(x + width) OVER (PARTITION BY doc_id, page ORDER BY x, x + width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opened FROM r1),
  c1 AS (SELECT *, CAST(sum(opened) OVER (PARTITION BY doc_id, page ORDER BY x, x + width) AS INT) AS col FROM c0),
  cells AS (SELECT doc_id, page, row, col, string_agg(text, ' ' ORDER BY x, y, text) AS text, ((2 * sum(CAST(round(confidence * 100000000) AS BIGINT)) + count(*) * 10000) // (2 * count(*) * 10000)) / 10000.0::DOUBLE AS confidence FROM c1 GROUP BY doc_id, page, row, col)"""


@query(f"WITH {_CELLS_SQL} SELECT * FROM cells", "box_rows")
def ocr_table_cells(spark: SparkSession, d: str) -> DataFrame:
    return ocr.table_cells(record(spark, d, "box_rows")).select("doc_id", "page", "row", "col", "text", "confidence")


@query(
    f"""WITH {_CELLS_SQL}, rows AS (SELECT doc_id, page, row, count(*) AS n, ((2 * sum(CAST(round(confidence * 100000000) AS BIGINT)) + count(*) * 10000) // (2 * count(*) * 10000)) / 10000.0::DOUBLE AS c FROM cells GROUP BY ALL), t AS (SELECT doc_id, page, count(*) AS n_rows, max(n) AS n_columns, CAST(sum(n) AS BIGINT) AS n_cells, ((2 * sum(CAST(round(c * 100000000) AS BIGINT)) + count(*) * 10000) // (2 * count(*) * 10000)) / 10000.0::DOUBLE AS mean_confidence FROM rows GROUP BY doc_id, page)
    SELECT *, mean_confidence >= 0.8 AS sure, mean_confidence < 0.5 AS poor FROM t""",
    "box_rows",
)
def ocr_table_stats(spark: SparkSession, d: str) -> DataFrame:
    return ocr.table_stats(ocr.table_cells(record(spark, d, "box_rows")))


@query(f"WITH {_CELLS_SQL}, w AS (SELECT DISTINCT doc_id, page, line % 3 AS row, word AS col FROM box_rows) SELECT doc_id, page, row, col, text FROM w LEFT JOIN cells USING (doc_id, page, row, col)", "box_rows")
def ocr_cell_lookup(spark: SparkSession, d: str) -> DataFrame:
    boxes = record(spark, d, "box_rows")
    wanted = boxes.select("doc_id", "page", (F.col("line") % 3).alias("row"), F.col("word").alias("col")).distinct()
    return ocr.cell_at(ocr.table_cells(boxes), wanted)


def _pages(boxes: DataFrame) -> DataFrame:
    """Pages of nested blocks, lines and words; every third document's words are cells of its pages' tables as well."""
    word = F.struct(F.concat_ws(".", "line", "word").alias("word_id"), "text", "confidence")
    lines = boxes.groupBy("doc_id", "page", "block", "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", word.alias("w")))), lambda s: s["w"]).alias("words"))
    blocks = lines.groupBy("doc_id", "page", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "words"))), lambda s: F.struct(s["line"].cast("string").alias("line_id"), s["words"].alias("words"))).alias("lines"))
    block = F.struct(F.col("block").cast("string").alias("block_id"), F.lit(0.5).alias("confidence"), "lines")
    pages = blocks.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(block)).cast(ocr.PAGE).alias("blocks"))
    cell = F.struct(F.lit("t").alias("table_id"), F.col("line").alias("row"), F.col("word").alias("col"), "text", "confidence")
    cells = boxes.where("doc_id % 3 = 0").groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "word", cell.alias("c")))), lambda s: s["c"]).cast(ocr.CELLS).alias("cells"))
    return pages.join(cells, ["doc_id", "page"], "left")


@query(
    """WITH w AS (SELECT doc_id, page, block, line, word, trim(text) AS text, confidence FROM box_rows),
    l AS (SELECT doc_id, page, block, line, trim(string_agg(raw, ' ' ORDER BY word, raw, confidence)) AS text, ((2 * sum(CAST(round(confidence * 100000000) AS BIGINT)) + count(*) * 10000) // (2 * count(*) * 10000)) / 10000.0::DOUBLE AS confidence FROM (SELECT *, text AS raw FROM box_rows) GROUP BY ALL),
    lt AS (SELECT doc_id, page, block, line, string_agg(text, ' ' ORDER BY word, text, confidence) AS text FROM box_rows GROUP BY ALL),
    b AS (SELECT t.doc_id, t.page, t.block, trim(string_agg(t.text, chr(10) ORDER BY t.line)) AS text, any_value(c.confidence) AS confidence FROM lt t JOIN (SELECT doc_id, page, block, ((2 * sum(CAST(round(confidence * 100000000) AS BIGINT)) + count(*) * 10000) // (2 * count(*) * 10000)) / 10000.0::DOUBLE AS confidence FROM box_rows GROUP BY ALL) c USING (doc_id, page, block) GROUP BY ALL),
    bk AS (SELECT * FROM b WHERE trim(replace(text, chr(10), ' ')) <> ''),
    s AS (
      SELECT doc_id, page, 0 AS o, block AS b, -1 AS l, -1 AS w, 'block' AS kind, text, confidence FROM bk
      UNION ALL SELECT l.doc_id, l.page, 0, l.block, l.line, -1, 'line', l.text, l.confidence FROM l SEMI JOIN bk USING (doc_id, page, block) WHERE l.text <> ''
      UNION ALL SELECT w.doc_id, w.page, 0, w.block, w.line, w.word, 'word', w.text, w.confidence FROM w JOIN l USING (doc_id, page, block, line) SEMI JOIN bk USING (doc_id, page, block) WHERE w.text <> '' AND l.text <> ''
      UNION ALL SELECT doc_id, page, 1, 0, line, word, 'table_cell', text, confidence FROM w WHERE doc_id % 3 = 0 AND text <> ''
    ) SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY o, b, l, w, text, confidence) - 1 AS INT) AS n, kind, text, confidence FROM s""",
    "box_rows",
)
def page_spans(spark: SparkSession, d: str) -> DataFrame:
    return ocr.flatten_pages(_pages(record(spark, d, "box_rows"))).select("doc_id", "page", "n", "kind", "text", "confidence")


_MATCH = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'), ' :;,.|')"


@query(
    f"""WITH i AS (SELECT doc_id, item_id, unnest([{_MATCH.format('a')}, {_MATCH.format('b')}]) AS s FROM match_items), c AS (SELECT doc_id, candidate_id, has_spans, unnest([{_MATCH.format('a')}, {_MATCH.format('b')}]) AS c FROM match_candidates),
    m AS (SELECT i.doc_id, item_id, min(candidate_id) AS found FROM i JOIN c ON i.doc_id = c.doc_id AND s <> '' AND c <> '' AND (s = c OR (len(s) >= 4 AND contains(c, s)) OR (len(c) >= 4 AND contains(s, c))) GROUP BY ALL),
    f AS (SELECT doc_id, min(candidate_id) AS fallback FROM match_candidates WHERE has_spans GROUP BY doc_id)
    SELECT doc_id, item_id, coalesce(found, fallback) AS candidate_id, CASE WHEN found IS NOT NULL THEN 'match' WHEN fallback IS NOT NULL THEN 'fallback' END AS how FROM match_items LEFT JOIN m USING (doc_id, item_id) LEFT JOIN f USING (doc_id)""",
    "match_items", "match_candidates",
)
def evidence_matches(spark: SparkSession, d: str) -> DataFrame:
    items, known = record(spark, d, "match_items"), record(spark, d, "match_candidates")
    return E.match_evidence(items.withColumn("texts", F.array("a", "b")), known.withColumns({"texts": F.array("a", "b"), "ord": F.col("candidate_id")}))


_FEEDS = r"trim(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_PRIORITY = "|".join(E.PRIORITY)


@query(
    rf"""WITH t AS (SELECT doc_id, {_FEEDS.format("regexp_replace(replace(coalesce(text, ''), chr(0), ' '), '[ \t]+', ' ', 'g')")} AS t FROM documents),
    k AS (SELECT *, list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r]'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '' AND regexp_matches(x, '(?i){_PRIORITY}')) AS kept FROM t),
    j AS (SELECT *, array_to_string(list_filter([t[1:1500], array_to_string(kept[1:80], chr(10)), right(t, 1800)], lambda p: NOT regexp_full_match(p, '\s*')), chr(10)) AS joined FROM k)
    SELECT doc_id, len(out) AS n_chars, sha256(out) AS text_sha256 FROM (SELECT doc_id, CASE WHEN len(t) <= 4500 THEN t ELSE {_FEEDS.format('joined')}[1:5200] END AS out FROM j)"""
)
def compact_texts(spark: SparkSession, d: str) -> DataFrame:
    short = spread(S.read(spark, d, "documents")).select("doc_id", E.compact_text(F.col("text")).alias("t"))
    return short.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


_TYPES = ", ".join(f"'{e}'" for e in EXTENSIONS)


@query(
    rf"""WITH k AS (SELECT *, sha256(file_hash || '|' || entity_id)[1:32] AS document_id, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS extension FROM file_rows), s AS (SELECT DISTINCT document_id FROM k WHERE is_stored),
    c AS (SELECT k.*, CASE WHEN regexp_extract(path, '[^/]+$', 0) = '' THEN 'no_name' WHEN extension NOT IN ({_TYPES}) THEN 'extension' WHEN length = 0 THEN 'empty' WHEN length > {MAX_BYTES} THEN 'too_large' END AS bad FROM k WHERE NOT is_stored)
    SELECT path, document_id, coalesce(bad, CASE WHEN document_id IN (FROM s) THEN 'stored' WHEN row_number() OVER (PARTITION BY document_id, bad IS NULL ORDER BY path) > 1 THEN 'twice' END) AS reason FROM c""",
    "file_rows",
)
def import_decisions(spark: SparkSession, d: str) -> DataFrame:
    files = record(spark, d, "file_rows")
    stored = files.where("is_stored").select(F.substring(F.sha2(F.concat_ws("|", "file_hash", F.col("entity_id").cast("string")), 256), 1, 32).alias("document_id"))
    return judged(files.where("not is_stored"), stored).select("path", "document_id", "reason")


def _audit(spark: SparkSession, d: str, changed: bool) -> DataFrame:
    """Entries with the hash of their payload; with ``changed``, of what payloads are after every 499th was tampered with."""
    payload = C.compact_json({"type": F.col("fact_type"), "case": F.col("case_id"), "note": F.concat(F.lit("Prüfung \""), F.when((F.col("case_id") % 499 == 0) & F.lit(changed), "other").otherwise("same"), F.lit("\""))})
    return S.cases(spark, d).select("entity_id", "created_at", "case_id", F.sha2(payload, 256).alias("own"))


_AUDIT_SQL = r"""SELECT entity_id, case_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, case_id) AS n,
    sha256('{"case":' || case_id || ',"note":"Prüfung \"same\"","type":"' || fact_type || '"}') AS own FROM cases""".replace(r"Prüfung \"same\"", "Pr\\u00fcfung \\\"same\\\"")


@query(
    f"""SELECT * FROM (WITH RECURSIVE e AS ({_AUDIT_SQL}), r AS (
      SELECT entity_id, case_id, n, NULL::VARCHAR AS previous_hash, sha256(own) AS entry_hash FROM e WHERE n = 1
      UNION ALL SELECT e.entity_id, e.case_id, e.n, r.entry_hash, sha256(r.entry_hash || e.own) FROM r JOIN e ON e.entity_id = r.entity_id AND e.n = r.n + 1
    ) SELECT entity_id, case_id, previous_hash, entry_hash FROM r)""",
    "cases",
)
def audit_hash_chain(spark: SparkSession, d: str) -> DataFrame:
    return C.hash_chain(_audit(spark, d, False), "entity_id", ["created_at", "case_id"], "own").select("entity_id", "case_id", "previous_hash", "entry_hash")


@query(
    f"""WITH e AS ({_AUDIT_SQL}), b AS (SELECT entity_id, min(n) AS n FROM e WHERE case_id % 499 = 0 GROUP BY entity_id)
    SELECT e.entity_id, count(*) AS n, count(*) FILTER (e.n >= b.n) AS n_bad, min(e.case_id) FILTER (e.n = b.n) AS first_bad FROM e LEFT JOIN b USING (entity_id) GROUP BY e.entity_id""",
    "cases",
)
def audit_broken_chains(spark: SparkSession, d: str) -> DataFrame:
    stored = C.hash_chain(_audit(spark, d, False), "entity_id", ["created_at", "case_id"], "own").select("entity_id", "case_id", F.col("entry_hash").alias("stored"))
    now = _audit(spark, d, True).join(stored, ["entity_id", "case_id"])
    return C.broken_chains(now, "entity_id", ["created_at", "case_id"], "own", "stored")


_JOBS_SQL = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY moment, event_id) AS n FROM job_events), s AS (
    SELECT DISTINCT job_id, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::BIGINT AS available_at, NULL::BIGINT AS leased_at, NULL::INT AS retries, 0::BIGINT AS n_applied FROM e
    UNION ALL
    SELECT job_id, n, CASE WHEN NOT ok THEN status ELSE CASE action WHEN 'enqueue' THEN 'pending' WHEN 'lease' THEN 'leased' WHEN 'complete' THEN 'completed' WHEN 'cancel' THEN 'cancelled' WHEN 'requeue' THEN 'retrying' ELSE 'pending' END END,
      CASE WHEN ok AND action IN ('enqueue', 'expire') THEN moment WHEN ok AND action = 'requeue' THEN moment + delay ELSE available_at END, CASE WHEN ok AND action = 'lease' THEN moment ELSE leased_at END,
      CASE WHEN ok AND action = 'enqueue' THEN 0 WHEN ok AND action = 'requeue' THEN retries + 1 ELSE retries END, n_applied + ok::INT
    FROM (SELECT s.*  EXCLUDE n, e.n, e.action, e.moment, e.delay, coalesce(CASE e.action WHEN 'enqueue' THEN s.status IS NULL WHEN 'lease' THEN s.status IN ('pending', 'retrying') AND s.available_at <= e.moment WHEN 'complete' THEN s.status = 'leased'
      WHEN 'expire' THEN s.status = 'leased' AND s.leased_at + e.delay <= e.moment ELSE s.status IS NOT NULL END, false) AS ok FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1)
  )"""


@query(f"SELECT * FROM ({_JOBS_SQL} SELECT job_id, status, available_at, retries, n_applied FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1)", "job_events")
def queue_job_states(spark: SparkSession, d: str) -> DataFrame:
    return queues.jobs_now(queues.job_history(record(spark, d, "job_events")))


@query(f"SELECT * FROM ({_JOBS_SQL} SELECT job_id, status, available_at FROM s WHERE status IN ('pending', 'retrying') AND available_at <= 40000 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1 AND n = (SELECT max(n) FROM e x WHERE x.job_id = s.job_id)) ORDER BY job_id % 4 DESC, job_id LIMIT 25".replace("QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1 AND n =", "AND n ="), "job_events")
def queue_next_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The 25 jobs that would be leased next, urgency being the number modulo 4."""
    jobs = queues.jobs_now(queues.job_history(record(spark, d, "job_events")))
    return queues.ready(jobs.withColumns({"priority": F.col("job_id") % 4, "created_at": F.col("job_id")}), 40000, 25).select("job_id", "status", "available_at")


_VAULT_SQL = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY vault_id, entity_id ORDER BY seq) AS n FROM vault_updates), s AS (
    SELECT DISTINCT vault_id, entity_id, 0::BIGINT AS n, 0::BIGINT AS seq, NULL::BOOLEAN AS accepted, NULL::VARCHAR AS reason, false AS has_entity, NULL::VARCHAR AS profile, ['', '', ''] AS c FROM e
    UNION ALL
    SELECT vault_id, entity_id, n, seq, reason IS NULL, reason, CASE WHEN reason IS NULL AND op = 'add_entity' THEN true WHEN reason IS NULL AND op = 'remove_entity' THEN false ELSE has_entity END,
      CASE WHEN reason IS NULL AND op = 'update_profile' THEN value WHEN reason IS NULL AND op = 'remove_profile' THEN NULL ELSE profile END,
      CASE WHEN reason IS NULL AND op LIKE '%conflict' THEN list_transform([1, 2, 3], lambda k: CASE WHEN k = slot THEN CASE op WHEN 'register_conflict' THEN 'open' WHEN 'resolve_conflict' THEN 'resolved' ELSE 'dismissed' END ELSE c[k] END) ELSE c END
    FROM (SELECT *, CASE WHEN op = 'add_entity' THEN CASE WHEN has_entity THEN 'exists' END WHEN NOT has_entity THEN 'no_entity' WHEN op = 'remove_entity' THEN CASE WHEN profile IS NOT NULL THEN 'has_profile' WHEN c <> ['', '', ''] THEN 'has_conflicts' END
        WHEN op = 'remove_profile' THEN CASE WHEN profile IS NULL THEN 'no_profile' END WHEN op = 'register_conflict' THEN CASE WHEN c[slot] <> '' THEN 'registered' END
        WHEN op IN ('resolve_conflict', 'dismiss_conflict') THEN CASE WHEN c[slot] = '' THEN 'no_conflict' WHEN c[slot] <> 'open' THEN 'not_open' END WHEN op <> 'update_profile' THEN 'unknown' END AS reason
      FROM (SELECT s.vault_id, s.entity_id, e.n, e.seq, e.op, e.value, CAST(e.conflict_id[2:] AS INT) + 1 AS slot, s.has_entity, s.profile, s.c FROM s JOIN e ON e.vault_id = s.vault_id AND e.entity_id = s.entity_id AND e.n = s.n + 1))
  )"""
_HELD = "CAST(len(list_filter(c, lambda x: x <> '')) AS INT) AS n_conflicts, CAST(len(list_filter(c, lambda x: x = 'open')) AS INT) AS n_open"


@query(f"SELECT * FROM ({_VAULT_SQL} SELECT vault_id, entity_id, seq, accepted, reason, has_entity, profile, {_HELD} FROM s WHERE n > 0)", "vault_updates")
def vault_update_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return queues.vault_history(record(spark, d, "vault_updates")).drop("op", "conflict_id", "value")


@query(f"SELECT * FROM ({_VAULT_SQL} SELECT vault_id, entity_id, profile, {_HELD}, seq AS version FROM (SELECT * FROM s WHERE accepted AND seq <= 5000 QUALIFY row_number() OVER (PARTITION BY vault_id, entity_id ORDER BY seq DESC) = 1) WHERE has_entity)", "vault_updates")
def vault_at_version(spark: SparkSession, d: str) -> DataFrame:
    """The vault as it was after update 5000; later versions stay readable beside it."""
    return queues.vault_at(queues.vault_history(record(spark, d, "vault_updates")), 5000)
