"""Invented boxes, files, evidence, jobs and vault updates over line items, orders and events."""

from __future__ import annotations

from factloom.sources.records import RECORDS, case

_COLUMNS = "(SELECT 0 AS c UNION ALL SELECT 1 AS c UNION ALL SELECT 2 AS c UNION ALL SELECT 3 AS c) k"
RECORDS["box_rows"] = f"""
    SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 + 1 AS INT) AS page, CAST(l_linenumber AS INT) AS line, c AS word, l_suppkey % 2 AS block, CAST(c * 60 + l_partkey % 20 AS DOUBLE) AS x, CAST(l_linenumber * 9 + c AS DOUBLE) AS y,
      CAST(20 + l_suppkey % 30 AS DOUBLE) AS width, CAST(12 + l_partkey % 5 AS DOUBLE) AS height, CASE WHEN (l_partkey + c) % 11 = 0 THEN ' ' ELSE concat('t', CAST(l_partkey % 100 AS STRING), '.', CAST(c AS STRING)) END AS text,
      CAST((l_partkey * 7 + c * 13) % 101 AS DOUBLE) / 100 AS confidence
    FROM {{lineitem}} CROSS JOIN {_COLUMNS} WHERE (l_partkey + c) % 7 <> 0"""
RECORDS["match_candidates"] = """
    SELECT l_orderkey % 400 AS doc_id, l_orderkey * 10 + l_linenumber AS candidate_id, concat('Value ', CAST(l_partkey % 50 AS STRING), ' of ', CAST(l_suppkey % 10 AS STRING)) AS a, l_linenumber % 3 = 0 AS has_spans,
      CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN concat('x', CAST(l_partkey % 30 AS STRING)) ELSE concat('ref-', CAST(l_partkey AS STRING)) END AS b
    FROM {lineitem} WHERE l_linenumber % 2 = 1"""
RECORDS["match_items"] = """
    SELECT l_orderkey % 400 AS doc_id, l_orderkey * 10 + l_linenumber AS item_id,
      CASE l_partkey % 6 WHEN 0 THEN concat('the  VALUE ', CAST(l_partkey % 50 AS STRING), ' OF ', CAST(l_suppkey % 10 AS STRING), ' .') WHEN 1 THEN 'ABC' WHEN 2 THEN concat(' x', CAST(l_partkey % 30 AS STRING), ',') WHEN 3 THEN 'ref-1' WHEN 4 THEN concat('value ', CAST(l_partkey % 50 AS STRING)) ELSE 'zz top' END AS a,
      CASE WHEN l_partkey % 5 = 0 THEN 'see ref-77 and more' ELSE '' END AS b
    FROM {lineitem} WHERE l_linenumber % 2 = 0"""
RECORDS["file_rows"] = f"""
    SELECT concat('in/', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 23 = 0 THEN '/' ELSE concat('/doc_', CAST(o_orderkey AS STRING), {case('o_orderkey % 9', ('.pdf', '.PNG', '.exe', '', '.docx', '.tar.gz', '.jpeg', '.Xml', '.csv'))}) END) AS path,
      CASE o_orderkey % 11 WHEN 0 THEN 0 WHEN 1 THEN 60000000 ELSE o_orderkey * 10 END AS length, concat('h', CAST(o_orderkey % 97 AS STRING)) AS file_hash, o_custkey % 5 AS entity_id, o_orderkey % 13 = 0 AS is_stored
    FROM {{orders}}"""
RECORDS["job_events"] = f"""
    SELECT event_id % 701 AS job_id, event_id * 3 AS moment, event_id, {case('event_id / 701 % 7 + event_id % 3 * 7 - event_id % 3 * 7', ('enqueue', 'lease', 'requeue', 'lease', 'complete', 'expire', 'cancel'))} AS action, event_id * 7 % 5000 AS delay
    FROM {{events}}""".replace("event_id / 701 % 7 + event_id % 3 * 7 - event_id % 3 * 7", "(event_id * 13 + CAST(floor(event_id / 701) AS BIGINT)) % 7")
RECORDS["vault_updates"] = f"""
    SELECT 1 AS vault_id, user_id AS entity_id, event_id AS seq, {case('event_id * 17 % 11', ('add_entity', 'update_profile', 'register_conflict', 'resolve_conflict', 'dismiss_conflict', 'remove_profile', 'remove_entity', 'register_conflict', 'update_profile', 'remove_entity', 'other'))} AS op,
      concat('c', CAST(event_id % 3 AS STRING)) AS conflict_id, concat('p', CAST(event_id % 9 AS STRING)) AS value
    FROM {{events}}"""
