"""Further record tables of the model, as views over the driver's tables.

Each is one SELECT in the part of SQL that Spark and DuckDB share, so that a query and its check
read the same rows. ``{orders}`` stands for the table orders, and so on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.tables import dealt, read

#: Field names that the invented profiles use, by number.
PROFILE_NAMES = ("given_names", "surname", "date_of_birth", "place_of_birth", "nationality", "address", "new_address", "passport_number", "email", "tax_id", "employer", "job_title", "valid_until", "iban", "hobby", "bank_name")


def case(number: str, values: tuple[str, ...]) -> str:
    """The value for each number from 0."""
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


RECORDS = {
    "entity_rows": """
        SELECT c_custkey AS entity_id, c_name AS display_name, CASE WHEN c_custkey % 3 = 0 THEN 'organization' ELSE 'person' END AS entity_type,
          CASE WHEN c_custkey % 7 = 0 THEN 'archived' ELSE 'active' END AS status, c_custkey * 37 % 1000 AS created_at
        FROM {customer}""",
    "document_rows": """
        SELECT o_orderkey AS document_id, o_custkey AS entity_id, o_orderkey % 997 AS file_hash, o_orderdate AS created_at,
          CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderkey % 5 = 1 THEN 'failed' WHEN o_orderkey % 5 = 2 THEN 'processing' ELSE 'processed' END AS status,
          concat('in/', CAST(o_custkey AS STRING), '/doc_', CAST(o_orderkey AS STRING), '.pdf') AS file_path,
          CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 120 - 60 END AS expires_in
        FROM {orders}""",
    "source_rows": "SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS document_id, o_custkey AS entity_id FROM {orders}",
    "evidence_rows": """
        SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey AS fact_id, l_orderkey AS source_id, l_linenumber AS line_no,
          l_shipdate AS created_at, l_discount AS confidence
        FROM {lineitem}""",
    "fact_rows": f"""
        SELECT o_orderkey AS fact_id, o_custkey AS entity_id, {case('o_orderkey % 16', PROFILE_NAMES)} AS field_name,
          concat('v', CAST(o_orderkey % 23 AS STRING)) AS value, CAST(o_orderkey * 37 % 101 AS DOUBLE) / 100 AS confidence,
          CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status, o_orderdate AS created_at
        FROM {{orders}}""",
    "provenance_rows": """
        SELECT l_orderkey * 10 + l_linenumber AS provenance_id, l_orderkey AS fact_id, l_shipdate AS created_at,
          concat('ocr>extraction', CASE WHEN l_returnflag = 'R' THEN '>gate' ELSE '' END, '>build') AS decision_chain
        FROM {lineitem}""",
    "conflict_rows": """
        SELECT p_partkey AS conflict_id, p_partkey % 150 + 1 AS entity_id, p_partkey * 3 AS fact_a, p_partkey * 3 + p_size % 4 AS fact_b,
          CASE WHEN p_size % 3 = 0 THEN 'open' WHEN p_size % 3 = 1 THEN 'resolved' ELSE 'dismissed' END AS status
        FROM {part}""",
    "case_rows": f"""
        SELECT event_id AS case_id, user_id AS entity_id, {case('event_id % 16', PROFILE_NAMES)} AS fact_type, concat('Raw ', event_type, ' ', CAST(event_id % 50 AS STRING)) AS raw_value,
          concat('v', CAST(event_id % 23 AS STRING)) AS normalized_value, CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS confidence,
          {case('event_id % 7', ('PENDING', 'ASSIGNED', 'IN_REVIEW', 'COMPLETED', 'CANCELLED', 'ACCEPTED', 'REJECTED'))} AS status, ts AS created_at, event_id % 1500 * 10 + 1 AS evidence_id
        FROM {{events}}""",
    "decision_rows": f"""
        SELECT event_id AS decision_id, event_id % 997 AS case_id, {case('event_id % 4', ('accept', 'reject', 'edit', 'escalate'))} AS outcome,
          CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN '  ' ELSE concat('edited ', CAST(event_id % 40 AS STRING)) END AS edited_value, ts AS decided_at
        FROM {{events}}""",
    "output_rows": f"""
        SELECT o_orderkey AS output_id, o_custkey AS subject_id, {case('o_orderkey % 3', ('profile_report', 'fact_export', 'knowledge_report'))} AS output_type,
          CASE WHEN o_orderkey % 2 = 0 THEN 'json' ELSE 'pdf' END AS format, o_orderdate AS created_at, concat('body ', CAST(o_orderkey AS STRING)) AS content
        FROM {{orders}}""",
    "profile_rows": f"""
        SELECT entity_id, field_name, CASE WHEN field_id % 11 = 0 THEN ' ' WHEN field_name = 'valid_until' THEN concat(CAST(1995 + field_id % 6 AS STRING), '-0', CAST(1 + field_id % 9 AS STRING), '-15')
          WHEN field_name = 'date_of_birth' THEN concat(CAST(1940 + field_id % 60 AS STRING), '-0', CAST(1 + field_id % 9 AS STRING), '-15') ELSE concat('v', CAST(field_id % 23 AS STRING)) END AS value
        FROM (SELECT o_custkey AS entity_id, {case('o_orderkey % 16', PROFILE_NAMES)} AS field_name, max(o_orderkey) AS field_id FROM {{orders}} WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2) p""",
    "noise_rows": f"""
        SELECT event_id AS noise_id, user_id AS entity_id, {case('event_id % 3', ('ocr', 'extraction', 'llm'))} AS stage, concat('text ', CAST(event_id % 77 AS STRING)) AS raw_text,
          {case('event_id % 5', ('open', 'processing', 'failed', 'promoted', 'dismissed'))} AS status, ts AS created_at
        FROM {{events}}""",
    "form_rows": """
        SELECT p_partkey AS field_id, p_partkey % 40 AS template_id,
          CASE p_partkey % 6 WHEN 0 THEN 'form.p0.x22.y85' WHEN 1 THEN concat('SYSTEM_', CAST(p_partkey AS STRING)) WHEN 2 THEN concat('form.p', CAST(p_size % 3 AS STRING), '.x', CAST(p_size AS STRING), '.y', CAST(p_size * 2 AS STRING))
            WHEN 3 THEN concat('neue_adresse-', CAST(p_size AS STRING)) WHEN 4 THEN 'form.p1.x22.y148' ELSE concat('e-mail.', CAST(p_size AS STRING)) END AS field_name,
          CASE p_partkey % 5 WHEN 0 THEN 'Familienname' WHEN 1 THEN 'Neue Adresse' WHEN 2 THEN 'Geburtsdatum' WHEN 3 THEN 'Telefon privat' ELSE p_brand END AS label,
          CASE WHEN p_partkey % 4 = 0 THEN 'checkbox' ELSE 'text' END AS field_type, CASE WHEN p_partkey % 8 = 3 THEN 'address' ELSE '' END AS profile_field_name,
          CAST(p_size AS DOUBLE) / 50 AS confidence, p_size % 3 + 1 AS page, CAST(p_size * 7 % 50 AS DOUBLE) AS x, CAST(p_size * 3 % 40 AS DOUBLE) AS y, p_size % 2 = 0 AS required
        FROM {part}""",
    "job_rows": f"""
        SELECT event_id AS job_id, {case('event_id % 5', ('pending', 'running', 'retrying', 'completed', 'failed'))} AS status, CASE WHEN event_id % 4 = 0 THEN 'high' ELSE CAST(event_id % 30 AS STRING) END AS priority,
          event_id % 5 AS retry_count, 3 AS max_retries, ts AS created_at
        FROM {{events}}""",
    "audit_rows": f"""
        SELECT event_id AS sequence_number, user_id AS subject_id, event_id % 333 AS job_id, {case('event_id % 3', ('fact_accepted', 'document_added', 'case_closed'))} AS event_type, ts AS occurred_at
        FROM {{events}}""",
    "relationship_rows": "SELECT c_custkey AS source_id, c_custkey % 149 + 1 AS target_id, CASE WHEN c_nationkey % 2 = 0 THEN 'employer' ELSE 'bank' END AS relation_type FROM {customer}",
}
#: Invented questions to the assistant, by number.
QUESTIONS = ("Who are you?", "How  old are you??", "Hello there!", "please check the noise data", "I am Kim and can you save this info", "save this info", "tell me about myself", "Is my PROFILE complete?", "What should I accept?", "hi", "how do I file taxes", "What is my age and your age", "My name is Kim Muster, 34 years old", "i am 200 years old")
RECORDS["question_rows"] = f"SELECT event_id AS question_id, {case('event_id % 14', QUESTIONS)} AS text FROM {{events}} UNION ALL SELECT -(conv_id * 1000 + turn) - 1 AS question_id, text FROM {{conversations}}"

#: Lines of invented documents by kind; {n} is the order's number, {date} a date made from it, {digits} ten digits.
LABELLED = (
    ("Rechnung", "Rechnungsnummer: RE-{n}", "Rechnungsdatum: {date}", "Kundennummer: K{n}", "Gesamtbetrag: 1.2{two},50 EUR", "E-Mail: kunde{n}@example.org"),
    ("Kontoauszug", "Kontoinhaber: Max Muster", "IBAN: DE21{digits}12345678", "BIC: COBADEFF", "Alter Kontostand: 1.0{two},10 EUR", "account number and balance"),
    ("Gehaltsabrechnung", "Arbeitgeber: Muster Werke", "Arbeitnehmer: Erika Beispiel", "Brutto: 3.2{two},00 EUR", "Netto", "2.1{two},00 EUR", "Steuer ID: {digits}"),
    ("Arbeitsvertrag", "Employer: Beispiel Labor", "Employee: Kim Muster", "working hours 38, salary 4.0{two},00 EUR", "Telefon +49 30 {digits}"),
    ("Reisepass", "Surname: Mustermann", "Given names: Erika", "Passport No: C{digits}", "Date of birth: {date}", "Nationality: Italien", "Sex: F", "P<D<<MUSTERMANN<<ERIKA<<<<<<<<<<<<<<<<<<<<<", "Issuing authority: Stadt Beispiel"),
    ("Personalausweis", "Größe", "17{one} cm", "Augenfarbe: blau", "Anschrift: Am Beispielweg", "Geburtsort: Musterstadt", "gsnummer", "A{digits}"),
    ("Aufenthaltstitel", "Gültig bis: {date}", "Ausstellende Behörde: Stadt Muster", "permit, see https://example.org/{n}", "Familienname  Beispiel"),
    ("Versicherung", "insurance policy {n}", "insured since {date}", "coverage: full", "Name Vorname Geburtsdatum", "call 030/{digits}"),
)


def _labelled() -> str:
    day, month, year = "lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0')", "lpad(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0')", "CAST(1950 + o_orderkey % 60 AS STRING)"
    parts = {"n": "CAST(o_orderkey AS STRING)", "date": f"{day}, '.', {month}, '.', {year}", "digits": "lpad(CAST(o_orderkey * 7919 % 1000000007 AS STRING), 10, '1')", "one": "CAST(o_orderkey % 10 AS STRING)", "two": "lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')"}
    kinds = []
    for lines in LABELLED:
        out = []
        for i, line in enumerate(lines):
            for piece in re.split(r"(\{\w+\})", line):
                out.append(parts[piece[1:-1]] if piece.startswith("{") else "'" + piece.replace("'", "''") + "'")
            if i < len(lines) - 1:
                out.append("chr(10)")
        kinds.append(f"concat({', '.join(x for x in out if x != chr(39) * 2)})")
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END"


RECORDS["labelled_texts"] = f"SELECT o_orderkey AS doc_id, {_labelled()} AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 1 THEN 'invoice' ELSE 'letter' END AS given_kind FROM {{orders}}"
RECORDS["texts"] = f"SELECT doc_id, text FROM {{documents}} UNION ALL SELECT -o_orderkey - 1 AS doc_id, {_labelled()} AS text FROM {{orders}}"


def sql(name: str) -> str:
    """The view's SELECT over tables by their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", RECORDS[name])


#: Records whose rows become texts or are decided by many patterns: the tables that they are made from are dealt out before.
DEALT = ("labelled_texts", "texts", "zone_texts", "passport_texts", "card_texts", "candidate_rows", "box_rows")
#: Of these, what meets by a key of its table afterwards, in a join with itself or in groups: dealt out by it, so that the longer rows made from it aren't moved.
MET_BY = {"passport_texts": "o_orderkey", "box_rows": "l_orderkey"}


def record(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def table(t: str) -> DataFrame:
        columns = sorted(set(re.findall(rf"\b{t[0]}_\w+", RECORDS[name])))
        return dealt(read(spark, sf_dir, t), *columns, key=MET_BY.get(name)) if name in DEALT and t in ("orders", "lineitem") else read(spark, sf_dir, t)

    return spark.sql(RECORDS[name], **{t: table(t) for t in set(re.findall(r"\{(\w+)\}", RECORDS[name]))})
