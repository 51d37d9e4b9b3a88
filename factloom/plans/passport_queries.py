"""Queries of machine-readable zones, passports and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import labelled, mrz, passport
from factloom.plans.catalog import VIEWS, query
from factloom.sources import passports as _  # noqa: F401  registers zone_texts and passport_texts
from factloom.sources.records import record, sql
from factloom.sources.tables import spread

VIEWS |= {name: sql(name) for name in ("zone_texts", "passport_texts", "card_texts")}
#: Today, for the queries.
AS_OF = "2010-01-01"


def _digit(e: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, len({e}) + 1), lambda i: (CASE WHEN {e}[i] BETWEEN '0' AND '9' THEN ascii({e}[i]) - 48 WHEN {e}[i] BETWEEN 'A' AND 'Z' THEN ascii({e}[i]) - 55 ELSE 0 END) * [7, 3, 1][(i - 1) % 3 + 1])) % 10 AS VARCHAR)"


def _cut(place: tuple[int, int, int]) -> str:
    line, a, b = place
    return f"ls[{line + 1}][{a + 1}:{b}]"


def _kind_sql(kind: str) -> str:
    """Cuts of one kind of zone, with whether each check digit is right."""
    width, at = mrz.KINDS[kind][1], {"document_code": (0, 0, 2), "issuing_country": (0, 2, 5), **mrz.FIELDS[kind]}
    fields = ", ".join(f"{_cut(at[k]) if k in at else 'NULL'} AS {k}" for k in ("document_code", "issuing_country", "names", "document_number", "nationality", "date_of_birth", "sex", "expiry_date", "personal_number"))
    checks = ", ".join(f"[{' || '.join(map(_cut, parts))}, {_cut((line, i, i + 1))}]" for _, parts, (line, i) in mrz.CHECKS[kind])
    padded = f"list_transform(found, lambda x: rpad(x[1:{width}], {width}, '<'))"
    return f"SELECT doc_id, kind, {fields}, [{checks}] AS checks FROM (SELECT *, {padded} AS ls FROM kinds WHERE kind = '{kind}')"


def _found_sql(text: str) -> str:
    clean = rf"list_transform(string_split_regex({text}, '\r\n|[\n\r]'), lambda x: regexp_replace(upper(regexp_replace(x, '\s+', '', 'g')), '[.,;]', '', 'g'))"
    return rf"""SELECT *, CASE WHEN len(strict) >= 2 THEN strict WHEN len(strict) + len(relaxed) >= 2 THEN strict || relaxed ELSE [] END AS found FROM (
      SELECT *, list_filter(cl, lambda x: regexp_full_match(x, '[A-Z0-9<]{{15,44}}')) AS strict,
        list_filter(cl, lambda x: NOT regexp_full_match(x, '[A-Z0-9<]{{15,44}}') AND len(x) >= 25 AND regexp_matches(x, '[A-Z0-9]{{3,}}') AND len(regexp_replace(x, '[^<]', '', 'g')) * 20 >= len(x)) AS relaxed FROM (SELECT *, {clean} AS cl FROM source))"""


_CODES = ", ".join(f"'{c}'" for c in mrz.CODES)
_KIND = f"""CASE WHEN translate(found[1][1:2], '01', 'OI') IN ({_CODES}) OR translate(found[1][1:1], '01', 'OI') IN ({_CODES}) THEN
    CASE WHEN len(found) = 3 AND list_min(list_transform(found, lambda x: len(x))) >= 22 THEN 'TD1' WHEN len(found) = 2 AND list_min(list_transform(found, lambda x: len(x))) >= 33 AND list_max(list_transform(found, lambda x: len(x))) >= 40 THEN 'TD3'
      WHEN len(found) = 2 AND list_min(list_transform(found, lambda x: len(x))) >= 27 THEN 'TD2' END END"""
_PAIRS = "[" + ", ".join(f"['{a}', '{b}']" for a, b in mrz.CONFUSED) + "]"
_SWAPS = f"list_filter(flatten(list_transform(range(1, 10), lambda i: list_transform(list_filter({_PAIRS}, lambda p: p[1] = document_number[i]), lambda p: document_number[1:i - 1] || p[2] || document_number[i + 1:9]))), lambda v: {_digit('v')} = checks[1][2])"
_DAY = "(NOT regexp_full_match({0}, '[0-9]{{6}}') OR try_strptime('20' || {0}, '%Y%m%d') IS NULL)"
_ZONES_SQL = f"""
  cuts AS ({' UNION ALL '.join(_kind_sql(k) for k in mrz.KINDS)}),
  dated AS (SELECT * REPLACE (translate(date_of_birth, 'OoIilBSsGZQ', '00111855620') AS date_of_birth, translate(expiry_date, 'OoIilBSsGZQ', '00111855620') AS expiry_date), list_transform(checks, lambda c: {_digit('c[1]')} = c[2]) AS oks FROM cuts),
  zones AS (
    SELECT doc_id, kind, rtrim(document_code, '<') AS document_code, translate(issuing_country, '01', 'OI') AS issuing_country, trim(translate(split_part(names, '<<', 1), '<', ' ')) AS surname,
      CASE WHEN contains(names, '<<') THEN trim(translate(substr(names, instr(names, '<<') + 2), '<', ' ')) ELSE '' END AS given_names, translate(document_number, '01', 'OI') AS document_number, translate(nationality, '01', 'OI') AS nationality,
      date_of_birth, sex, expiry_date, personal_number, oks, len(list_filter(oks, lambda o: o)) AS n_right, round(n_right / len(oks), 4) AS confidence,
      CAST(len(oks) - n_right + (sex NOT IN ('M', 'F', 'X', '<'))::INT + {_DAY.format('date_of_birth')}::INT + {_DAY.format('expiry_date')}::INT AS INT) AS n_errors,
      CASE WHEN NOT oks[1] AND len({_SWAPS}) = 1 THEN ({_SWAPS})[1] END AS number_repaired FROM dated
  ), told AS (SELECT *, CASE WHEN n_errors = 0 THEN 'VALID' WHEN confidence >= 0.5 THEN 'PARTIAL' WHEN confidence > 0 THEN 'OCR_CORRUPTED' ELSE 'INVALID' END AS status FROM zones)"""


@query(
    f"WITH source AS (SELECT * FROM zone_texts), lines AS ({_found_sql('text')}), kinds AS (SELECT doc_id, found, {_KIND} AS kind FROM lines), {_ZONES_SQL} "
    "SELECT doc_id, kind, document_code, issuing_country, surname, given_names, document_number, nationality, date_of_birth, sex, expiry_date, personal_number, n_errors, confidence, status, number_repaired FROM zone_texts LEFT JOIN told USING (doc_id)",
    "zone_texts",
)
def machine_readable_zones(spark: SparkSession, d: str) -> DataFrame:
    read = spread(record(spark, d, "zone_texts")).select("doc_id", mrz.read_text(F.col("text")).alias("z"))
    return read.select("doc_id", *[f"z.{k}" for k in ("kind", *mrz.TEXT_FIELDS[:10], "n_errors", "confidence", "status", "number_repaired")])


_WORDS = sorted({*passport.FRAGMENTS, *(w for words in passport.LABELS.values() for w in words)})
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_LABELISH = rf"(len(lv) < 2 OR {' OR '.join(f'''contains(lv, '{w.replace(chr(39), chr(39) * 2)}')''' for w in _WORDS)} OR (len(string_split(lv, ' ')) > 5 AND NOT regexp_matches(lv, '\d')))"
_TIDY = r"trim(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '^[/:;,.\-\s]+|[/:;,.\-\s]+$', '', 'g'))"
_DATE = r"""CASE WHEN regexp_full_match(trim({0}), '\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}') THEN strftime(try_strptime(regexp_replace(trim({0}), '[./-]', '-', 'g'), '%d-%m-%Y'), '%Y-%m-%d')
  WHEN regexp_full_match(trim({0}), '\d{{1,2}}[.-]\d{{1,2}}[.-]\d{{2}}') THEN strftime(try_strptime(regexp_replace(regexp_replace(trim({0}), '[.-]', '-', 'g'), '(\d\d)$', CASE WHEN right(trim({0}), 2) <= '30' THEN '20\1' ELSE '19\1' END), '%d-%m-%Y'), '%Y-%m-%d') END"""
_SIX = "CAST(try_strptime(CASE WHEN {0}[1:2] <= '30' THEN '20' ELSE '19' END || {0}, '%Y%m%d') AS DATE)"
_CLEAN = "nullif(trim(replace({0}, '<', '')), '')"
_ALL_LABELS = " UNION ALL ".join(
    f"SELECT doc_id, 'document_label' AS fact_type, CASE {' '.join(f'''WHEN contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}') THEN '{w.replace(chr(39), chr(39) * 2)}' ''' for w in words)} END AS raw, '{name}' AS value, 0.88::DOUBLE AS confidence, 'label' AS source FROM source"
    for name, words in passport.LABELS.items()
)
_BASE = "CASE WHEN list_bool_and(oks) THEN 0.95 ELSE 0.6 END::DOUBLE"
_ZONE_FACTS = " UNION ALL ".join(
    [f"SELECT doc_id, '{k}' AS fact_type, {k} AS raw, {_CLEAN.format(k)} AS value, {_BASE} AS confidence, 1 AS checked FROM told" for k in ("document_code", "issuing_country", "surname", "given_names", "nationality", "personal_number")]
    + [f"SELECT doc_id, 'passport_number', document_number, {_CLEAN.format('document_number')}, CASE WHEN oks[1] THEN 0.95 ELSE 0.6 END::DOUBLE, 0 FROM told"]
    + [f"SELECT doc_id, 'date_of_birth', date_of_birth, CASE WHEN {_SIX.format('date_of_birth')} < DATE '{AS_OF}' AND {_SIX.format('date_of_birth')} >= DATE '{AS_OF}' - INTERVAL 121 YEAR THEN strftime({_SIX.format('date_of_birth')}, '%Y-%m-%d') ELSE date_of_birth END, CASE WHEN oks[2] THEN 0.95 ELSE 0.6 END::DOUBLE, 0 FROM told"]
    + [f"SELECT doc_id, 'date_of_expiry', expiry_date, CASE WHEN {_SIX.format('expiry_date')} > DATE '{AS_OF}' AND {_SIX.format('expiry_date')} <= DATE '{AS_OF}' + INTERVAL 30 YEAR THEN strftime({_SIX.format('expiry_date')}, '%Y-%m-%d') ELSE expiry_date END, CASE WHEN oks[3] THEN 0.95 ELSE 0.6 END::DOUBLE, 0 FROM told"]
    + [f"SELECT doc_id, 'sex', sex, CASE sex WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE 'unspecified' END, {_BASE}, 0 FROM told"]
    + ["SELECT doc_id, 'mrz_confidence', CAST(confidence AS VARCHAR), CAST(confidence AS VARCHAR), 1.0::DOUBLE, 0 FROM told", "SELECT doc_id, 'mrz_status', status, status, 1.0::DOUBLE, 0 FROM told"]
    + ["SELECT doc_id, 'mrz_check_passed', v, v, 1.0::DOUBLE, 0 FROM (SELECT doc_id, CASE WHEN list_bool_and(oks) THEN 'True' ELSE 'False' END AS v FROM told)"]
)
_BESIDE = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS fact_type, nullif({_TIDY.format(f'''regexp_extract(text, '(?i){p}', 1)''')}, '') AS raw FROM source" for k, p in passport.BESIDE.items())
_ANYWHERE = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS fact_type, {n} AS nth, nullif({_TIDY.format(f'''regexp_extract(text, '(?i){p}', 1)''')}, '') AS raw FROM source" for k, ps in passport.ANYWHERE.items() for n, p in enumerate(ps))
_LV = r"trim(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), ' :;.,-/')"
_FUZZY = r"""list_transform(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: regexp_replace(upper(x), '[^A-Z0-9<]', '', 'g')), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN replace(x, 'O', '0') ELSE x END)"""
_PASSPORT_SQL = f"""
  source AS (SELECT doc_id, translate(regexp_replace(text, '[‘’“”]', '', 'g'), '|«»‹›', 'I<<<<') AS text FROM passport_texts), plain_text AS (SELECT * FROM source), first_lines AS ({_found_sql('text')}), first_kinds AS (SELECT doc_id, text, found, {_KIND} AS kind FROM first_lines),
  again AS (SELECT doc_id, array_to_string(list_transform(list_filter({_FUZZY}, lambda x: (contains(x, '<<') OR len(regexp_replace(x, '[^<]', '', 'g')) >= 4) AND len(x) BETWEEN 30 AND 50), lambda x: rpad(x[1:44], 44, '<'))[1:2] || [text], chr(10)) AS text FROM first_kinds WHERE kind IS NULL),
  more_lines AS ({_found_sql('text').replace('FROM source', 'FROM again')}), kinds AS (SELECT doc_id, found, kind FROM first_kinds WHERE kind IS NOT NULL UNION ALL SELECT doc_id, found, {_KIND} AS kind FROM more_lines), {_ZONES_SQL},
  labels AS (SELECT * FROM ({_ALL_LABELS}) WHERE raw IS NOT NULL),
  zone_facts AS (SELECT doc_id, fact_type, raw, value, confidence, 'mrz' AS source FROM (SELECT *, {_LV.format('value')} AS lv FROM ({_ZONE_FACTS}) WHERE value IS NOT NULL) WHERE checked = 0 OR NOT {_LABELISH}),
  beside AS (
    SELECT doc_id, CASE WHEN doubt THEN 'review_candidate' ELSE fact_type END AS fact_type, raw, CASE WHEN doubt THEN fact_type WHEN fact_type = 'date_of_issue' THEN coalesce({_DATE.format('raw')}, raw) ELSE raw END AS value, CASE WHEN doubt THEN 0.32 ELSE 0.76 END::DOUBLE AS confidence, 'ocr_label_value' AS source
    FROM (SELECT *, {_LABELISH} AS doubt FROM (SELECT *, {_LV.format('raw')} AS lv FROM ({_BESIDE}) WHERE raw IS NOT NULL) ANTI JOIN zone_facts USING (doc_id, fact_type))
  ), before AS (SELECT doc_id, fact_type FROM zone_facts UNION ALL SELECT doc_id, fact_type FROM beside),
  anywhere AS (
    SELECT doc_id, fact_type, raw, CASE WHEN fact_type = 'possible_date' THEN coalesce({_DATE.format('raw')}, raw) ELSE raw END AS value, 0.45::DOUBLE AS confidence, 'ocr_fallback' AS source
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_type ORDER BY nth) AS r FROM (SELECT *, {_LV.format('raw')} AS lv FROM ({_ANYWHERE}) WHERE raw IS NOT NULL) WHERE NOT {_LABELISH}) ANTI JOIN before USING (doc_id, fact_type) WHERE r = 1
  )"""


@query(f"WITH {_PASSPORT_SQL} SELECT * FROM labels UNION ALL SELECT * FROM zone_facts UNION ALL SELECT * FROM beside UNION ALL SELECT * FROM anywhere", "passport_texts")
def passport_facts(spark: SparkSession, d: str) -> DataFrame:
    return passport.passport_facts(record(spark, d, "passport_texts"), F.lit(AS_OF).cast("date"))


_EYES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labelled.EYE_CODES.items())
_PERMITS = " ".join(f"WHEN regexp_matches(raw, '(?i){p}') THEN '{code}'" for p, code in labelled.PERMITS)
#: Values and confidences of a card's labels, by kind.
_CARD_VALUES = {
    "text": (_SQUEEZED.format("raw"), f"{labelled.CARD}::DOUBLE"),
    "date": (f"coalesce({_DATE.format('raw')}, {_SQUEEZED.format('raw')})", f"CASE WHEN {_DATE.format('raw')} IS NOT NULL THEN {labelled.CARD} ELSE {labelled.LOW} END::DOUBLE"),
    "can": ("translate(raw, 'OIl', '011')", f"{labelled.CARD}::DOUBLE"),
    "height": ("CAST(CAST(raw AS INT) AS VARCHAR) || 'cm'", f"CASE WHEN CAST(raw AS INT) BETWEEN 80 AND 250 THEN {labelled.CARD} ELSE {labelled.ODD_HEIGHT} END::DOUBLE"),
    "eyes": (f"CASE lower(raw) {_EYES} ELSE lower(raw) END", f"{labelled.CARD}::DOUBLE"),
    "permit": (rf"CASE {_PERMITS} ELSE trim(regexp_replace(lower(trim(raw)), '[-\s_]+', '_', 'g'), '_') END", f"{labelled.CARD}::DOUBLE"),
}


def _card_sql(table: tuple[labelled.Labelled, ...]) -> str:
    parts = []
    for fact in table:
        found = ", ".join(f"nullif(trim(regexp_extract(text, '(?i){p}', 1), ' ' || chr(9) || chr(10)), '')" for p in fact.patterns)
        value, sure = _CARD_VALUES[fact.kind]
        parts.append(f"SELECT doc_id, '{fact.fact_type}' AS fact_type, {value} AS value, {sure} AS confidence FROM (SELECT doc_id, coalesce({found}) AS raw FROM card_texts) WHERE raw IS NOT NULL")
    return " UNION ALL ".join(parts)


@query(_card_sql(labelled.ID_CARD), "card_texts")
def id_card_facts(spark: SparkSession, d: str) -> DataFrame:
    return labelled.card_facts(spread(record(spark, d, "card_texts")), "id_card").where("source = 'label'").drop("source")


@query(_card_sql(labelled.PERMIT), "card_texts")
def residence_permit_facts(spark: SparkSession, d: str) -> DataFrame:
    return labelled.card_facts(spread(record(spark, d, "card_texts")), "residence_permit").where("source = 'label'").drop("source")
