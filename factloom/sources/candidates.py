"""Invented candidates over line items: types, values and what stands around them are picked by the row's numbers."""

from __future__ import annotations

from factloom.sources.records import RECORDS, case

#: Types of candidates, each with a value that suits it.
SUITED = (
    ("surname", "Mustermann"), ("given_names", "Erika Maria"), ("full_name", "Kim Beispiel"), ("first_name", "Anna-Lena"), ("last_name", "Sommer"), ("date_of_birth", "12.05.1984"),
    ("place_of_birth", "Erfurt"), ("nationality", "italienisch"), ("sex", "F"), ("gender", "X"), ("tax_id", "86095742719"), ("iban", "DE21500105175407324931"), ("phone_number", "+4915123456789"),
    ("mobile", "015123456789"), ("email", "kim.o@example.org"), ("address", "Am Sonnenhang 4, 99817 Eisen"), ("street", "Sonnenweg 12"), ("reference", "QX-778123"), ("case_number", "71/334-22"),
    ("number", "448812"), ("customer_number", "K 99123"), ("employer", "Muster Werke"), ("job_title", "Schlosser"), ("date", "03.04.2019"), ("issue_date", "2021-02-01"), ("expiry_date", "31.12.2030"),
    ("valid_to", "20291231"), ("due_date", "150624"), ("start_date", "01.09.22"), ("letter_date", "11.11.2023"), ("review_candidate", "Erfurt"), ("bank_name", "Volksbank"), ("fax", "+49361123456"),
    ("passport_number", "C01X00T47"), ("height", "172"), ("hobby", "Schach"), ("name", "Winter"), ("organization", "Verein"), ("legal_reference_date", "1.1.2005"), ("issued_date", "2020-10-10"), ("enrollment_date", "soon"),
)
#: Values that suit no or any type.
VALUES = (
    "", "-", "nr", "surname", "ab", "7", "n/a", "--abc--", "***", "info@firma.example", "x@y.example", "max@kreis.example", "a (b c", "one two three four five six seven eight", "bitte ankreuzen", "a b cd ef gh ij",
    "01.01.2035", "05.06.2027", "14.02.2025", "1960-01-31", "31.02.2001", "20010203", "99887766", "010203", "05.06.2012", "Herr Winter", "Dr", "Frau", "Hauptstr. 5", "Lindenallee", "12345 Musterstadt", "Postfach 12, 10115 Berlin",
    "0361 12345-67", "0800 123456789", "03641/123456", "+49 3641 123456", "123", "12345678901234567", "004-12345678901", "015 12345678", "Sommer AG", "Winter-", "O Connor & Sohn", "Anna Berta Clara Dora", "kundencenter 5",
    "Bergstraße 12 in der Stadt und noch weit mehr hier 3", "Teilnehmer Nord", "abc", "monthly", "A7", "Lehrer: x", "wohnt seit langem im schönen alten Ort 5",
)
#: What may stand around a candidate; most rows have nothing there.
AROUND = (
    "nach dem Gesetz vom", "zahlbar bis", "geboren am", "ausgestellt am", "ablaufdatum", "course start", "Termin", "mitglied ab", "mitglied bis", "eintritt", "austritt", "mietbeginn", "mietende", "rechnungsdatum", "beschluss vom",
    "kirchensteuer", "posteingang", "barmer", "Abteilung", "Konto", "Rathaus", "siehe Anlage", "Hotline", "Reisepass", "Kontaktperson", "Empfänger", "homepage", "extension 4", "Sachbearbeiter Ost", "patient", "creditor", "public office",
)
STAGES = ("ocr_regex", "mrz", "manual_entry", "llm_structured", "table")

_H = "(l_orderkey * 31 + l_linenumber * 17 + l_partkey)"
_K, _V, _A = f"{_H} % {len(SUITED)}", f"(l_suppkey * 11 + l_orderkey * 3 + l_linenumber) % {len(VALUES)}", f"(l_partkey * 13 + l_linenumber * 7 + l_orderkey) % {3 * len(AROUND)}"
RECORDS["candidate_rows"] = f"""
    SELECT l_orderkey * 10 + l_linenumber AS candidate_id, l_suppkey AS entity_id, l_orderkey AS document_id, l_partkey AS source_id, {case(_K, tuple(k for k, _ in SUITED))} AS fact_type,
      CASE WHEN {_H} % 3 = 0 THEN {case(_V, VALUES)} ELSE {case(_K, tuple(v for _, v in SUITED))} END AS value, {case(f'{_H} % 5', STAGES)} AS source_stage,
      {case(_A, AROUND)} AS around, CASE {_H} % 29 WHEN 0 THEN 'date_of_issue' WHEN 1 THEN 'date' WHEN 2 THEN 'Valid_From ' WHEN 3 THEN 'surname' WHEN 4 THEN 'iban' WHEN 5 THEN 'date_value' WHEN 6 THEN '' END AS target_field,
      CASE WHEN {_H} % 37 = 0 THEN 'llm_extraction_structurer' END AS source, CASE WHEN {_H} % 4 = 0 THEN 'true' END AS auto_accept, CASE WHEN {_H} % 41 = 0 THEN 'document_label' END AS role,
      CASE {_H} % 43 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS is_person, CASE {_H} % 47 WHEN 0 THEN 'true' END AS as_evidence, CAST({_H} * 37 % 101 AS DOUBLE) / 100 AS confidence
    FROM {{lineitem}}"""
