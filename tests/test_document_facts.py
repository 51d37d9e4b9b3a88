"""Truth tables of classification, gates, the universal and the labelled extractors, resolution and acceptance."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import acceptance, chat, classify, dashboards, dml, forms, gates, labelled, reads, resolution, universal


def values(spark, cases, schema, **columns):
    """Each case's result columns, in order."""
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i long, {schema}").coalesce(1)
    return [tuple(r)[1:] if len(r) > 2 else r[1] for r in df.select("i", *[c.alias(k) for k, c in columns.items()]).orderBy("i").collect()]


def test_kinds(spark):
    texts = [("Kontoauszug und Rechnung",), ("VISA: P<D<<MUSTER",), ("Arbeitnehmer und\nArbeitgeber",), ("my pay  slip",), ("A" * 31,), (" ",), (None,), ("iban: de12",)]
    t = F.col("t")
    assert values(spark, texts, "t string", x=classify.by_pattern(t)) == ["bank_statement", None, None, "payslip", "passport", None, None, "bank_statement"]
    assert values(spark, texts[:1] + [("a Facture",), ("nothing",), (None,)], "t string", x=classify.by_first_word(t)) == ["bank_statement", "invoice", "passport", "passport"]
    assert values(spark, [("insurance policy, tax",), ("tax iban",), ("",), (None,), ("Ausweis",)], "t string", x=classify.by_score(t)) == ["insurance", "bank_statement", "other", "other", "id_card"]


def test_routes(spark):
    docs = spark.createDataFrame([("Rechnung", " Unknown "), ("Rechnung", "letter"), ("text", None), ("text", "letter"), ("Rechnung", "payslip")], "text string, given_kind string")
    got = [(r["kind"], r["strategy"].startswith("primary")) for r in classify.route(docs).collect()]
    assert got == [("invoice", True), ("invoice", True), ("universal", False), ("letter", False), ("payslip", True)]


GATE = [
    ("surname", "Muster", None), ("surname", "Family name", "label"), ("surname", "name Muster", "label"), ("surname", "Muster2", "surname"), ("surname", "residence hall", "label"),
    ("employer", "name tag factory", None), ("iban", "iban", "label"), ("email", "a@b.de", None), ("email", "a@b", "email"), ("phone_number", "+49 30 123456", None), ("phone_number", "030 123456", "phone_number"),
    ("phone_number", "+49 11 111111", None), ("phone_number", "+44 44 444444", "phone_number"), ("phone_number", "+49 01.02.2020", "phone_number"), ("date_of_birth", "born 1.2.90", None), ("date_of_birth", "1990", "date_of_birth"),
    ("sex", "Weiblich", None), ("sex", "yes", "sex"), ("height", "172 cm", None), ("height", "1.72", "height"), ("eye_color", "blau", None), ("passport_number", "C01X00T47", None), ("passport_number", "ABCDEFG", "junk" if False else "passport_number"),
    ("document_number", "AB12345", None), ("document_number", "12345", "document_number"), ("amount", "12,00 EUR", None), ("amount", "12,00", "amount"), ("tax_id", "12 34", None), ("tax_id", "abcd", "tax_id"), ("nationality", "Germany", "nationality"),
    ("city", "x", "junk"), ("city", "a [b]", "junk"), ("city", "deutsenl", "junk"), ("city", "bcdfghjkl", "junk"), ("city", "rhythmsky", "junk"), ("mrz_line", "P<UTOERIKSSON<<ANNA<MARIA<<<<", None), ("city", "P<<X", "junk"),
    ("document_label", "abc", "internal"), ("city", "  ", "empty"), ("city", None, "empty"), ("address", "Am Land 3", "label"), ("place_of_birth", "a b c d e f", "place_of_birth"),
]


def test_gate(spark):
    got = values(spark, [c[:2] for c in GATE], "t string, v string", x=gates.reject_reason(F.col("t"), F.col("v")))
    assert [(c[0], c[1], g) for c, g in zip(GATE, got)] == GATE


def test_universal_extractor(spark):
    text = "Surname: Mustermann\nGiven names\nErika\nAddress: Name Geburtsdatum\nsex: F\nBIC: COBADEFF x\nDate of birth: 1.2.1990\nkontakt: a@b.de A@B.de\n P<D<<MUSTERMANN<<ERIKA<<<<<<<<<\nhttp://x.de name: Kim\n© iban"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(r["fact_type"], r["value"], r["source"]) for r in universal.candidates(docs).collect()}
    assert ("surname", "Mustermann", "label") in got and ("given_names", "Erika", "label") in got and not any(t == "sex" for t, _, _ in got)  # one letter is noise
    assert ("date_of_birth", "1.2.1990", "label") in got and ("date", "1.2.1990", "pattern") in got and ("mrz_line", "P<D<<MUSTERMANN<<ERIKA<<<<<<<<<", "mrz") in got
    assert ("bic", "COBADEFF", "contextual") in got and [v for t, v, _ in got if t == "email"] == ["a@b.de"]
    assert not any(t == "address" or "Kim" in v for t, v, _ in got)


def test_labelled_tables(spark):
    text = "Rechnungsnummer: RE-77\nFällig bis: 31.02.2021\nBeschreibung Menge Preis\nDinge 2 10,00\n Sachen\nZwischensumme: 99.000.000,00 EUR\n19 % MwSt\nWährung: euro\nUSt-IdNr: DE 123456789"
    bank = "Alter Saldo: -1.234,56 EUR\nHerr Max Muster\n12345 Ort\nZeitraum: 01.01.2021 bis 31.01.2021\nIBAN: DE89 3704 0044 0532 0130\nCommerzbank Berlin"
    pay = "Lohnsteuer: 99,00\nSV-Nummer: 15 070649 C 103\nMonat: März 2021\nBonus: 0,50\nSteuerklasse: 4"
    contract = "Gehalt: 3.000,50 EUR monatlich\nProbezeit beträgt 6 Monate\nbefristeter Arbeitsvertrag\nArbeitszeit: 38,5 Stunden\nBeginn: 1.2.2021"
    docs = spark.createDataFrame([(1, text), (2, bank), (3, pay), (4, contract), (5, None), (6, "")], "doc_id long, text string")
    of = lambda table, i: {r["fact_type"]: (r["value"], r["confidence"]) for r in labelled.extract_labelled(docs, table).where(f"doc_id = {i}").collect()}
    invoice = of(labelled.INVOICE, 1)
    assert invoice["invoice_number"] == ("RE-77", 0.90) and invoice["due_date"] == ("31.02.2021", 0.55) and invoice["subtotal"] == ("99000000.00", 0.55)
    assert invoice["vat_rate"] == ("19.0", 0.90) and invoice["currency"] == ("EUR", 0.90) and invoice["seller_vat_id"] == ("DE123456789", 0.90)
    assert labelled.line_items(docs).collect()[0]["value"] == "Dinge 2 10,00\nSachen"
    found = of(labelled.BANK, 2)
    assert found["opening_balance"] == ("1234.56", 0.90) and found["account_holder_name"] == ("Max Muster", 0.90) and found["iban"][1] == 0.75
    assert (found["statement_period_start"][0], found["statement_period_end"][0]) == ("2021-01-01", "2021-01-31") and found["bank_name"][0] == "Berlin"  # the label pattern comes first
    slip = of(labelled.PAYSLIP, 3)
    assert slip["income_tax"] == ("99.00", 0.90) and slip["bonus"] == ("0.50", 0.55) and slip["pay_month"] == ("2021-03-01", 0.90) and slip["tax_class"][0] == "4" and slip["social_security_number"][0] == "15070649C103"
    job = of(labelled.CONTRACT, 4)
    assert [job[k][0] for k in ("salary_amount", "salary_currency", "salary_interval", "probation_months", "employment_type", "working_hours", "employment_start_date")] == ["3000.50", "EUR", "monthly", "6", "fixed_term", "38.5", "2021-02-01"]
    assert labelled.extract_labelled(docs.where("doc_id > 4"), labelled.INVOICE).count() == 0


def test_cards(spark):
    card = "Personalausweis\nGröße: 172 cm\nAugenfarbe: Blau\nCAN: 12O4I6\nAnschrift: Am Weg 3\nGeburtsort: Ulm"
    permit = "Art des Aufenthaltstitels: blaue Karte EU\nAusstellungsdatum: 01.02.2020\nI<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"
    docs = spark.createDataFrame([(1, card), (2, permit), (3, "Größe: 30 cm"), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["fact_type"]): (r["value"], r["confidence"], r["source"]) for r in labelled.card_facts(docs, "id_card").collect()}
    assert got[1, "height"] == ("172cm", 0.80, "label") and got[1, "eye_color"][0] == "blue" and got[1, "can"][0] == "120416" and got[3, "height"] == ("30cm", 0.30, "label")
    found = {r["fact_type"]: (r["value"], r["confidence"]) for r in labelled.card_facts(docs, "residence_permit").where("doc_id = 2").collect()}
    assert found["permit_type"] == ("eu_blue_card", 0.80) and found["permit_number"] == ("D23145890", 0.95) and found["surname"] == ("ERIKSSON", 0.95) and found["date_of_issue"] == ("2020-02-01", 0.80)
    assert (found["date_of_birth"][0], found["date_of_expiry"][0]) == ("1974-08-12", "2012-04-15")


def test_cards_ask_each_pattern_once_and_join_nothing(spark):
    docs = spark.createDataFrame([(1, "Größe: 172 cm"), (2, "KÖRPERGRÖßE: 80cm\ncan 12345\ncan\n99l999"), (3, "ſ Wohnort  Ulm, ADDRESS: 5"), (None, "place of birth: Ulm")], "doc_id long, text string")
    label = labelled.card_facts(docs, "id_card").where("source = 'label'")
    plan = label._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no type comes from both lines and labels
    for fact in labelled.ID_CARD:
        for p in fact.patterns:
            assert plan.count(p) == 1, p  # it was two: once to see whether it is empty, once for the value
    got = {(r["doc_id"], r["fact_type"]): r["value"] for r in label.collect()}
    assert got == {(1, "height"): "172cm", (2, "height"): "80cm", (2, "can"): "991999", (3, "residence_address"): "Ulm, ADDRESS: 5", (None, "place_of_birth"): "Ulm"}


def test_a_look_ahead_changes_no_match():
    for table in (*labelled.TABLES.values(), *labelled.CARD_TABLES.values()):
        for p in (p for fact in table for p in fact.patterns):
            led = labelled.led(p)
            if "(?=[" in led[:8]:
                # every alternative's first letter is in the class
                assert led.endswith(p) and {w[0] for w in p[3 : p.index(")")].split("|")} == set(led[8 : led.index("]")]), p
    assert labelled.led("a|b") == "(?iu)a|b" and labelled.led("(?:a?b|c)d") == "(?iu)(?:a?b|c)d" and labelled.led("(?:ab|c)?d") == "(?iu)(?:ab|c)?d"


def test_resolution(spark):
    rows = [("one", 1, "city", "Ulm", 0.5, 1), ("hard", 1, "iban", "DE1", 0.5, 1), ("hard", 2, "iban", "DE2", 0.9, 2), ("soft", 1, "city", "Berlin", 0.5, 1), ("soft", 2, "city", "berlin", 0.6, 2), ("apart", 1, "city", "Ulm", 0.5, 1), ("apart", 2, "city", "Bonn", 0.5, 2), ("none", 1, "city", "Ulm", 0.5, 1), ("none", 2, "job", "Ulm", 0.5, 2)]
    c = spark.createDataFrame(rows, "group_id string, entity_id long, fact_type string, value string, confidence double, ord long")
    got = {r["group_id"]: (r["decision"], r["primary_id"], r["score"], r["conflict_types"]) for r in resolution.resolve_groups(c).collect()}
    assert got == {"one": ("single", 1, 1.0, ""), "hard": ("conflict", 2, 0.0, "iban"), "soft": ("merged", 2, 1.0, ""), "apart": ("apart", 1, 1.0, ""), "none": ("apart", 1, 1.0, "")}
    best = {(r["group_id"], r["value"]) for r in resolution.canonical_values(c, resolution.resolve_groups(c)).collect()}
    assert {("hard", "DE2"), ("soft", "berlin"), ("apart", "Ulm")} <= best and ("hard", "DE1") not in best


@pytest.mark.parametrize("case, want", [(dict(), "accepted"), (dict(confidence=0.89), "case"), (dict(mrz_check_passed=None), "case"), (dict(auto_accept=False), "case"), (dict(role="document_label"), "case"), (dict(is_person_fact=False), "case"), (dict(field_name="mrz_status"), "case"), (dict(source="ocr", n_evidence=0), "rejected")])
def test_acceptance(spark, case, want):
    row = dict(field_name="surname", confidence=0.95, n_evidence=1, source="MRZ", mrz_check_passed=True, auto_accept=None, role=None, is_person_fact=None) | case
    df = spark.createDataFrame([tuple(row.values())], "field_name string, confidence double, n_evidence long, source string, mrz_check_passed boolean, auto_accept boolean, role string, is_person_fact boolean")
    assert acceptance.split(df).first()["outcome"] == want


def test_canonical_json(spark):
    import json

    row = {"b": 'q"\\\n', "a": None, "c": "é"}
    got = spark.createDataFrame([(row["b"], row["a"], row["c"])], "b string, a string, c string").select(acceptance.canonical_json({k: F.col(k) for k in row}).alias("j")).first()["j"]
    assert got == json.dumps(row, sort_keys=True, ensure_ascii=False)


def test_forms(spark):
    names = [("x.p0.x22.y85",), ("neue_adresse-1",), ("",)]
    assert values(spark, names, "n string", x=forms.readable(F.col("n"))) == ["Unknown field · Page 1 · x22 y85", "Neue Adresse 1", ""]
    assert values(spark, [("New Address",), ("Straße",), ("E-Mail",), ("zzz",)], "n string", x=forms.suggest(F.col("n"))) == ["address", "address", "email", ""]


def test_questions(spark):
    asked = [("Hi!",), ("hi there, who are you",), ("I'm Kim, remember this",), ("remember this",), (None,)]
    assert values(spark, asked, "q string", x=chat.intent(F.col("q"))) == ["greeting", "assistant", "save_info", "llm", "llm"]


def test_stages_and_dml(spark):
    zero = dict(entities=1, documents=1, facts=1, pending_cases=0, accepted_facts=0, profiles=0, outputs=0)
    cases = [dict(entities=0), dict(documents=0), dict(facts=0), dict(pending_cases=1), dict(accepted_facts=1), dict(profiles=1), dict()]
    df = spark.createDataFrame([tuple((zero | c).values()) for c in cases], ", ".join(f"{k} long" for k in zero)).coalesce(1)
    assert [r[0] for r in df.select(dashboards.stage()).collect()] == ["Entity Start", "Document Intake", "Extraction", "Human Review", "Profile Build", "Forms and Output", "Operational"]
    base = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (3, None, "old")], "id long, h string, s string")
    new = spark.createDataFrame([(1, "z", "by id"), (9, "b", "by hash"), (8, "b", "lost"), (7, None, "new")], "id long, h string, s string")
    assert sorted(dml.upsert_by_either(base, new, "id", "h").collect(), key=lambda r: r["id"]) == [(1, "z", "by id"), (3, None, "old"), (7, None, "new"), (9, "b", "by hash")]
    assert reads.search(base, "A", ["h"]).count() == 1
