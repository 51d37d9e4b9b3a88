"""Extractors of invoices, bank statements, payslips and employment contracts, as tables of labels.

A fact is found by the first of its patterns that matches, its value is what the pattern's group holds. Most
patterns are a label, a colon or space, and a value of some shape.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import extract

#: Confidences of facts that pass, half pass and fail their check.
HIGH, MEDIUM, LOW = 0.90, 0.75, 0.55
#: Shapes of the values behind a label.
AMOUNT, SIGNED = r"[:\s]+([\d.,\s]+)", r"[:\s]+([-+]?[\d.,\s]+)"
DAY = r"\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4}"
DATE = rf"[:\s]+({DAY})"
NAME, LINE, CLAUSE = r"[:\s]+([^\n,]{2,80})", r"[:\s]+([^\n]{2,80})", r"[:\s]+([^\n.]{2,80})"
BLOCK = r"[:\s]+([^\n]+(?:\n[^\n]+){0,4})"
PERSON = r"([A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)+)"
STREET = r"([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ\s\-]+(?:straße|str\.|gasse|weg|allee|platz|ring)\s+\d+[a-z]?\s*,?\s*\d{5}\s+[A-ZÄÖÜ][a-zäöüß]+)"
MONEY = r"(€|EUR|euro|CHF|USD|\$|£|GBP)"
TO = r"\s*(?:bis|to|–|-)\s*"


@dataclass(frozen=True)
class Labelled:
    """A fact type, what its value is (amount, date, month, iban, bic, rate, code, currency, text), and its patterns in order."""

    fact_type: str
    kind: str
    patterns: tuple[str, ...]


def _of(fact_type: str, kind: str, *patterns: str) -> Labelled:
    return Labelled(fact_type, kind, patterns)


#: The labels and patterns of invoices.
INVOICE = (
    _of("subtotal", "amount", rf"(?:nettobetrag|netto(?:\s+gesamt)?|zwischensumme|subtotal|betrag\s+(?:ohne|vor)\s+(?:mwst|ust|steuer)){AMOUNT}"),
    _of("vat_amount", "amount", rf"(?:mehrwertsteuer(?:betrag)?|mwst(?:\s+betrag)?|umsatzsteuer(?:betrag)?|ust(?:\s+betrag)?|vat\s+amount|tax\s+amount){AMOUNT}"),
    _of("total_amount", "amount", rf"(?:gesamtbetrag|rechnungsbetrag|endbetrag|zu\s+zahlender?\s+betrag|total(?:\s+amount)?|bruttobetrag|gesamt(?:\s+inkl\.?\s+(?:mwst|ust))?){AMOUNT}"),
    _of("invoice_number", "text", r"(?:rechnungsnummer|rechnungs-?nr\.?|invoice\s*(?:number|no\.?|#))[:\s]+([A-Z0-9\-/_.]{2,40})"),
    _of("invoice_date", "date", rf"(?:rechnungsdatum|invoice\s+date|datum){DATE}"),
    _of("due_date", "date", rf"(?:fälligkeitsdatum|fällig\s+(?:am|bis)|zahlungsziel|due\s+(?:date|by)){DATE}", rf"(?:zahlbar\s+(?:bis|innerhalb)|zu\s+zahlen\s+bis){DATE}"),
    _of("seller_name", "text", rf"(?:verkäufer|lieferant|anbieter|rechnungssteller|seller|vendor|from){NAME}"),
    _of("seller_address", "text", rf"(?:verkäufer(?:adresse)?|lieferantenadresse|seller\s+address){BLOCK}", STREET),
    _of("seller_tax_id", "code", r"(?:steuernummer|st(?:euer)?\.?\s*nr\.?|tax\s+(?:number|id))[:\s]+(\d[\d\s/]{8,14})"),
    _of("seller_vat_id", "code", r"(?:ust(?:\.?-?id(?:nr\.?)?)?|umsatzsteuer(?:identifikationsnummer)?|vat(?:\s*(?:id|number|no\.?))?)[:\s]+([A-Z]{2}[\d\s]{8,12})"),
    _of("buyer_name", "text", rf"(?:käufer|auftraggeber|kunde|rechnungsempfänger|buyer|bill(?:ed)?\s+to|rechnung\s+an){NAME}"),
    _of("buyer_address", "text", rf"(?:käufer(?:adresse)?|lieferadresse|rechnungsadresse|buyer\s+address|bill(?:ing)?\s+address){BLOCK}"),
    _of("vat_rate", "rate", r"(?:mwst(?:\s*-?\s*satz)?|ust(?:\s*-?\s*satz)?|mehrwertsteuersatz|vat\s+rate|tax\s+rate)[:\s]+(\d{1,2}(?:[.,]\d{1,2})?)\s*%?", r"(\d{1,2}(?:[.,]\d{1,2})?)\s*%\s*(?:mwst|ust|mehrwertsteuer|umsatzsteuer|vat)"),
    _of("currency", "currency", rf"(?:währung|currency)[:\s]+{MONEY}", rf"(?:gesamtbetrag|total(?:\s+amount)?|rechnungsbetrag)[^\n]{{0,40}}{MONEY}"),
    _of("payment_reference", "text", rf"(?:verwendungszweck|zahlungsreferenz|referenz(?:nummer)?|payment\s+reference|reference\s+(?:number|no\.?)){LINE}"),
)
#: Lines between which an invoice lists its items.
ITEMS_FROM = r"(?:pos(?:ition)?|beschreibung|leistung|artikel|description|item)\s+(?:menge|anzahl|qty|quantity)?\s*(?:preis|price|betrag|amount)?"
ITEMS_TO = r"(?:nettobetrag|zwischensumme|subtotal|gesamt|total|mwst|ust|mehrwertsteuer)"
#: The labels and patterns of bank statements.
BANK = (
    _of("opening_balance", "balance", rf"(?:anfangssaldo|eröffnungssaldo|saldo\s+(?:zu\s+beginn|vortrag|alt)|opening\s+balance|alter\s+saldo){SIGNED}"),
    _of("closing_balance", "balance", rf"(?:schlusssaldo|endsaldo|neuer\s+saldo|saldo\s+(?:zum\s+ende|neu)|closing\s+balance|kontostand){SIGNED}"),
    _of("total_credits", "balance", rf"(?:gutschriften\s+gesamt|gesamte?\s+gutschriften|summe\s+(?:der\s+)?gutschriften|total\s+credits|eingänge\s+gesamt){AMOUNT}"),
    _of("total_debits", "balance", rf"(?:belastungen\s+gesamt|gesamte?\s+belastungen|summe\s+(?:der\s+)?belastungen|total\s+debits|ausgänge\s+gesamt){AMOUNT}"),
    _of("account_holder_name", "text", rf"(?:kontoinhaber(?:in)?|konto\s+lautend\s+auf|account\s+holder|name\s+des\s+kontoinhabers){NAME}", rf"(?:herr(?:n)?|frau)\s+{PERSON}(?=\s*\n\s*(?:[A-ZÄÖÜ]|\d{{5}}))"),
    _of("iban", "iban", r"(?:iban)[:\s]+([A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){4,7})", r"\b([A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){4,7})\b"),
    _of("bic", "bic", r"(?:bic|swift(?:-?code)?)[:\s]+([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)", r"\b([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"),
    _of("bank_name", "text", rf"(?:bank(?:name)?|kreditinstitut|institute){NAME}", r"(?m)^((?:Deutsche\s+Bank|Commerzbank|Sparkasse|Volksbank|Raiffeisenbank|DKB|ING|Postbank|HypoVereinsbank|Landesbank|Stadtsparkasse|Kreissparkasse)[^\n]{0,60})$"),
    _of("statement_period_start", "date", rf"(?:kontoauszug(?:\s+für)?|abrechnungszeitraum|zeitraum|statement\s+period|period){DATE}(?={TO}\d)", rf"(?:von|from){DATE}(?={TO}\d)"),
    _of("statement_period_end", "date", rf"(?:abrechnungszeitraum|zeitraum|statement\s+period|period)[:\s]+{DAY}{TO}({DAY})", rf"(?:bis|to){DATE}"),
    _of("currency", "currency", rf"(?:währung|currency)[:\s]+{MONEY}", rf"(?:saldo|kontostand|balance)[^\n]{{0,40}}{MONEY}"),
)
#: The labels and patterns of payslips.
PAYSLIP = (
    _of("gross_salary", "amount", rf"(?:bruttogehalt|bruttolohn|brutto(?:\s+gesamt)?|gross\s+salary){AMOUNT}"),
    _of("annual_gross_salary", "amount", rf"(?:jahresbrutto|jahres(?:brutto)?gehalt|annual\s+gross){AMOUNT}"),
    _of("net_salary", "amount", rf"(?:nettolohn|nettogehalt|netto(?:\s+gesamt)?|auszahlungsbetrag|net\s+(?:salary|pay)){AMOUNT}"),
    _of("annual_net_salary", "amount", rf"(?:jahresnetto|jahres(?:netto)?gehalt|annual\s+net){AMOUNT}"),
    _of("bonus", "amount", rf"(?:sonderzahlung|prämie|bonus|gratifikation|weihnachtsgeld|urlaubsgeld){AMOUNT}"),
    _of("income_tax", "amount", rf"(?:lohnsteuer|einkommensteuer|income\s+tax){AMOUNT}"),
    _of("solidarity_surcharge", "amount", rf"(?:solidaritätszuschlag|soli(?:zuschlag)?){AMOUNT}"),
    _of("church_tax", "amount", rf"(?:kirchensteuer|church\s+tax){AMOUNT}"),
    _of("health_insurance", "amount", rf"(?:krankenversicherung|kv(?:\s+beitrag)?|health\s+insurance){AMOUNT}"),
    _of("pension_contribution", "amount", rf"(?:rentenversicherung|rv(?:\s+beitrag)?|pension(?:\s+contribution)?){AMOUNT}"),
    _of("unemployment_insurance", "amount", rf"(?:arbeitslosenversicherung|av(?:\s+beitrag)?|unemployment(?:\s+insurance)?){AMOUNT}"),
    _of("care_insurance", "amount", rf"(?:pflegeversicherung|pv(?:\s+beitrag)?|care\s+insurance){AMOUNT}"),
    _of("employer_name", "text", rf"(?:arbeitgeber|employer|firma|unternehmen){NAME}"),
    _of("employee_name", "text", rf"(?:arbeitnehmer(?:in)?|mitarbeiter(?:in)?|employee)[:\s]+{PERSON}", rf"(?:herr(?:n)?|frau)\s+{PERSON}"),
    _of("employee_id", "text", r"(?:personalnummer|mitarbeiternummer|employee\s*(?:id|number|nr\.?))[:\s]+([A-Z0-9\-]{2,20})"),
    _of("tax_id", "code", r"(?:steuer(?:identifikationsnummer|id(?:nummer)?)|steuer-?id|tax\s*id)[:\s]+(\d[\d\s]{9,12})"),
    _of("social_security_number", "ssn", r"(?:sozialversicherungsnummer|sv(?:\s*-?\s*nummer)?|rentenversicherungsnummer|social\s+security)[:\s]+([\d\s]{2}\s?[\d\s]{6}\s?[A-Za-z]\s?[\d\s]{3})", r"(?:sozialversicherungsnummer|sv(?:\s*-?\s*nummer)?)[:\s]+([A-Za-z][\d\s]{8}[A-Za-z][\d\s]{2})"),
    _of("pay_period_start", "date", rf"(?:abrechnungszeitraum|pay(?:roll)?\s+period|lohnzeitraum){DATE}", rf"(?:von|from){DATE}(?=\s*(?:bis|to)\s+\d)"),
    _of("pay_period_end", "date", rf"(?:abrechnungszeitraum|pay(?:roll)?\s+period|lohnzeitraum)[:\s]+{DAY}{TO}({DAY})", rf"(?:bis|to){DATE}"),
    _of("pay_month", "month", r"(?:für\s+(?:den\s+)?monat|for\s+(?:the\s+)?month\s+of|monat)[:\s]+(\d{1,2}[.\-/]\d{4})", r"(?:für\s+(?:den\s+)?monat|for\s+(?:the\s+)?month\s+of|monat)[:\s]+([A-Za-zÄÖÜäöü]+\s+\d{4})", r"(?:lohnabrechnung|gehaltsabrechnung)\s+([A-Za-zÄÖÜäöü]+\s+\d{4}|\d{1,2}[.\-/]\d{4})"),
    _of("pay_date", "date", rf"(?:auszahlungsdatum|zahlungsdatum|pay(?:ment)?\s+date|überweisungsdatum){DATE}"),
    _of("tax_class", "text", r"(?:steuerklasse|steuerkl\.?|tax\s+class)[:\s]+([1-6](?:/[1-6])?)"),
)
#: How a contract names intervals of pay, and the pay itself: amount, currency, interval.
INTERVAL = r"(monatlich|monthly|jährlich|annual|wöchentlich|weekly|stündlich|hourly|pro\s+monat|pro\s+jahr|pro\s+woche|pro\s+stunde{more})"
PAY = (
    rf"(?:gehalt|lohn|vergütung|brutto(?:gehalt|lohn)?|grundgehalt|salary|remuneration)[:\s]+([\d.,]+)\s*{MONEY}?\s*{INTERVAL.replace('{more}', '')}?",
    rf"([\d.,]+)\s*{MONEY}\s*{INTERVAL.replace('{more}', '|brutto|gross')}?",
)
INTERVALS = ((r"monat|monthly|pro\s+monat", "monthly"), (r"jahr|annual|jährlich|pro\s+jahr", "annual"), (r"woche|weekly|wöchentlich|pro\s+woche", "weekly"), (r"stunde|hourly|stündlich|pro\s+stunde", "hourly"))
#: Kinds of employment, the first that fits; ``unbefristet`` stands before ``befristet``.
EMPLOYMENT = (
    (r"unbefristet|permanent", "permanent"), (r"befristet|fixed.term|temporary", "fixed_term"), (r"teilzeit|part.time", "part_time"), (r"vollzeit|full.time", "full_time"), (r"minijob|geringfügig", "minijob"),
    (r"ausbildung|ausbildungsvertrag|apprenticeship", "apprenticeship"), (r"praktikum|internship", "internship"), (r"werkvertrag", "service_contract"), (r"freier?\s+mitarbeiter|freelance", "freelance"),
)
#: The labels and patterns of employment contracts.
CONTRACT = (
    _of("salary_amount", "salary", *PAY),
    _of("salary_currency", "pay_currency", *PAY),
    _of("salary_interval", "pay_interval", *PAY),
    _of("probation_end_date", "date", rf"(?:probezeit(?:\s+endet|\s+bis)?|probation(?:ary)?\s+(?:period\s+)?(?:ends?|until)?){DATE}"),
    _of("probation_months", "text", r"probezeit\s+(?:beträgt|von|:)\s*(\d+)\s*(?:monat(?:en?)?|month)", r"(\d+)[\s-]*(?:monatige|monatliche)\s+probezeit", r"probation(?:ary)?\s+period\s+(?:of\s+)?(\d+)\s*month"),
    _of("employer_name", "text", rf"(?:arbeitgeber|employer|firma|unternehmen|gesellschaft){NAME}", r"(?:zwischen\s+(?:der\s+)?(?:firma\s+)?)([A-ZÄÖÜ][^\n,]{2,60})(?:\s*,|\s+und\b|\s+and\b|\s+\()"),
    _of("employer_address", "text", r"(?:arbeitgeber(?:adresse|anschrift)|employer\s+address)[:\s]+([^\n]+)", STREET),
    _of("employee_name", "text", rf"(?:arbeitnehmer(?:in)?|mitarbeiter(?:in)?|employee)[:\s]+{PERSON}", rf"(?:herr(?:n)?|frau)\s+{PERSON}", rf"(?:und\s+(?:herrn?\s+|frau\s+)?|and\s+(?:mr\.?\s+|ms\.?\s+|mrs\.?\s+)?){PERSON}", rf"und\s*\n\s*{PERSON}"),
    _of("employment_start_date", "date", rf"(?:beginn(?:\s+des\s+(?:arbeits(?:verhältnisses|vertrags?))?)?|eintrittsdatum|start(?:\s+date)?|ab\s+dem){DATE}", rf"(?:zum|ab|starting|commencing)\s+({DAY})"),
    _of("employment_end_date", "date", rf"(?:ende(?:\s+des\s+(?:arbeits(?:verhältnisses|vertrags?))?)?|befristet\s+bis|end(?:\s+date)?|bis\s+zum){DATE}"),
    _of("employment_type", "employment", rf"(?:art\s+(?:des\s+)?(?:arbeits(?:verhältnisses|vertrags?)|beschäftigung)|employment\s+type|beschäftigungsart){CLAUSE}", r"(unbefristete[sr]?\s+arbeitsvertrag|befristete[sr]?\s+arbeitsvertrag|teilzeit(?:beschäftigung)?|vollzeit(?:beschäftigung)?|minijob|ausbildungsvertrag|praktikumsvertrag|werkvertrag)"),
    _of("job_title", "text", rf"(?:position|stelle|tätigkeit|berufsbezeichnung|job\s*title|funktion){CLAUSE}", r"(?:eingestellt\s+als|hired\s+as|tätig\s+als)\s+([^\n.]{2,80})"),
    _of("working_hours", "hours", r"(?:arbeitszeit|wochenarbeitszeit|working\s+hours?|stunden\s+pro\s+woche)[:\s]+(\d+(?:[.,]\d+)?)\s*(?:stunden?|std\.?|hours?|h)?", r"(\d+(?:[.,]\d+)?)\s*(?:stunden?|std\.?)\s*(?:pro|je|per)\s*woche"),
    _of("notice_period", "text", r"(?:kündigungsfrist|notice\s+period)[:\s]+([^\n.]{2,60})", r"(?:kündigung\s+(?:ist\s+)?(?:mit|mit\s+einer\s+frist\s+von))\s+([^\n.]{2,60})"),
    _of("collective_agreement", "text", rf"(?:tarifvertrag|tarifliche\s+regelung|collective\s+agreement|tarifgruppe|entgeltgruppe){CLAUSE}"),
    _of("workplace_location", "text", rf"(?:arbeitsort|einsatzort|dienstort|workplace|place\s+of\s+work|tätigkeitsort){CLAUSE}"),
)
#: The labels of identity cards and permits, and the codes of permits.
PLACE = r"[:\s]+([A-ZÄÖÜ][A-ZÄÖÜa-zäöüß\s\-]+)"
SHARED = (
    _of("place_of_birth", "text", rf"(?:geburtsort|place\s+of\s+birth){PLACE}"),
    _of("date_of_issue", "date", rf"(?:ausstellungsdatum|date\s+of\s+issue){DATE}"),
    _of("issuing_authority", "text", r"(?:ausstellende\s+behörde|ausstellungsbehörde|issuing\s+authority)[:\s]+([^\n]+)"),
    _of("residence_address", "text", r"(?:anschrift|adresse|wohnort|address)[:\s]+([^\n]+)"),
)
ID_CARD = (
    *SHARED,
    _of("can", "can", r"(?:can|card\s+access\s+number)[:\s]*([0-9OIl]{6})", r"\bcan\b\s+([0-9OIl]{6})"),
    _of("eye_color", "eyes", r"(?:augenfarbe|eye\s+colou?r)[:\s]+([A-ZÄÖÜa-zäöüß]+)"),
    _of("height", "height", r"(?:größe|groesse|height|körpergröße)[:\s]+(\d{2,3})\s*(?:cm)?"),
)
PERMITS = (
    (r"niederlassungserlaubnis", "permanent_residence"), (r"erlaubnis\s+zum\s+daueraufenthalt", "permanent_residence"), (r"aufenthaltserlaubnis", "temporary_residence"), (r"blaue?\s+karte\s+eu", "eu_blue_card"),
    (r"blue\s+card", "eu_blue_card"), (r"aufenthaltsgestattung", "asylum_seeker"), (r"duldung", "tolerated_stay"), (r"visum", "visa"),
)
PERMIT = (*SHARED, _of("permit_type", "permit", r"(?:aufenthaltstitel|art\s+des\s+aufenthaltstitels|permit\s+type)[:\s]+([^\n]+)", r"(niederlassungserlaubnis|aufenthaltserlaubnis|blaue?\s+karte\s+eu|aufenthaltsgestattung|duldung)"))
#: Colours of eyes.
EYE_CODES = {"blau": "blue", "blue": "blue", "braun": "brown", "brown": "brown", "grün": "green", "gruen": "green", "grun": "green", "green": "green", "grau": "grey", "grey": "grey", "gray": "grey", "schwarz": "black", "black": "black", "haselnuss": "hazel", "hazel": "hazel"}
#: Confidences of labels on cards, and of a height that no one has; the heights that people have.
CARD, ODD_HEIGHT, HEIGHTS = 0.80, 0.30, (80, 250)
CARD_TABLES = {"id_card": ID_CARD, "residence_permit": PERMIT}
TABLES = {"invoice": INVOICE, "bank_statement": BANK, "payslip": PAYSLIP, "employment_contract": CONTRACT}


def first_code(value: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    """The code of the first pattern that the value holds, else the value in lower case with underscores."""
    out = T.normalize_key(T.squeeze(value))
    for regex, code in reversed(codes):
        out = F.when(value.rlike("(?iu)" + regex), code).otherwise(out)
    return out


def _normalized(fact: Labelled, raw: Column) -> Column:
    """struct(value, confidence) of what was found."""
    sure = lambda v, ok, low=LOW: F.struct(v.alias("value"), F.when(ok, HIGH).otherwise(low).alias("confidence"))
    plain, compact = T.squeeze(raw), F.upper(F.regexp_replace(raw, r"\s+", ""))
    yes = F.lit(True)
    if fact.kind in ("amount", "balance"):
        amount = V.normalize_amount(F.regexp_replace(raw, r"^\s*[-+]", "") if fact.kind == "balance" else raw)
        return T.once(amount, lambda v: F.struct(v.alias("value"), V.amount_check(F.lit(fact.fact_type), v)["confidence"].alias("confidence")))
    if fact.kind == "date":
        return T.once(F.date_format(V.parse_date(F.trim(raw)), "yyyy-MM-dd"), lambda v: sure(F.coalesce(v, plain), v.isNotNull()))
    if fact.kind == "month":
        return T.once(D.pay_month(F.trim(raw)), lambda v: sure(F.coalesce(F.date_format(v["day"], "yyyy-MM-dd"), plain), v["day"].isNotNull()))
    if fact.kind == "iban":
        shape = compact.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$")
        return F.struct(compact.alias("value"), F.when(V.iban_valid(compact), HIGH).when(shape, MEDIUM).otherwise(LOW).alias("confidence"))
    if fact.kind == "bic":
        return sure(compact, V.bic_valid(compact))
    if fact.kind == "ssn":
        return sure(compact, V.social_security_valid(compact), MEDIUM)
    if fact.kind == "rate":
        return sure(F.format_string("%.1f", F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")), yes)
    if fact.kind == "code":
        return sure(compact, yes)
    if fact.kind in ("currency", "pay_currency"):
        return sure(V.currency(raw), yes)
    if fact.kind == "pay_interval":
        return sure(first_code(raw, INTERVALS), yes)
    if fact.kind == "employment":
        return sure(first_code(raw, EMPLOYMENT), yes)
    if fact.kind == "salary":
        return sure(F.format_string("%.2f", F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")), yes)
    if fact.kind == "permit":
        return sure(first_code(raw, PERMITS), yes)
    if fact.kind == "can":
        return sure(F.translate(raw, "OIl", "011"), yes)
    if fact.kind == "height":
        return sure(F.concat(raw.cast("int").cast("string"), F.lit("cm")), raw.cast("int").between(*HEIGHTS), ODD_HEIGHT)
    if fact.kind == "eyes":
        return sure(F.coalesce(F.create_map(*[F.lit(x) for kv in EYE_CODES.items() for x in kv])[F.lower(raw)], F.lower(raw)), yes)
    if fact.kind == "hours":
        return sure(F.replace(raw, F.lit(","), F.lit(".")), yes)
    return sure(plain, yes)


def card_facts(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Facts of identity cards or permits: from the machine-readable lines where they give a type, else from labels.

    doc_id, fact_type, value, confidence, source. Lines count with 0.95 where the check digits are right, else 0.60; labels
    with CARD.
    """
    lines = F.filter(F.transform(T.clean_lines(F.col(text_col)), lambda x: F.upper(F.regexp_replace(x, r"\s+", ""))), lambda x: x.rlike(r"\A[A-Z0-9<]{30,44}\z") & x.contains("<"))
    read = docs.select(F.col(id_col).alias("doc_id"), extract.parse_mrz(lines).alias("m")).where("m is not null")
    number = "id_number" if kind == "id_card" else "permit_number"
    value = {number: F.col("m.document_number"), "surname": F.col("m.surname"), "given_names": F.col("m.given_names"), "date_of_birth": F.date_format(V.parse_date(F.col("m.birth_date")), "yyyy-MM-dd"), "date_of_expiry": F.date_format(V.parse_date(F.col("m.expiry_date")), "yyyy-MM-dd"), "mrz_status": F.col("m.status")}
    sure = F.when(F.col("m.status") == "VALID", 0.95).otherwise(0.60)
    mrz = read.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("fact_type"), v.alias("value"), sure.alias("confidence")) for k, v in value.items()]))).where("value is not null and value <> ''").withColumn("source", F.lit("mrz"))
    found = extract_labelled(docs, CARD_TABLES[kind], id_col, text_col)
    label = found.select("doc_id", "fact_type", "value", F.when(F.col("confidence") == HIGH, CARD).otherwise(F.col("confidence")).alias("confidence"), F.lit("label").alias("source"))
    # only types that both can give are met; where there are none, as in today's tables, nothing is joined or moved
    both = sorted(value.keys() & {fact.fact_type for fact in CARD_TABLES[kind]})
    if both:
        label = label.join(mrz.where(F.col("fact_type").isin(both)).select("doc_id", "fact_type"), ["doc_id", "fact_type"], "left_anti").select(*mrz.columns)
    return mrz.unionByName(label)


def led(pattern: str) -> str:
    """The pattern, which ignores case, behind a look at the next letter if it begins with plain alternatives: one class instead of all of them at most places."""
    head = re.match(r"\(\?:([^()\[\]\\]*(?:\\s\+[^()\[\]\\]*)*)\)(?![?*{])", pattern)
    plain = head and all(re.match(r"[a-zäöü](?![?*{])", w) for w in head[1].split("|"))
    ahead = f"(?=[{''.join(sorted({w[0] for w in head[1].split('|')}))}])" if plain else ""
    return "(?iu)" + ahead + pattern


def extract_labelled(docs: DataFrame, table: tuple[Labelled, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most one row for each fact type: doc_id, fact_type, raw, value, confidence. Null texts and empty matches give none.

    Facts made from one match (pay's amount, currency, interval) take its groups. A text is searched once
    for each pattern, as a projection of its row, and what was found is a column before it is used twice; nothing is shuffled.
    """
    group = {"pay_currency": 2, "pay_interval": 3}
    text, found, raws, rows = F.col(text_col), {}, {}, []
    for n, fact in enumerate(table):
        if fact.kind in ("salary", "pay_currency", "pay_interval"):  # of the first pattern that matches at all
            raw = F.lit(None).cast("string")
            for p in reversed(fact.patterns):
                raw = F.when(text.rlike(led(p)), F.regexp_extract(text, led(p), group.get(fact.kind, 1))).otherwise(raw)
            found[f"f{n}"], raws[f"r{n}"] = raw, F.nullif(F.col(f"f{n}"), F.lit(""))
        else:
            # a later pattern is asked of texts in which no earlier one found anything
            for k, p in enumerate(fact.patterns):
                asked = reduce(and_, [F.col(f"f{n}_{i}").isNull() | (F.col(f"f{n}_{i}") == "") for i in range(k)], F.lit(True))
                here = F.btrim(F.regexp_extract(text, led(p), 1), F.lit(" \t\n"))
                found[f"f{n}_{k}"] = F.when(asked, here) if k else here
            raws[f"r{n}"] = F.coalesce(*[F.nullif(F.col(f"f{n}_{k}"), F.lit("")) for k in range(len(fact.patterns))])
        raw = F.col(f"r{n}")
        rows.append(F.when(raw.isNotNull(), F.struct(F.lit(fact.fact_type).alias("fact_type"), raw.alias("raw"), _normalized(fact, raw).alias("v"))))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias(text_col))
    for k in range(max((len(fact.patterns) for fact in table), default=0)):
        out = out.withColumns({c: v for c, v in found.items() if c.endswith(f"_{k}") or k == 0 and "_" not in c})
    out = out.select("doc_id", *[v.alias(c) for c, v in raws.items()])
    return out.select("doc_id", F.inline(F.array_compact(F.array(*rows)))).select("doc_id", "fact_type", "raw", "v.value", "v.confidence")


def line_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines of an invoice between the one that heads its items and the first of its sums, as one fact."""
    lines = F.split(F.col(text_col), "\n", -1)
    held = docs.select(F.col(id_col).alias("doc_id"), lines.alias("ls")).withColumn("a", F.array_position(F.transform("ls", lambda x: x.rlike("(?iu)" + ITEMS_FROM)), F.lit(True)).cast("int"))
    rest = held.where("a > 0").select("doc_id", F.slice("ls", F.col("a") + 1, F.greatest(F.size("ls") - F.col("a"), F.lit(0))).alias("ls"))
    rest = rest.withColumn("z", F.array_position(F.transform("ls", lambda x: x.rlike("(?iu)" + ITEMS_TO)), F.lit(True)).cast("int"))
    kept = F.filter(F.when(F.col("z") > 0, F.slice("ls", F.lit(1), F.col("z") - 1)).otherwise(F.col("ls")), lambda x: F.trim(x) != "")
    return rest.select("doc_id", F.lit("line_items_raw").alias("fact_type"), F.array_join(F.transform(kept, lambda x: F.trim(x)), "\n").alias("value"), F.lit(MEDIUM).alias("confidence")).where("value <> ''")
