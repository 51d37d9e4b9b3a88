"""What kind of document a text is, and which extractor it goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import folded, holds, once

#: Kinds with the words that tell them, in order; the first kind with a word in the text wins.
FIRST_WORDS = (
    ("passport", ("passport", "travel document", "passeport")),
    ("id_card", ("national id", "identity card", "personalausweis", "carte d'identité")),
    ("residence_permit", ("residence permit", "aufenthaltstitel", "aufenthaltserlaubnis")),
    ("bank_statement", ("bank statement", "account statement", "kontoauszug")),
    ("contract", ("contract", "agreement", "vertrag")),
    ("invoice", ("invoice", "rechnung", "facture")),
    ("certificate", ("certificate", "zertifikat", "certificat")),
)
FIRST_DEFAULT = "passport"
#: Kinds by pattern, in order; the first that matches wins.
PATTERNS = (
    ("passport", r"(?iu)reisepass|passport|p<[a-z]{3}|[A-Z0-9<]{30,44}"),
    ("id_card", r"(?iu)personalausweis|identity\s+card|idcard|ID<[A-Z]{3}"),
    ("residence_permit", r"(?iu)aufenthaltstitel|niederlassungserlaubnis|residence\s+permit"),
    ("employment_contract", r"(?iu)arbeitsvertrag|employment\s+contract|internship\s+contract|arbeitnehmer.*arbeitgeber"),
    ("payslip", r"(?iu)lohnabrechnung|gehaltsabrechnung|entgeltabrechnung|payslip|pay\s+slip"),
    ("bank_statement", r"(?iu)kontoauszug|bank\s*statement|iban\s*:?\s*[A-Z]{2}\d{2}"),
    ("invoice", r"(?iu)rechnung|invoice|rechnungsnummer|invoice\s+no"),
)
#: What a text must hold, in small letters, for the kind's pattern to match; a run of thirty characters of a zone is a passport without any.
NEEDED = {
    "passport": ("reisepass", "passport", "p<"), "id_card": ("personalausweis", "identity", "idcard", "id<"), "residence_permit": ("aufenthaltstitel", "niederlassungserlaubnis", "residence"),
    "employment_contract": ("arbeitsvertrag", "employment", "internship", "arbeitnehmer"), "payslip": ("lohnabrechnung", "gehaltsabrechnung", "entgeltabrechnung", "slip"),
    "bank_statement": ("kontoauszug", "bank", "iban"), "invoice": ("rechnung", "invoice"),
}
ZONE_RUN = r"(?iu)(?<![A-Z0-9<])[A-Z0-9<]{30}"
#: Kinds with the words that count for them; the first kind of most words wins.
SCORE_WORDS = {
    "passport": ("passport", "reisepass", "document no", "passport no", "nationality", "place of birth", "date of birth", "issuing authority"),
    "id_card": ("identity card", "id card", "personalausweis", "national identity", "ausweis", "identity number"),
    "residence_permit": ("residence permit", "aufenthaltstitel", "aufenthaltserlaubnis", "residence card", "permit", "gültig bis"),
    "bank_statement": ("bank statement", "kontoauszug", "iban", "bic", "account number", "balance", "transaction", "booking date"),
    "contract": ("contract", "agreement", "vertrag", "employment contract", "internship agreement", "employee", "employer", "salary", "working hours"),
    "invoice": ("invoice", "rechnung", "tax", "vat", "total amount", "amount due", "invoice number", "ust-id"),
    "certificate": ("certificate", "zertifikat", "bescheinigung", "awarded", "completed", "successfully completed", "course", "training"),
    "insurance": ("insurance", "versicherung", "policy", "insured", "coverage", "krankenversicherung"),
}
#: Names of kinds that mean that none is known, and the kinds with an extractor of their own.
UNKNOWN = ("", "unknown", "other", "undefined", "none", "null")
EXTRACTORS = ("passport", "id_card", "residence_permit", "employment_contract", "payslip", "bank_statement", "invoice")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def by_first_word(text: Column) -> Column:
    """The first kind with one of its words in the text; passport if there is none, also for null."""
    low, out = F.lower(text), F.lit(FIRST_DEFAULT)
    for kind, words in reversed(FIRST_WORDS):
        out = F.when(_any(low, words), kind).otherwise(out)
    return out


def _first_pattern(text: Column, low: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, regex in reversed(PATTERNS):
        hit = holds(low, NEEDED[kind]) & text.rlike(regex)
        out = F.when(hit | text.rlike(ZONE_RUN) if kind == "passport" else hit, kind).otherwise(out)
    return F.when(F.trim(text) != "", out)


def by_pattern(text: Column) -> Column:
    """The first kind whose pattern matches, null if none does or the text is blank. Patterns are asked of texts that hold one of NEEDED."""
    return once(folded(F.lower(text)), lambda low: _first_pattern(text, low))


def add_by_pattern(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with ``by_pattern`` of a column; the text in small letters is a column of its own."""
    return df.withColumn("__low", folded(F.lower(text))).withColumn(name, _first_pattern(F.col(text), F.col("__low"))).drop("__low")


def _scores(low: Column) -> dict[str, Column]:
    return {kind: sum(low.contains(w).cast("int") for w in words) for kind, words in SCORE_WORDS.items()}


def _most(scores: dict[str, Column], best: Column) -> Column:
    out = F.when(F.coalesce(best, F.lit(0)) == 0, "other")
    for kind, score in scores.items():
        out = out.when(score == best, kind)
    return out


def _words(text: Column) -> Column:
    """Small letters; what is no letter, digit or one of :/.- is a space, runs of it one. A single space stays, so that it needn't be replaced."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9äöüß:/.-]{2,}|[^ a-z0-9äöüß:/.-]", " "))


def by_score(text: Column) -> Column:
    """The kind with most of its words in the text, the first of equals; ``other`` if there is none."""
    return once(_words(text), lambda low: _most(_scores(low), F.greatest(*_scores(low).values())))


def add_by_score(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with ``by_score`` of a column; the words and each kind's score are columns of their own, each counted once."""
    columns = {kind: f"__{kind}" for kind in SCORE_WORDS}
    low = df.withColumn("__low", _words(F.col(text)))
    best = low.withColumns({columns[kind]: score for kind, score in _scores(F.col("__low")).items()}).withColumn("__best", F.greatest(*columns.values()))
    return best.withColumn(name, _most({kind: F.col(c) for kind, c in columns.items()}, F.col("__best"))).drop("__low", "__best", *columns.values())


def route(documents: DataFrame, extractors: tuple[str, ...] = EXTRACTORS) -> DataFrame:
    """Adds detected, kind and strategy to documents(text, given_kind).

    An unknown kind becomes the detected one, else ``universal``; a kind without an extractor becomes the detected
    one. With an extractor its facts are joined with the universal ones, else the universal ones stand alone.
    """
    found = add_by_pattern(documents, "text", "detected")
    given = F.coalesce(F.lower(F.trim("given_kind")), F.lit(""))
    kind = F.when(given.isin(*UNKNOWN), F.coalesce("detected", F.lit("universal"))).otherwise(F.col("given_kind"))
    kind = F.when(~kind.isin(*extractors) & F.col("detected").isNotNull(), F.col("detected")).otherwise(kind)
    found = found.withColumn("kind", kind)
    return found.withColumn("strategy", F.when(F.col("kind").isin(*extractors), "primary_plus_universal_with_quality_gate").otherwise("universal_only_quality_gate"))


def needs_cleanup(kind: Column, text: Column, candidates: Column, kept: Column) -> Column:
    """Whether a model should look at the facts again: passports, and documents that gave few facts."""
    low = F.lower(text)
    return F.coalesce((F.lower(F.trim(kind)) == "passport") | low.contains("passport") | low.contains("reisepass") | (candidates < 6) | (kept < 4), F.lit(False))
