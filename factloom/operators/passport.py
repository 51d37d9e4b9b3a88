"""Facts of passports, in stages that fill what earlier ones left open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import mrz

#: Labels of a passport's fields.
LABELS = {
    "surname": ("surname", "name", "familienname", "nom"),
    "given_names": ("given names", "given name", "vornamen", "vorname", "prénoms", "prenoms"),
    "place_of_birth": ("geburtsort", "place of birth", "lieu de naissance"),
    "date_of_birth": ("geburtsdatum", "date of birth", "date de naissance"),
    "date_of_issue": ("ausstellungsdatum", "date of issue", "date de délivrance", "date de delivrance"),
    "date_of_expiry": ("gültig bis", "gueltig bis", "date of expiry", "expiry date", "date d'expiration"),
    "issuing_authority": ("ausstellende behörde", "ausstellungsbehörde", "issuing authority", "autorité", "autorite"),
    "passport_number": ("passnummer", "passport no", "passport number", "document no"),
    "nationality": ("staatsangehörigkeit", "staatsangehoerigkeit", "nationality", "nationalité", "nationalite"),
    "religious_name_or_pseudonym": ("ordens- oder künstlername", "ordens- oder kuenstlername", "religious name or pseudonym", "nom de religion ou pseudonyme", "or pseudonym"),
    "residence": ("wohnort", "residence", "domicile"),
    "height": ("größe", "groesse", "height", "taille"),
    "eye_color": ("augenfarbe", "colour of eyes", "color of eyes", "couleur des yeux"),
}
#: Fragments of a value that is a label.
FRAGMENTS = ("or pseudonym", "religious name", "nom de religion", "residence", "domicile", "height", "taille", "colour of eyes", "color of eyes", "couleur des yeux", "surname", "given name", "given names", "place of birth", "date of birth", "date of issue", "issuing authority", "nationality", "passport number", "passport no", "document no")
#: Values beside labels.
BESIDE = {
    "place_of_birth": r"(?:geburtsort|place\s+of\s+birth)[:\s]+([A-ZÄÖÜ][A-ZÄÖÜa-zäöüß\s\-]{2,40})",
    "date_of_issue": r"(?:ausstellungsdatum|date\s+of\s+issue)[:\s]+(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})",
    "issuing_authority": r"(?:ausstellende\s+behörde|ausstellungsbehörde|issuing\s+authority)[:\s]+([^\n]{3,80})",
    "passport_number": r"(?:passnummer|passport\s+no\.?|passport\s+number|document\s+no\.?)[:\s]+([A-Z0-9]{6,12})",
    "surname": r"(?:surname|familienname)[:\s]+([A-ZÄÖÜ][A-ZÄÖÜa-zäöüß\s\-]{2,40})",
    "given_names": r"(?:given\s+names?|vorname[n]?)[:\s]+([A-ZÄÖÜ][A-ZÄÖÜa-zäöüß\s\-]{2,50})",
    "nationality": r"(?:nationality|staatsangehörigkeit|staatsangehoerigkeit)[:\s]+([A-ZÄÖÜa-zäöüß\s\-]{2,40})",
}
#: What is looked for when nothing else gave a type.
ANYWHERE = {
    "document_keyword": (r"\b(REISEPASS|PASSPORT)\b", r"\b(BUNDESREPUBLIK\s+DEUTSCHLAND|FEDERAL\s+REPUBLIC\s+OF\s+GERMANY)\b"),
    "issuing_country": (r"\b(DEU|D|DEUTSCHLAND|GERMANY)\b",),
    "possible_location": (r"\b(EISENACH|BERLIN|HAMBURG|MÜNCHEN|MUNICH|KÖLN|KOELN|FRANKFURT|STUTTGART|DÜSSELDORF|DUSSELDORF)\b",),
    "possible_date": (r"\b(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})\b",),
    "passport_number": (r"\b([CFGHJKLMNPRTVWXYZ0-9]{8,10})\b",),
}
#: Confidences of the stages.
LABEL, SURE, DOUBTFUL, OCR, SUSPICIOUS, GUESS = 0.88, 0.95, 0.60, 0.76, 0.32, 0.45
FACT = "struct<fact_type:string,raw:string,value:string,confidence:double,source:string>"


#: What a text must hold, in small letters, for the patterns of BESIDE and ANYWHERE to match: they are asked of no other text.
NEEDED = {
    "place_of_birth": ("geburtsort", "place"), "date_of_issue": ("ausstellungsdatum", "date"), "issuing_authority": ("behörde", "issuing"), "passport_number": ("passnummer", "passport", "document"),
    "surname": ("surname", "familienname"), "given_names": ("given", "vorname"), "nationality": ("nationality", "staatsang"),
    "document_keyword": ("reisepass", "passport", "bundesrepublik", "federal"), "possible_location": ("eisenach", "berlin", "hamburg", "münchen", "munich", "köln", "koeln", "frankfurt", "stuttgart", "düsseldorf", "dusseldorf"),
}


def plain(text: Column) -> Column:
    """Without curly quotes, bars taken for I, angle quotes for fillers."""
    for a, b in (("‘", ""), ("’", ""), ("“", ""), ("”", ""), ("|", "I"), ("«", "<"), ("»", "<"), ("‹", "<"), ("›", "<")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(T.squeeze(c), r"^[/:;,.\-\s]+|[/:;,.\-\s]+$", ""))


def _label_parts() -> list[str]:
    """Labels and fragments without those that hold another one."""
    parts = {*FRAGMENTS, *(w for words in LABELS.values() for w in words)}
    return sorted(p for p in parts if not any(q != p and q in p for q in parts))


_LABEL_IN = r"(?=[" + "".join(sorted({p[0] for p in _label_parts()})) + r"])(?:" + "|".join(_label_parts()) + ")"


def bare(c: Column) -> Column:
    """As ``looks_like_label`` compares values with labels."""
    return F.btrim(F.lower(T.squeeze(c)), F.lit(" :;.,-/"))


def looks_like_label(v: Column) -> Column:
    """Of a bare value: under two characters, a label or a piece of one in it, or more than five words without a digit."""
    return (F.length(v) < 2) | v.rlike(_LABEL_IN) | ((F.size(F.split(v, " ")) > 5) & ~v.rlike(r"\d"))


def _fact(kind: str, raw: Column, value: Column, confidence: Column | float, source: str) -> Column:
    sure = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(F.lit(kind).alias("fact_type"), raw.alias("raw"), value.alias("value"), sure.cast("double").alias("confidence"), F.lit(source).alias("source")).cast(FACT)


def labels(low: Column) -> dict[str, Column]:
    """Which labels a text in small letters holds, by name: the first word of each."""
    rows = {}
    for name, words in LABELS.items():
        out = F.lit(None).cast(FACT)
        for w in reversed(words):
            out = F.when(low.contains(w), _fact("document_label", F.lit(w), F.lit(name), LABEL, "label")).otherwise(out)
        rows[name] = out
    return rows


#: Types whose value is a text that stands in the zone.
ZONE_TEXTS = ("document_code", "issuing_country", "surname", "given_names", "nationality", "personal_number")
ZONE_DATES = {"date_of_birth": ("date_of_birth", D.birth_date_ok), "date_of_expiry": ("expiry_date", D.expiry_date_ok)}


def from_zone(df: DataFrame, z: Column, as_of: Column) -> tuple[DataFrame, list[str]]:
    """df with the facts of a parsed zone as columns, and their types; its own check digit decides how sure number and dates are, all of them how sure the rest is."""
    base = F.when(z["check_ok"], SURE).otherwise(DOUBTFUL)
    own = lambda k: F.when(F.exists(z["checks"], lambda c: (c["name"] == k) & c["ok"]), SURE).otherwise(DOUBTFUL)
    df = df.withColumns({f"c_{k}": F.trim(F.replace(z[k], F.lit("<"), F.lit(""))) for k in (*ZONE_TEXTS, "document_number")} | {f"d_{k}": V.parse_date(z[field]) for k, (field, _) in ZONE_DATES.items()})
    df = df.withColumns({f"b_{k}": bare(F.col(f"c_{k}")) for k in ZONE_TEXTS})
    rows = {k: F.when((F.col(f"c_{k}") != "") & ~looks_like_label(F.col(f"b_{k}")), _fact(k, z[k], F.col(f"c_{k}"), base, "mrz")) for k in ZONE_TEXTS}
    rows["passport_number"] = F.when(F.col("c_document_number") != "", _fact("passport_number", z["document_number"], F.col("c_document_number"), own("document_number"), "mrz"))
    for kind, (field, ok) in ZONE_DATES.items():
        day = F.col(f"d_{kind}")
        rows[kind] = _fact(kind, z[field], F.when(ok(day, as_of), F.date_format(day, "yyyy-MM-dd")).otherwise(z[field]), own(field), "mrz")
    sex = F.when(z["sex"] == "M", "male").when(z["sex"] == "F", "female").otherwise("unspecified")
    rows["sex"] = _fact("sex", z["sex"], sex, base, "mrz")
    for kind, value in (("mrz_confidence", z["confidence"].cast("string")), ("mrz_status", z["status"]), ("mrz_check_passed", F.initcap(z["check_ok"].cast("string")))):
        rows[kind] = _fact(kind, value, value, 1.0, "mrz")
    return df.withColumns({f"z_{k}": F.when(z.isNotNull(), row) for k, row in rows.items()}), list(rows)


def _match(text: Column, pattern: str) -> Column:
    """The pattern's first group; empty if it doesn't match."""
    return F.regexp_extract(text, "(?iu)" + pattern, 1)


def _day_or(raw: Column) -> Column:
    return F.when(raw.rlike("^[ 0-9]"), F.coalesce(F.date_format(V.parse_date(raw), "yyyy-MM-dd"), raw)).otherwise(raw)


def _raws(df: DataFrame, found: dict[str, Column]) -> DataFrame:
    """df with what was found, tidy and null if blank, as r_ columns and bare as b_ columns."""
    df = df.withColumns({f"m_{k}": c for k, c in found.items()})
    df = df.withColumns({f"r_{k}": F.when(F.col(f"m_{k}") != "", tidy(F.col(f"m_{k}"))) for k in found})
    return df.withColumns({f"b_{k}": F.when(F.col(f"r_{k}") != "", bare(F.col(f"r_{k}"))) for k in found})


def beside_labels(df: DataFrame, zone: list[str]) -> DataFrame:
    """df(text, folded) with the facts beside labels as s_ columns, of types that the zone didn't give."""
    open_ = lambda k: F.col(f"z_{k}").isNull() if k in zone else F.lit(True)
    df = _raws(df, {k: F.when(open_(k) & T.holds(F.col("folded"), NEEDED[k]), _match(F.col("text"), p)) for k, p in BESIDE.items()})
    rows = {}
    for kind in BESIDE:
        raw, v = F.col(f"r_{kind}"), F.col(f"b_{kind}")
        value = _day_or(raw) if kind == "date_of_issue" else raw
        row = F.when(looks_like_label(v), _fact("review_candidate", raw, F.lit(kind), SUSPICIOUS, "ocr_label_value")).otherwise(_fact(kind, raw, value, OCR, "ocr_label_value"))
        rows[f"s_{kind}"] = F.when(v.isNotNull(), row)
    return df.withColumns(rows)


def anywhere(df: DataFrame, zone: list[str]) -> DataFrame:
    """df(text, folded) with facts found anywhere as a_ columns, of types that neither zone nor labels gave."""

    def open_(k: str) -> Column:
        asked = F.col(f"z_{k}").isNull() if k in zone else F.lit(True)
        if k in BESIDE:
            asked = asked & ~F.coalesce(F.col(f"s_{k}.fact_type") == k, F.lit(False))
        return asked & T.holds(F.col("folded"), NEEDED[k]) if k in NEEDED and k not in BESIDE else asked

    found = {f"{k}_{n}": F.when(open_(k), _match(F.col("text"), p)) for k, patterns in ANYWHERE.items() for n, p in enumerate(patterns)}
    df = _raws(df, found)
    df = df.withColumns({f"v_{k}": F.coalesce(*[F.when(~looks_like_label(F.col(f"b_{k}_{n}")), F.col(f"r_{k}_{n}")) for n in range(len(patterns))]) for k, patterns in ANYWHERE.items()})
    rows = {}
    for kind in ANYWHERE:
        raw = F.col(f"v_{kind}")
        rows[f"a_{kind}"] = F.when(raw.isNotNull(), _fact(kind, raw, _day_or(raw) if kind == "possible_date" else raw, GUESS, "ocr_fallback"))
    return df.withColumns(rows)


def passport_facts(docs: DataFrame, as_of: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fact_type, raw, value, confidence, source of each fact that a passport's text gives.

    Labels first (as evidence of what the page holds), then the machine-readable zone, then values beside labels
    for types that the zone didn't give, then patterns anywhere for types that neither gave. A value beside a label that looks like a label is a
    review_candidate, whose value names the type. Every stage adds columns to the text's row, nothing is shuffled; null and empty texts give
    no rows, repeated rows the same rows again. ``as_of`` is today's date, by which dates of the zone are checked.
    """
    df = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), plain(F.col(text_col)).alias("text"))
    df = mrz.add_zone(df.withColumn("low", F.lower("text")), "text", "zone").withColumn("folded", T.folded(F.col("low")))
    df, zone = from_zone(df, F.col("zone"), as_of)
    df = anywhere(beside_labels(df, zone), zone)
    facts = F.array(*labels(F.col("low")).values(), *[F.col(f"z_{k}") for k in zone], *[F.col(f"s_{k}") for k in BESIDE], *[F.col(f"a_{k}") for k in ANYWHERE])
    found = df.select("doc_id", facts.alias("__f"))
    # an outer generator, since Spark would work the facts out a second time to filter texts without any
    return found.select("doc_id", F.inline_outer("__f")).where("fact_type is not null")
