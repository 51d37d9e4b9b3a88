"""Pattern tables to candidate facts: one generic operator, patterns as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import gates


@dataclass(frozen=True)
class Pattern:
    fact_type: str
    regex: str
    confidence: float
    group: int = 0
    hint: str = ""  # a cheap pattern that every text with a match matches, too


#: Universal patterns with their confidences.
UNIVERSAL = (
    Pattern("email", r"(?iu)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", 0.80, hint="@"),
    Pattern("iban", r"(?iu)\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", 0.82, hint=r"\d{2}"),
    Pattern("phone_number", r"(?:\+?\d[\d\s()./-]{7,}\d)", 0.55, hint=r"\d"),
    Pattern("date", r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", 0.55, hint=r"\d[./-]\d"),
    Pattern("amount", r"(?iu)\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})\s?(?:EUR|€)\b", 0.45, hint=r"(?iu)EUR|€"),
    Pattern("document_number", r"(?iu)\b[A-Z]{1,3}\d{5,10}\b", 0.45, hint=r"\d{5}"),
)


def all_matches(docs: DataFrame, patterns: tuple[Pattern, ...] = UNIVERSAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every pattern: doc_id, fact_type, value, confidence, ord (pattern, then match)."""
    def found(n: int, p: Pattern) -> Column:
        row = lambda v, i: F.struct(F.lit(p.fact_type).alias("fact_type"), v.alias("value"), F.lit(p.confidence).alias("confidence"), (F.lit(n).cast("long") * 1_000_000 + i).alias("ord"))
        every = F.regexp_extract_all(F.col(text_col), F.lit(p.regex), F.lit(p.group))
        return F.transform(F.when(F.col(text_col).rlike(p.hint), every).otherwise(F.array().cast("array<string>")) if p.hint else every, row)

    structs = [found(n, p) for n, p in enumerate(patterns)]
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.flatten(F.array(*structs))))


def first_matches(docs: DataFrame, patterns: tuple[Pattern, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first match per fact type; earlier patterns of a type win."""
    per_type: dict[str, list[Pattern]] = {}
    for p in patterns:
        per_type.setdefault(p.fact_type, []).append(p)
    structs = []
    for n, (kind, ps) in enumerate(per_type.items()):
        value = F.coalesce(*[F.nullif(F.regexp_extract(F.col(text_col), p.regex, p.group), F.lit("")) for p in ps])
        structs.append(F.struct(F.lit(kind).alias("fact_type"), T.squeeze(value).alias("value"), F.lit(ps[0].confidence).alias("confidence"), F.lit(n).cast("long").alias("ord")))
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(*structs))).where("value is not null")


def label_values(docs: DataFrame, labels: dict[str, list[str]], confidence: float = 0.68, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per clean line and field, the value after the first label that starts it, or the next line's."""
    lines = docs.select(F.col(id_col).alias("doc_id"), T.clean_lines(F.col(text_col)).alias("ls")).select("doc_id", F.inline(F.transform("ls", lambda x, i: F.struct(x.alias("line"), F.get("ls", i + 1).alias("next"), i.alias("n")))))
    structs = []
    for k, (field, names) in enumerate(labels.items()):
        regex = "(?iu)^(?:" + "|".join(names) + r")\s*[:\-]?\s*(.*)$"
        after = F.trim(F.regexp_extract("line", regex, 1))
        structs.append(F.when(F.col("line").rlike(regex), F.struct(F.lit(field).alias("fact_type"), F.coalesce(F.nullif(after, F.lit("")), "next").alias("value"), F.lit(confidence).alias("confidence"), (F.col("n") * 100 + k).cast("long").alias("ord"))))
    return lines.select("doc_id", F.inline(F.array_compact(F.array(*structs)))).where("value is not null")


def mrz_lines(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to three lines that look like machine-readable ones."""
    compact = F.transform(T.clean_lines(F.col(text_col)), lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    found = F.slice(F.filter(compact, lambda x: x.rlike("^[A-Z0-9<]{25,44}$") & x.contains("<")), 1, most)
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.transform(found, lambda v, i: F.struct(F.lit("mrz_line").alias("fact_type"), v.alias("value"), F.lit(0.78).alias("confidence"), i.cast("long").alias("ord")))))


def parse_mrz(lines: Column) -> Column:
    """TD1, TD2 or TD3 by number and length of lines: number, dates, names, and the share of right check digits."""
    l1, l2, l3 = (F.get(lines, F.lit(i)) for i in range(3))
    kind = F.when((F.size(lines) == 3) & (F.length(l1) == 30), "TD1").when((F.size(lines) == 2) & (F.length(l1) == 44), "TD3").when((F.size(lines) == 2) & (F.length(l1) == 36), "TD2")
    number = F.when(kind == "TD1", F.substring(l1, 6, 9)).otherwise(F.substring(l2, 1, 9))
    number_digit = F.when(kind == "TD1", F.substring(l1, 15, 1)).otherwise(F.substring(l2, 10, 1))
    at = F.when(kind == "TD1", 1).otherwise(14)
    birth, expiry = F.substring(l2, at, F.lit(6)), F.substring(l2, at + 7 + F.when(kind == "TD1", 1).otherwise(1), F.lit(6))
    digit = lambda pos: F.substring(l2, pos, F.lit(1))
    names = F.when(kind == "TD1", l3).otherwise(F.substring(l1, 6, 64))
    right = sum((V.mrz_digit(a) == b.try_cast("int")).cast("int") for a, b in ((number, number_digit), (birth, digit(at + 6)), (expiry, digit(at + 14))))
    share = F.round(F.coalesce(right, F.lit(0)) / 3.0, 4)
    status = F.when(share == 1, "VALID").when(share >= 0.5, "PARTIAL").when(share > 0, "OCR_CORRUPTED").otherwise("INVALID")
    clean = lambda c: F.trim(F.regexp_replace(c, "<+", " "))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.replace(number, F.lit("<"), F.lit("")).alias("document_number"), birth.alias("birth_date"), expiry.alias("expiry_date"), clean(F.split_part(names, F.lit("<<"), F.lit(1))).alias("surname"), clean(F.split_part(names, F.lit("<<"), F.lit(2))).alias("given_names"), share.alias("confidence"), status.alias("status")))


def gate(candidates: DataFrame) -> DataFrame:
    """Adds value_norm, reject_reason (null: valid) by the ordered rules of each fact type."""
    value = T.normalize_value(F.col("fact_type"), F.col("value"))
    return candidates.withColumn("value_norm", value).withColumn("reject_reason", gates.reject_reason(F.col("fact_type"), F.col("value_norm")))


def first_wins(candidates: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The row of least order for each key."""
    return candidates.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


#: Patterns that count only on lines with a label of theirs.
CONTEXTUAL = (
    (Pattern("bic", r"(?i)\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.65), ("bic", "swift")),
    (Pattern("passport_number", r"(?i)\b[A-Z0-9]{8,10}\b", 0.55), ("passport number", "passport no", "pass-nr", "pass nr", "passnummer", "document no", "document number", "passeport no")),
)
#: What is looked for when no model answers; only the first match counts.
FALLBACK = (
    Pattern("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.90),
    Pattern("phone_number", r"(?:\+49|0049|0)\s?\d{2,5}[\s/-]?\d{3,12}", 0.70),
    Pattern("date", r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", 0.65),
)


def contextual_matches(docs: DataFrame, patterns: tuple = CONTEXTUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match on a clean line that has one of the pattern's labels as a word: doc_id, line, fact_type, value, confidence."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.clean_lines(F.col(text_col))).alias("line", "__line"))
    found = []
    for p, labels in patterns:
        words = "|".join(T.normalized_label(x) for x in labels)
        kind, confidence = F.lit(p.fact_type).alias("fact_type"), F.lit(p.confidence).alias("confidence")
        typed = F.transform(F.regexp_extract_all(F.col("__line"), F.lit(p.regex), F.lit(0)), lambda v: F.struct(kind, F.upper(v).alias("value"), confidence))  # noqa: B023
        found.append(F.when(T.normalize_text(F.col("__line")).rlike(rf"\b(?:{words})\b"), typed))
    return lines.select("doc_id", "line", F.inline(F.flatten(F.array_compact(F.array(*found)))))


def fallback_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first match of each fallback pattern, line breaks being spaces."""
    return first_matches(docs.withColumn(text_col, F.replace(F.col(text_col), F.lit("\n"), F.lit(" "))), FALLBACK, id_col, text_col)


def self_declared(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """Name and age that a person states about themselves, as cases to review; the columns of turns stay."""
    t = F.trim(F.col(text_col))
    name = T.squeeze(F.regexp_extract(t, r"(?i)\b(?:i am|i'm|my name is)\s+([a-z][a-z\s'-]{1,80}?)(?:\s+\d{1,3}\s+years old|\s+and|\s+will|\s+can|\s+save|$)", 1))
    age = F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)\b(\d{1,3})\s+years old\b", 1), F.lit("")), F.regexp_extract(t, r"(?i)\bmy age is\s+(\d{1,3})\b", 1)).try_cast("int")
    said = lambda kind, v, when: F.when(when, F.struct(F.lit(kind).alias("fact_type"), v.cast("string").alias("value"), F.lit(0.5).alias("confidence")))
    return turns.select("*", F.inline(F.array_compact(F.array(said("name", name, name != ""), said("age", age, age.between(1, 129))))))
