"""Which field a candidate belongs to, whether it becomes a fact, and which rule said so.

Hint words are looked up by Arrow, a batch of texts at once and each distinct text of a batch once: one pattern of all words
says which texts hold any, and one for each family which of these hold one of its words, so that a text's families are the bits
of one whole number. Rules are ordered lists of (name, condition, result); the first that holds decides, and its place in the
list and its name stay with the candidate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.dates import knowledge_date, whole_years
from factloom.operators.hints import CONTEXT_KEYS, FIELDS, HINTS, JUNK, LABELS, OTHER_PARTY, PHONE_PREFIXES, TITLES, WEAK_JUNK

FAMILIES = tuple(HINTS)
Rule = tuple[str, Column, Column]


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def hint_bits(text: Column) -> Column:
    """The families of which a word stands in a lower-case text, as bits; null and empty texts have none."""
    of_family = [(1 << i, _any_of(HINTS[f])) for i, f in enumerate(FAMILIES)]
    of_all = _any_of(tuple(dict.fromkeys(w for f in FAMILIES for w in HINTS[f])))

    def run(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        some = pc.indices_nonzero(pc.match_substring_regex(coded.dictionary, of_all))
        held = coded.dictionary.take(some)
        bits = pa.repeat(pa.scalar(0, pa.int64()), len(held))
        for bit, words in of_family:
            bits = pc.bit_wise_or(bits, pc.multiply(pc.match_substring_regex(held, words).cast(pa.int64()), bit))
        place = pc.index_in(coded.indices, some.cast(coded.indices.type))
        return pc.fill_null(bits.take(place), 0)

    return F.arrow_udf(run, "bigint")(text)


def has(bits: Column, *families: str) -> Column:
    return bits.bitwiseAND(F.lit(sum(1 << FAMILIES.index(f) for f in families)).cast("long")) != 0


def squeezed(c: Column) -> Column:
    """Single spaces for all white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def context_text(fact_type: Column, raw: Column, normalized: Column, stage: Column, metadata: Column) -> Column:
    """What stands around a candidate: four of its columns and its metadata by key, in lower case; nulls are left out."""
    return F.lower(F.trim(F.concat_ws(" ", fact_type, raw, normalized, stage, *[metadata[k] for k in CONTEXT_KEYS])))


def looks_like_date(c: Column) -> Column:
    return F.trim(c).rlike(r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{6}|\d{8})$")


@dataclass(frozen=True)
class Signals:
    """Columns that rules look at: the value with single spaces, in lower case, and the hints of value and context."""

    value: Column
    lowered: Column
    context: Column
    in_value: Column
    in_context: Column

    @property
    def words(self) -> Column:
        return F.size(F.split(self.value, " "))

    @property
    def address(self) -> Column:
        """A postal code with a town after it, a street with a number, or a postal code and another word."""
        code = self.lowered.rlike(r"\b\d{5}\b")
        town = self.lowered.rlike(r"\b\d{5}\s+[a-zäöüß][a-zäöüß\-\s]{2,}\b")
        return town | (has(self.in_value, "street") & self.lowered.rlike(r"\b\d+[a-z]?\b")) | (code & (self.words >= 2))

    @property
    def label(self) -> Column:
        return (self.value == "") | self.lowered.isin(*LABELS) | (F.length(self.value) <= 2) & ~self.value.rlike(r"^\d+$")

    @property
    def other_party(self) -> Column:
        return has(self.in_context, *OTHER_PARTY)

    @property
    def organization(self) -> Column:
        return self.other_party | has(self.in_value, "organization")

    def personal(self, field: Column) -> Column:
        """Something that speaks for a person: a name by its shape or beside a birth date, a date of birth, a real address."""
        shaped = self.value.rlike(r"^[A-ZÄÖÜ][a-zäöüß]+(?:[-\s][A-ZÄÖÜ][a-zäöüß]+){0,3}$")
        name = field.isin(*FIELDS["name"]) & (has(self.in_context, "birth") | shaped)
        return name | ((field == "date_of_birth") & looks_like_date(self.value)) | (field.isin(*FIELDS["address"]) & self.address)

    def contact_of_others(self, field: Column) -> Column:
        mail = field.isin("email", "contact_email") & has(self.in_value, "office_mail", "organization")
        return field.isin(*FIELDS["contact"]) & (self.other_party | (field.isin(*FIELDS["phone"]) & has(self.in_context, "phone_noise")) | mail)

    def name_of_organization(self, field: Column) -> Column:
        street = self.lowered.rlike(r"\b[a-zäöüß]+straße\b|\b[a-zäöüß]+str\.\b|\b\d{5}\b")
        return field.isin(*FIELDS["name"]) & (has(self.in_value, "organization") | (self.other_party & (self.words >= 2)) | street)

    def iban_of_others(self, field: Column) -> Column:
        return field.isin("iban", "organization_iban") & (self.other_party | has(self.in_context, "payee"))

    def phone_noise(self, field: Column) -> Column:
        v, digits = self.value, F.length(F.regexp_replace(self.value, r"\D", ""))
        prefix = F.lit(False)
        for p in PHONE_PREFIXES:
            prefix = prefix | self.lowered.startswith(p)
        around = self.other_party | has(self.in_context, "phone_noise") | self.context.rlike(r"\bfax\b")
        shaped = v.rlike(r"\b\d{3,5}\s*/\s*\d{3,8}\b|\b\d{3,5}\s*-\s*\d{3,8}\s*-\s*\d{1,5}\b|^0\d{2,5}[-\s]\d{3,8}(?:[-\s]\d{1,5})?$")
        parts = v.rlike(r"\b\d{2,5}[-\s]\d{3,8}(?:[-\s]\d{1,5})?\b") & ~self.lowered.rlike(r"^(?:\+49|0049|01)")
        return field.isin(*FIELDS["phone"]) & ((digits < 10) | (digits > 16) | prefix | (field == "fax") | around | shaped | parts)

    def reference_noise(self, field: Column) -> Column:
        around = has(self.in_context, "form", "authority", "health", "tax", "bank")
        shaped = self.lowered.rlike(r"(?U)^[\W_]+$|^[a-zäöüß\s\-]{4,}$")
        return field.isin(*FIELDS["reference"]) & ((F.length(self.value) <= 3) | has(self.in_value, "reference_noise") | around | shaped)

    def weak_noise(self, field: Column) -> Column:
        return field.isin(*FIELDS["weak"]) & ((F.length(self.value) < 4) | self.lowered.isin(*WEAK_JUNK) | self.value.rlike(r"[@:/\\]"))

    def address_noise(self, field: Column) -> Column:
        return field.isin(*FIELDS["address"]) & ((F.length(self.value) < 8) | has(self.in_value, "address_junk") | ~self.address)

    def name_noise(self, field: Column) -> Column:
        titled = self.lowered.isin(*TITLES) | self.lowered.rlike(f"^(?:{'|'.join(TITLES)}) ")
        shaped = self.value.rlike(r"[-–—]$|\d|[&@:/\\|{}<>]") | (self.words >= 4)
        around = has(self.in_context, "name_noise", "authority") | (has(self.in_context, "business") & (field != "full_name"))
        return field.isin(*FIELDS["name"]) & ((self.value == "") | has(self.in_value, "name_noise") | shaped | titled | around)

    def junk(self, field: Column) -> Column:
        letters = self.value.rlike(r"^[-–—]*[a-zA-Z]{1,3}[-–—]*$") & ~field.isin("sex", "gender")
        weak = field.isin(*FIELDS["weak"]) & self.lowered.isin(*WEAK_JUNK)
        mail = self.value.contains("@") & ~field.isin("email", "contact_email")
        digits = field.isin("surname", "given_names", "first_name", "last_name") & self.value.rlike(r"\d")
        brackets = F.length(F.regexp_replace(self.value, r"[^(]", "")) != F.length(F.regexp_replace(self.value, "[^)]", ""))
        fragment = (F.length(self.value) >= 5) & ((self.words >= 8) & ~self.value.rlike(r"\d") | brackets | self.value.rlike("[|{}<>]") | self.lowered.rlike(r"\b[a-z]{1,2}\s+[a-z]{1,2}\s+[a-z]{1,2}\b"))
        return (F.length(self.value) <= 2) | self.lowered.isin(*JUNK) | self.value.rlike(r"(?U)^[\W_]+$") | letters | weak | mail | digits | has(self.in_value, "form_value") | fragment

    def form_noise(self, field: Column) -> Column:
        protected = field.isin(*FIELDS["protected"])
        long = (self.words >= 7) & ~self.address
        asks = self.lowered.rlike(r"(?U)\b(?:bitte|ankreuzen|ausfüllen|ausfuellen)\b")
        return ~(protected & self.personal(field)) & (has(self.in_value, "form_value") | (has(self.in_context, "form") & ~protected) | long | asks)

    def domain_noise(self, field: Column) -> Column:
        protected = field.isin(*FIELDS["protected"])
        of = lambda family, *fields: has(self.in_context, family) & field.isin(*fields)
        phone = field.isin(*FIELDS["phone"]) & has(self.in_context, "phone_noise", "authority", "health", "tax", "business")
        cases = ("name", "address", "reference", "number", "case_number")
        noise = (
            (has(self.in_context, "form") & ~protected)
            | of("health", *cases, "organization")
            | of("tax", *cases, "date", "document_date")
            | of("business", "address", "employer", "employee", "occupation", "job_title", "reference", "number")
            | of("bank", *cases)
            | of("authority", *cases)
            | phone
            | (field.isin(*FIELDS["reference"]) & self.other_party)
            | (field.isin("address", "name", "reference", "number") & has(self.in_value, *OTHER_PARTY))
        )
        return ~(protected & self.personal(field)) & noise


#: Families of date contexts in the order in which they decide, each with its field.
DATE_FAMILIES = (
    ("legal", "legal_reference_date"), ("payment", "payment_due_date"), ("birth", "date_of_birth"), ("issue", "issue_date"), ("expiry", "expiry_date"),
    ("enrollment", "enrollment_date"), ("appointment", "appointment_date"), ("coverage_start", "coverage_start_date"), ("coverage_end", "coverage_end_date"),
    ("employment_start", "employment_start_date"), ("employment_end", "employment_end_date"), ("contract_start", "contract_start_date"), ("contract_end", "contract_end_date"),
    ("invoice", "invoice_date"), ("decision", "decision_date"), ("tax", "document_date"), ("document", "document_date"),
)
#: Field names that stand for a date field when nothing around the date tells.
DATE_NAMES = (
    ("date_of_birth", ("birth_date", "date_of_birth")),
    ("expiry_date", ("expiration_date", "expiry_date", "valid_until", "valid_to")),
    ("issue_date", ("issue_date", "date_of_issue", "issued_date")),
    ("payment_due_date", ("payment_due_date", "due_date")),
    ("enrollment_date", ("enrollment_date", "registration_date", "start_date")),
    ("document_date", ("document_date", "letter_date")),
    ("legal_reference_date", ("legal_reference_date",)),
)


def date_rules(s: Signals, field: Column, target: Column, day: Column, as_of: Column) -> list[Rule]:
    """A named identity date, then what stands around it, then the field's own name, then the date itself against ``as_of``."""
    years, year = whole_years(day, as_of), F.year(day)
    birth = has(s.in_context, "birth", "identity_document")
    return [
        ("named", target.isin("date_of_birth", "date_of_issue", "date_of_expiry"), target),
        *[(f"near_{family}", has(s.in_context, family), F.lit(name)) for family, name in DATE_FAMILIES],
        ("target_date", target.isin("date", "date_value"), F.lit("date")),
        ("target", target.isin(*FIELDS["date"]), target),
        *[(f"called_{name}", field.isin(*names), F.lit(name)) for name, names in DATE_NAMES],
        ("no_such_day", day.isNull(), F.lit("date")),
        ("far_ahead", (day > as_of) & (year >= F.year(as_of) + 2), F.lit("expiry_date")),
        ("ahead", day > as_of, F.lit("document_date")),
        ("birth_years", years.between(16, 120) & birth, F.lit("date_of_birth")),
        ("past_years", years.between(16, 120), F.lit("date")),
        ("recent", year.between(F.year(as_of) - 5, F.year(as_of)), F.lit("document_date")),
        ("date", F.lit(True), F.lit("date")),
    ]


def field_rules(s: Signals, field: Column) -> list[Rule]:
    """For candidates that are no dates: other parties' contacts, names, accounts, addresses and numbers, then the subject around it."""
    unprotected = ~field.isin(*FIELDS["protected"])
    address, reference, phone = (field.isin(*FIELDS[k]) for k in ("address", "reference", "phone"))
    return [
        ("contact_email", (field == "email") & s.contact_of_others(field), F.lit("contact_email")),
        ("contact_phone", phone & s.contact_of_others(field), F.lit("contact_phone")),
        ("phone_noise", s.phone_noise(field), F.lit("contact_phone")),
        ("organization_name", s.name_of_organization(field), F.lit("organization_name")),
        ("organization_iban", (field == "iban") & s.iban_of_others(field), F.lit("organization_iban")),
        ("organization_address", address & s.organization, F.lit("organization_address")),
        ("organization_reference", reference & s.organization, F.lit("organization_reference")),
        ("reference_noise", s.reference_noise(field), F.lit("reference_noise")),
        ("health", has(s.in_context, "health") & unprotected, F.lit("health_reference")),
        ("tax", has(s.in_context, "tax") & unprotected, F.lit("tax_reference")),
        ("business", has(s.in_context, "business") & unprotected, F.lit("business_reference")),
        ("bank", has(s.in_context, "bank") & ~field.isin("iban", "organization_iban"), F.lit("bank_reference")),
        ("authority", has(s.in_context, "authority") & unprotected, F.lit("public_authority_reference")),
        ("form", has(s.in_context, "form") & unprotected, F.lit("form_instruction")),
        ("own", F.lit(True), field),
    ]


def fact_rules(s: Signals, field: Column, fact_type: Column, stage: Column, metadata: Column) -> list[Rule]:
    """Whether a candidate becomes a fact (result true) or stays evidence, by its resolved field.

    A field from ``field_rules`` is never rejected by contact, organization_name, iban, phone and reference: what they would reject
    has the field of another party by then. They count for fields that were set in another way.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    model = (metadata["source"] == "llm_extraction_structurer") | F.lower(stage).contains("llm_structured")
    review = known(model) & ~known(metadata["auto_accept"] == "true") & ~s.label & (field.isin(*FIELDS["model_review"]) | F.lower(F.trim(fact_type)).isin(*FIELDS["model_review"]))
    no = F.lit(False)
    return [
        ("model_review", review, F.lit(True)),
        ("evidence_type", fact_type.isin(*FIELDS["evidence_only"]), no),
        ("evidence_field", field.isin(*FIELDS["evidence_only"]), no),
        ("review_type", fact_type.isin(*FIELDS["review_only"]), no),
        ("document_label", known(metadata["role"] == "document_label"), no),
        ("not_of_person", known(metadata["is_person_fact"] == "false"), no),
        ("stored_as_evidence", known(metadata["store_as_knowledge_evidence"] == "true"), no),
        ("label", s.label, no),
        ("junk", s.junk(field), no),
        ("contact", s.contact_of_others(field), no),
        ("organization_name", s.name_of_organization(field), no),
        ("iban", s.iban_of_others(field), no),
        ("weak", s.weak_noise(field), no),
        ("address", s.address_noise(field), no),
        ("phone", s.phone_noise(field), no),
        ("reference", s.reference_noise(field), no),
        ("form_value", s.form_noise(field), no),
        ("name", s.name_noise(field), no),
        ("domain", s.domain_noise(field), no),
        ("kept", F.lit(True), F.lit(True)),
    ]


def first_rule(rules: list[Rule]) -> Column:
    """struct(number, name, result) of the first rule whose condition holds; rules are numbered from 1."""
    out = None
    for n, (name, holds, result) in enumerate(rules, 1):
        said = F.struct(F.lit(n).alias("number"), F.lit(name).alias("name"), result.alias("result"))
        out = F.when(holds, said) if out is None else out.when(holds, said)
    return out


def held(rows: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """The columns ``kept`` of rows and further ones, worked out once each: the optimizer doesn't write them out again where later columns or filters use them.

    A select with a lambda in it, here one over an array of one, is generated in pieces instead of as part of one method for the whole
    stage, which would be too long for the JVM to compile; what stands inside of a lambda isn't generated at all. The columns therefore
    stand beside the lambda, as a struct that is unpacked as often as that array is long.
    """
    beside = rows.select(*kept, F.struct(*[c.alias(name) for name, c in columns.items()]).alias("__held"), F.transform(F.array(F.lit(0)), lambda x: x).alias("__once"))
    return beside.select(*kept, F.inline(F.array_repeat("__held", F.size("__once"))))


def decide(candidates: DataFrame, as_of: Column) -> DataFrame:
    """Adds field_name, field_rule, date_rule (null for other candidates), is_fact, fact_rule and reject_reason (null for facts).

    Needs fact_type, raw_value, normalized_value, source_stage (strings) and metadata (map of strings, its flags 'true' and
    'false'). Null values count as empty ones and null metadata as none; rows are decided one by one, so repeated rows come out alike, and an
    empty table gives no rows. Columns of the same names as the new ones are replaced. ``as_of`` is today's date.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    value = squeezed(text("normalized_value"))
    target = F.lower(F.trim(F.coalesce(metadata["target_field"], F.lit(""))))
    field = F.when(F.coalesce(metadata["target_field"], F.lit("")) != "", target).otherwise(F.lower(F.trim(text("fact_type"))))
    context = context_text(text("fact_type"), text("raw_value"), text("normalized_value"), text("source_stage"), metadata)
    new = ("field_name", "field_rule", "date_rule", "is_fact", "fact_rule", "reject_reason")
    dated = field.isin(*FIELDS["date"]) | F.lower(F.trim(text("fact_type"))).isin(*FIELDS["date"]) | looks_like_date(text("normalized_value"))
    # only dates are read for days, and a raw value that is the normalized one isn't read again
    day = F.coalesce(knowledge_date(text("normalized_value")), F.when(text("raw_value") != text("normalized_value"), knowledge_date(text("raw_value"))))
    rows = candidates.drop(*new)
    rows = held(rows, *rows.columns, __value=value, __lowered=F.lower(value), __context=context, __field=field, __target=target, __dated=dated, __day=F.when(dated, day))
    rows = rows.withColumns({"__in_value": hint_bits(F.col("__lowered")), "__in_context": hint_bits(F.col("__context"))})
    s = Signals(F.col("__value"), F.col("__lowered"), F.col("__context"), F.col("__in_value"), F.col("__in_context"))
    by_date = first_rule(date_rules(s, F.col("__field"), F.col("__target"), F.col("__day"), as_of))
    rows = held(rows, *rows.columns, __rule=F.when(F.col("__dated"), by_date).otherwise(first_rule(field_rules(s, F.col("__field")))))
    rows = rows.withColumn("field_name", F.col("__rule.result"))
    rows = held(rows, *rows.columns, __fact=first_rule(fact_rules(s, F.col("field_name"), text("fact_type"), text("source_stage"), metadata)))
    own = F.when(~F.col("__dated"), F.col("__rule.name")).otherwise("date")
    made = {"field_rule": own, "date_rule": F.when(F.col("__dated"), F.col("__rule.name")), "is_fact": F.col("__fact.result"), "fact_rule": F.col("__fact.number"), "reject_reason": F.when(~F.col("__fact.result"), F.col("__fact.name"))}
    return rows.withColumns(made).drop("__value", "__lowered", "__context", "__field", "__target", "__dated", "__day", "__in_value", "__in_context", "__rule", "__fact")
