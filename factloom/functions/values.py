"""Dates, amounts and identifiers as column expressions; nothing raises on bad input."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """ISO, d.m.Y, d-m-Y, d/m/Y, d.m.yy, d-m-yy or YYMMDD; two-digit years up to 30 are 20yy. Null if none."""
    t = F.trim(c)

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(t, pattern, k)

    def century(yy: Column) -> Column:
        return F.concat(F.when(yy.try_cast("int") <= 30, "20").otherwise("19"), yy)

    long, short, iso, six = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", r"^(\d{1,2})[.-](\d{1,2})[.-](\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{2})(\d{2})(\d{2})$"
    return (
        F.when(t.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(long), made(part(long, 3), part(long, 2), part(long, 1)))
        .when(t.rlike(short), made(century(part(short, 3)), part(short, 2), part(short, 1)))
        .when(t.rlike(six), made(century(part(six, 1)), part(six, 2), part(six, 3)))
    )


def parse_german_number(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d{1,3}(\.\d{3})*(,\d+)?$|^[+-]?\d+(,\d+)?$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))


def normalize_amount(c: Column) -> Column:
    """German or US grouping by shape, two decimals; as it is if it can't be read."""
    t = F.regexp_replace(c, r"[^0-9.,+-]", "")
    plain = F.when(t.rlike(r"\d\.\d{3},"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(t.rlike(r"\d,\d{3}\."), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    number = plain.try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.2f", number)).otherwise(c)


def currency(c: Column) -> Column:
    """ISO code of the first currency sign or name."""
    found = F.lower(F.regexp_extract(c, r"(?i)(€|EUR|euro|CHF|USD|\$|£|GBP)", 1))
    return F.when(found.isin("€", "eur", "euro"), "EUR").when(found == "chf", "CHF").when(found.isin("usd", "$"), "USD").when(found.isin("£", "gbp"), "GBP")


def _digits(c: Column) -> Column:
    """Letters to 10..35, digits as they are."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55))


def iban_valid(c: Column) -> Column:
    """The shape, and the rest of 97 of the rearranged number being 1."""
    t = F.upper(F.regexp_replace(c, r"\s+", ""))
    turned = F.concat(F.substring(t, 5, 64), F.substring(t, 1, 4))
    rest = F.aggregate(_digits(turned), F.lit(0), lambda m, d: F.when(d > 9, (m * 100 + d) % 97).otherwise((m * 10 + d) % 97))
    return F.coalesce(t.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def bic_valid(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike(r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"), F.lit(False))


def mrz_digit(c: Column) -> Column:
    """Check digit: weights 7, 3, 1, the filler 0, letters from 10."""
    values = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: F.when(x == "<", 0).when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55))
    weighed = F.transform(values, lambda v, i: v * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1))
    return F.aggregate(weighed, F.lit(0), lambda s, v: s + v) % 10


def phone_valid(c: Column) -> Column:
    """International prefix, 9 to 16 digits, more than two different ones, not like a date or a decimal."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.trim(c).rlike(r"^(\+|00)") & F.length(digits).between(9, 16) & (F.size(F.array_distinct(F.split(digits, ""))) > 2) & ~c.rlike(r"\d{1,2}\.\d{1,2}\.\d{2,4}") & ~c.rlike(r"\d\.\d")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC of a string column, by two nested hashes."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


#: The least and largest plausible amount of a fact type.
AMOUNT_BOUNDS = {
    "opening_balance": (-10_000_000.0, 10_000_000.0),
    "closing_balance": (-10_000_000.0, 10_000_000.0),
    "total_credits": (0.0, 10_000_000.0),
    "total_debits": (0.0, 10_000_000.0),
    "subtotal": (0.0, 10_000_000.0),
    "vat_amount": (0.0, 2_000_000.0),
    "total_amount": (0.0, 10_000_000.0),
    "gross_salary": (100.0, 50_000.0),
    "annual_gross_salary": (1_200.0, 600_000.0),
    "net_salary": (100.0, 40_000.0),
    "annual_net_salary": (1_200.0, 480_000.0),
    "bonus": (1.0, 100_000.0),
    "income_tax": (0.0, 20_000.0),
    "solidarity_surcharge": (0.0, 1_000.0),
    "church_tax": (0.0, 2_000.0),
    "health_insurance": (0.0, 2_000.0),
    "pension_contribution": (0.0, 2_000.0),
    "unemployment_insurance": (0.0, 500.0),
    "care_insurance": (0.0, 500.0),
}


def amount_check(fact_type: Column, amount: Column) -> Column:
    """struct(ok, confidence): whether the amount lies in its type's bounds; types without bounds pass."""
    low, high = (F.create_map(*[F.lit(x) for k, b in AMOUNT_BOUNDS.items() for x in (k, b[i])])[fact_type] for i in (0, 1))
    ok = low.isNull() | F.coalesce(amount.try_cast("double").between(low, high), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, 0.90).otherwise(0.55).alias("confidence"))


def balance_sign(c: Column) -> Column:
    """debit or credit, by a sign at either end or a lone S or H."""
    t = F.trim(c)
    return F.when(t.startswith("-") | t.endswith("-") | t.rlike(r"\bS\b"), "debit").when(t.startswith("+") | t.endswith("+") | t.rlike(r"\bH\b"), "credit")


def social_security_valid(c: Column) -> Column:
    return F.coalesce(F.upper(F.regexp_replace(c, r"\s+", "")).rlike(r"^(?:\d{2}[0-3]\d[01]\d[A-Z]\d{3}|[A-Z]\d{8}[A-Z]\d{2})$"), F.lit(False))


def human_name(c: Column) -> Column:
    """At least two capitalised words."""
    word = "[A-ZÄÖÜ][a-zäöüß]+"
    return F.coalesce(F.trim(c).rlike(rf"^{word}(?:[\s-]{word})+$"), F.lit(False))


def recover_json(c: Column) -> Column:
    """A JSON object out of a model's answer: without code fences, as a whole or from the first to the last brace; else {}."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    is_object = lambda x: F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{")
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when(is_object(plain), plain).when(F.try_parse_json(plain).isNull() & is_object(inner), inner).otherwise("{}")
