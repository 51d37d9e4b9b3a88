"""Dates of documents and of stored facts, and keys by which facts are held to be the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months.
MONTHS = {
    "01": ("januar", "january", "jan"),
    "02": ("februar", "february", "feb"),
    "03": ("märz", "maerz", "mrz", "march", "mar"),
    "04": ("april", "apr"),
    "05": ("mai", "may"),
    "06": ("juni", "june", "jun"),
    "07": ("juli", "july", "jul"),
    "08": ("august", "aug"),
    "09": ("september", "sept", "sep"),
    "10": ("oktober", "october", "okt", "oct"),
    "11": ("november", "nov"),
    "12": ("dezember", "december", "dez", "dec"),
}
#: Field names that mean the same fact.
SAME_FIELD = {
    "date_of_birth": ("date", "birth_date", "date_birth", "dob"),
    "expiry_date": ("expiry", "expiration_date", "valid_until", "valid_to"),
    "issue_date": ("issue", "issued_date", "date_of_issue"),
    "given_names": ("given_name", "first_name", "firstname", "forename"),
    "surname": ("last_name", "lastname", "family_name"),
    "email": ("email_address", "e-mail", "mail"),
    "phone_number": ("phone", "telephone", "mobile", "mobile_number"),
}


def _full_year(y: Column) -> Column:
    """Two digits: up to 30 are 20yy, else 19yy."""
    return F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") > 30, "19").otherwise("20"), y)).otherwise(F.lpad(y, 4, "0"))


def date_key(c: Column) -> Column:
    """yyyy-MM-dd of d.m.y, y.m.d, eight digits (year first if that is a likely year) or six (DDMMYY);
    anything else in lower case. The day need not exist."""
    t = F.lower(F.trim(c))
    digits = F.regexp_replace(t, "[^0-9]", "")
    day_first, year_first = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$", r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})$"

    def shaped(regex: str, y: int, m: int, d: int) -> Column:
        return F.concat_ws("-", _full_year(F.regexp_extract(t, regex, y)), F.lpad(F.regexp_extract(t, regex, m), 2, "0"), F.lpad(F.regexp_extract(t, regex, d), 2, "0"))

    def cut(*parts: tuple[int, int]) -> Column:
        return F.concat_ws("-", *[_full_year(F.substring(digits, a, n)) if i == 0 else F.substring(digits, a, n) for i, (a, n) in enumerate(parts)])

    return (
        F.when(t.rlike(day_first), shaped(day_first, 3, 2, 1))
        .when(t.rlike(year_first), shaped(year_first, 1, 2, 3))
        .when((F.length(digits) == 8) & F.substring(digits, 1, 4).try_cast("int").between(1900, 2100), cut((1, 4), (5, 2), (7, 2)))
        .when(F.length(digits) == 8, cut((5, 4), (3, 2), (1, 2)))
        .when(F.length(digits) == 6, cut((5, 2), (3, 2), (1, 2)))
        .otherwise(t)
    )


def knowledge_date(c: Column) -> Column:
    """The date of such a key; null if there is no such day.

    The key itself isn't made: a text of that shape is put into the order year, month, day, each pattern leaving the others' texts alone.
    """
    t = F.trim(c)
    digits = F.regexp_replace(t, "[^0-9]", "")
    start, whole = r"^(\d{1,2})[./-](\d{1,2})[./-]", t
    for year, before in ((r"\d{4}", ""), (r"3[1-9]|[4-9]\d", "19"), (r"\d{2}", "20"), (r"\d{3}", "0")):
        whole = F.regexp_replace(whole, f"{start}({year})$", f"{before}$3-$2-$1")
    whole = F.regexp_extract(F.translate(whole, "./", "--"), r"^(\d{4}-\d{1,2}-\d{1,2})$", 1)
    cut = lambda year, month, day: F.concat(F.substring(digits, year, 4), F.lit("-"), F.substring(digits, month, 2), F.lit("-"), F.substring(digits, day, 2))
    short = F.concat(F.when(F.substring(digits, 5, 2) > "30", "19").otherwise("20"), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 1, 2))
    text = (
        F.when(t.rlike(r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})$"), whole)
        .when((F.length(digits) == 8) & F.substring(digits, 1, 4).between("1900", "2100"), cut(1, 5, 7))
        .when(F.length(digits) == 8, cut(5, 3, 1))
        .when(F.length(digits) == 6, short)
    )
    return text.try_cast("date")


def field_key(c: Column) -> Column:
    """Field name in lower case, and one name for those of the same meaning."""
    name = F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    out = name
    for key, names in SAME_FIELD.items():
        out = F.when(name.isin(*names), key).otherwise(out)
    return out


def value_key(field: Column, c: Column) -> Column:
    """A value as it is compared with stored ones; ``field`` is a key of field_key."""
    text = F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    phone = F.concat(F.when(text.startswith("+"), "+").otherwise(""), F.regexp_replace(text, "[^0-9]", ""))
    return F.when(field == "phone_number", phone).when(field == "email", F.replace(text, F.lit(" "), F.lit(""))).when(field.isin("date_of_birth", "issue_date", "expiry_date"), date_key(text)).otherwise(text)


def german_date(c: Column) -> Column:
    """yyyy-MM-dd of a leading d.m.yyyy, or of a day, a month's name and a year anywhere; null if none."""
    t = F.lower(F.trim(c))
    number = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b"
    out = F.when(t.rlike(number), F.concat_ws("-", F.regexp_extract(t, number, 3), F.lpad(F.regexp_extract(t, number, 2), 2, "0"), F.lpad(F.regexp_extract(t, number, 1), 2, "0")))
    for month, names in MONTHS.items():
        word = rf"\b(\d{{1,2}})\s*\.?\s*(?:{'|'.join(names)})\s*\.?\s*(\d{{4}})\b"
        out = out.when(t.rlike(word), F.concat_ws("-", F.regexp_extract(t, word, 2), F.lit(month), F.lpad(F.regexp_extract(t, word, 1), 2, "0")))
    return out


def pay_month(c: Column) -> Column:
    """struct(day, resolution) of a full date, m.yyyy, or a month's name and a year; null if none."""
    t = F.lower(F.trim(c))
    full, short, word = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", r"^(\d{1,2})[./-](\d{4})$", r"(?U)^(\w+)\s+(\d{4})$"
    made = lambda y, m, d, how: F.struct(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).alias("day"), F.lit(how).alias("resolution"))
    name, month = F.regexp_extract(t, word, 1), F.lit(None).cast("string")
    for number, names in MONTHS.items():
        month = F.when(name.isin(*names), number).otherwise(month)
    first = F.lit("1")
    return (
        F.when(t.rlike(full), made(F.regexp_extract(t, full, 3), F.regexp_extract(t, full, 2), F.regexp_extract(t, full, 1), "full_date"))
        .when(t.rlike(short), made(F.regexp_extract(t, short, 2), F.regexp_extract(t, short, 1), first, "numeric_month_start"))
        .when(t.rlike(word) & month.isNotNull(), made(F.regexp_extract(t, word, 2), month, first, "month_start_inferred"))
    )


def whole_years(start: Column, end: Column) -> Column:
    return F.floor(F.months_between(F.trunc(end, "month"), F.trunc(start, "month")) / 12 - F.when((F.month(start) == F.month(end)) & (F.day(end) < F.day(start)), 1).otherwise(0)).cast("int")


def birth_date_ok(day: Column, as_of: Column) -> Column:
    """In the past, 120 years ago at most."""
    return F.coalesce((day < as_of) & (whole_years(day, as_of) <= 120), F.lit(False))


def expiry_date_ok(day: Column, as_of: Column) -> Column:
    """In the future, in 30 years at most."""
    return F.coalesce((day > as_of) & (day <= F.add_months(as_of, 360)), F.lit(False))


def utc_time(c: Column) -> Column:
    """The instant of an ISO 8601 text, in UTC where it names no zone; null for blank and other texts."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))


def utc_text(c: Column) -> Column:
    """An instant as yyyy-mm-ddThh:mm:ss.ffffffZ; the session's zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000.0


def is_expired(c: Column, now: Column, seconds: Column) -> Column:
    """Whether an instant is at least so many seconds old."""
    return seconds_between(c, now) >= seconds
