"""Machine-readable zones of travel documents, read with tolerance for bad OCR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Lines and characters of each kind of zone.
KINDS = {"TD1": (3, 30), "TD2": (2, 36), "TD3": (2, 44)}
#: Codes of documents, and what OCR takes for digits and for letters.
CODES = ("P", "I", "ID", "A", "C", "V")
AS_DIGITS, AS_LETTERS = ("OoIilBSsGZQ", "00111855620"), ("01", "OI")
#: What characters count in a check digit, from 0.
VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Pairs of characters that OCR takes for each other, one way and the other.
CONFUSED = ("0O", "O0", "1I", "I1", "8B", "B8", "5S", "S5", "6G", "G6", "2Z", "Z2", "0Q", "Q0")
#: Where fields stand, as (line, first, end) from 0, for the kinds of zone.
FIELDS = {
    "TD1": {"document_number": (0, 5, 14), "optional_1": (0, 15, 30), "date_of_birth": (1, 0, 6), "sex": (1, 7, 8), "expiry_date": (1, 8, 14), "nationality": (1, 15, 18), "optional_2": (1, 18, 29), "names": (2, 0, 30)},
    "TD2": {"document_number": (1, 0, 9), "nationality": (1, 10, 13), "date_of_birth": (1, 13, 19), "sex": (1, 20, 21), "expiry_date": (1, 21, 27), "optional_1": (1, 28, 35), "names": (0, 5, 36)},
    "TD3": {"document_number": (1, 0, 9), "nationality": (1, 10, 13), "date_of_birth": (1, 13, 19), "sex": (1, 20, 21), "expiry_date": (1, 21, 27), "personal_number": (1, 28, 42), "names": (0, 5, 44)},
}
#: What each check digit covers, and where it stands.
CHECKS = {
    "TD1": (("document_number", ((0, 5, 14),), (0, 14)), ("date_of_birth", ((1, 0, 6),), (1, 6)), ("expiry_date", ((1, 8, 14),), (1, 14)), ("composite", ((0, 5, 30), (1, 0, 7), (1, 8, 29)), (1, 29))),
    "TD2": (("document_number", ((1, 0, 9),), (1, 9)), ("date_of_birth", ((1, 13, 19),), (1, 19)), ("expiry_date", ((1, 21, 27),), (1, 27)), ("composite", ((1, 0, 10), (1, 13, 20), (1, 21, 35)), (1, 35))),
    "TD3": (("document_number", ((1, 0, 9),), (1, 9)), ("date_of_birth", ((1, 13, 19),), (1, 19)), ("expiry_date", ((1, 21, 27),), (1, 27)), ("personal_number", ((1, 28, 42),), (1, 42)), ("composite", ((1, 0, 10), (1, 13, 20), (1, 21, 43)), (1, 43))),
}
TEXT_FIELDS = ("document_code", "issuing_country", "surname", "given_names", "document_number", "nationality", "date_of_birth", "sex", "expiry_date", "personal_number", "optional_1", "optional_2")


def check_digit(c: Column) -> Column:
    """Weights 7, 3, 1; letters from 10, the filler and anything else 0."""
    value = lambda x: F.greatest(F.position(x, F.lit(VALUES)) - 1, F.lit(0))
    return F.aggregate(F.transform(F.split(c, ""), lambda x, i: value(x) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3 + 1)), F.lit(0), lambda s, v: s + v) % 10


def lines_of(text: Column) -> Column:
    """The lines that may belong to a zone: two or more of 15 to 44 of its characters; else with them those of 25 characters or more, three
    letters or digits in a row and a filler in twenty. Fewer than two in all are none."""
    # white space of all widths and .,; go from the whole text at once; only breaks of lines stay
    packed = F.regexp_replace(text, r"[.,;\t\p{Zs}]+", "")
    clean = F.transform(F.split(packed, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1), F.upper)
    good = lambda x: x.rlike("^[A-Z0-9<]{15,44}$")
    fillers = lambda x: F.length(F.regexp_replace(x, "[^<]", ""))
    relaxed = lambda x: ~good(x) & (F.length(x) >= 25) & x.rlike("[A-Z0-9]{3}") & (fillers(x) * 20 >= F.length(x))
    none = F.array().cast("array<string>")

    def admitted(ls: Column) -> Column:
        def joined(strict: Column) -> Column:
            more = T.once(F.filter(ls, relaxed), lambda found: F.when(F.size(strict) + F.size(found) >= 2, F.concat(strict, found)).otherwise(none))
            return F.when(F.size(strict) >= 2, strict).otherwise(more)

        return T.once(F.filter(ls, good), joined)

    return T.once(clean, admitted)


def kind_of(lines: Column, nearest: bool = True) -> Column:
    """The kind whose number of lines it is, each of three quarters of its length, with a document code; null if none.

    Two lines that are long enough for a passport are long enough for a card too. With ``nearest`` the longer line decides, from 40
    characters on for the passport; without it they are a card.
    """
    head = F.translate(F.substring(F.get(lines, F.lit(0)), 1, 2), *AS_LETTERS)
    coded = head.isin(*CODES) | F.substring(head, 1, 1).isin(*CODES)

    def of(lengths: Column) -> Column:
        fits = {kind: (F.size(lengths) == n) & (F.array_min(lengths) >= width * 3 // 4) for kind, (n, width) in KINDS.items()}
        passport = fits["TD3"] & (F.array_max(lengths) >= 40) if nearest else F.lit(False)
        return F.when(fits["TD1"], "TD1").when(passport, "TD3").when(fits["TD2"], "TD2")

    return F.when(coded, T.once(F.transform(lines, lambda x: F.length(x)), of))


def swaps(value: Column, digit: Column) -> Column:
    """Values with one character taken for another that OCR confuses with it, whose check digit is right."""
    n = F.length(value)

    def at(i: Column) -> Column:
        ch = F.substring(value, i, F.lit(1))
        made = [F.when(ch == a, F.concat(F.substring(value, F.lit(1), i - 1), F.lit(b), F.substring(value, i + 1, n))) for a, b in CONFUSED]
        return F.array_compact(F.array(*made))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(1), n), at)), lambda v: check_digit(v).cast("string") == digit)


def _cut(kind: str, lines: Column) -> Column:
    """What stands where in a zone of that kind, as it is; every kind gives the same struct."""
    n, width = KINDS[kind]
    padded = F.transform(lines, lambda x: F.rpad(F.substring(F.upper(x), 1, width), width, "<"))

    def made(ls: Column) -> Column:
        cut = lambda line, a, b: F.substring(F.get(ls, F.lit(line)), a + 1, b - a)
        fields = {"document_code": (0, 0, 2), "issuing_country": (0, 2, 5), **FIELDS[kind]}
        names = ("document_code", "issuing_country", "names", "document_number", "nationality", "date_of_birth", "sex", "expiry_date", "personal_number", "optional_1", "optional_2")
        checks = F.array(*[F.struct(F.lit(name).alias("name"), F.concat(*[cut(*part) for part in parts]).alias("covered"), cut(line, i, i + 1).alias("digit")) for name, parts, (line, i) in CHECKS[kind]])
        return F.struct(F.lit(kind).alias("kind"), ls.alias("lines"), checks.alias("checks"), *[(cut(*fields[k]) if k in fields else F.lit(None).cast("string")).alias(k) for k in names])

    return T.once(padded, made)


def parse(lines: Column, nearest: bool = True, repair: bool = True) -> Column:
    """A zone's struct: kind, lines, TEXT_FIELDS, checks (name, ok), n_errors, confidence, status, check_ok, number_repaired; null if there is none.

    Lines are filled up or cut to the kind's length. Letters in dates are taken for digits, zero and one in countries and numbers
    for letters; check digits are those of what stands there. confidence is the share of right ones; VALID is a zone without any
    error (check digits, sex, days), then PARTIAL from a half on, OCR_CORRUPTED above 0, INVALID. number_repaired is
    the one document number with a right check digit among those that differ in one character that OCR confuses; null if the
    number's digit is right, or if none or several are, and always without ``repair``.
    """

    def chosen(kind: Column) -> Column:
        out = F.when(kind == "TD1", _cut("TD1", lines))
        return out.when(kind == "TD2", _cut("TD2", lines)).when(kind == "TD3", _cut("TD3", lines))

    def finished(r: Column) -> Column:
        spaced = lambda c: F.trim(F.translate(c, "<", " "))
        letters = lambda k: F.translate(r[k], *AS_LETTERS).alias(k)
        stripped = lambda k: F.btrim(r[k], F.lit("<")).alias(k)
        dates = [F.translate(r[k], *AS_DIGITS).alias(k) for k in ("date_of_birth", "expiry_date")]
        checked = F.transform(r["checks"], lambda c: F.struct(c["name"].alias("name"), (check_digit(c["covered"]).cast("string") == c["digit"]).alias("ok")))
        day = lambda c: ~c.rlike("^[0-9]{6}$") | F.try_to_date(F.concat(F.lit("20"), c), "yyyyMMdd").isNull()

        def counted(k: Column) -> Column:
            wrong = (~r["sex"].isin("M", "F", "X", "<")).cast("int") + day(k["date_of_birth"]).cast("int") + day(k["expiry_date"]).cast("int")
            return F.struct(k.alias("k"), F.size(F.filter(k["checks"], lambda c: c["ok"])).alias("right"), wrong.alias("wrong"))

        def told(t: Column) -> Column:
            k, right, cs = t["k"], t["right"], t["k"]["checks"]
            share, errors = F.round(right / F.size(cs), 4), F.size(cs) - right + t["wrong"]
            status = F.when(errors == 0, "VALID").when(share >= 0.5, "PARTIAL").when(share > 0, "OCR_CORRUPTED").otherwise("INVALID")
            fields = [
                F.rtrim(r["document_code"], F.lit("<")).alias("document_code"), letters("issuing_country"), spaced(k["names"][0]).alias("surname"), F.coalesce(spaced(F.get(k["names"], F.lit(1))), F.lit("")).alias("given_names"),
                letters("document_number"), letters("nationality"), k["date_of_birth"].alias("date_of_birth"), r["sex"].alias("sex"), k["expiry_date"].alias("expiry_date"), r["personal_number"].alias("personal_number"), stripped("optional_1"), stripped("optional_2"),
            ]
            repaired = F.when(~cs[0]["ok"], T.once(swaps(r["document_number"], r["checks"][0]["digit"]), lambda found: F.when(F.size(found) == 1, found[0]))) if repair else F.lit(None).cast("string")
            return F.struct(r["kind"].alias("kind"), r["lines"].alias("lines"), *fields, cs.alias("checks"), errors.alias("n_errors"), share.alias("confidence"), status.alias("status"), (right == F.size(cs)).alias("check_ok"), repaired.alias("number_repaired"))

        return F.when(r.isNotNull(), T.once(T.once(F.struct(checked.alias("checks"), F.split(r["names"], "<<", 2).alias("names"), *dates), counted), told))

    return T.once(T.once(kind_of(lines, nearest), chosen), finished)


def fuzzy_text(text: Column) -> Column:
    """The text, headed by the first two of its lines that hold many fillers when all else is left out of them (44 characters each)."""
    compact = F.transform(F.split(text, r"\r\n|[\n\r]", -1), lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9<]", ""))
    zeros = F.transform(compact, lambda x: F.when(x.rlike("[0-9]"), F.replace(x, F.lit("O"), F.lit("0"))).otherwise(x))
    likely = F.filter(zeros, lambda x: (x.contains("<<") | (F.length(F.regexp_replace(x, "[^<]", "")) >= 4)) & F.length(x).between(30, 50))
    return T.once(F.slice(F.transform(likely, lambda x: F.rpad(F.substring(x, 1, 44), 44, "<")), 1, 2), lambda found: F.array_join(F.concat(found, F.array(text)), "\n"))


def read_text(text: Column, fuzzy: bool = False, nearest: bool = True, repair: bool = True) -> Column:
    """The zone of a whole text, as ``parse`` gives it; with ``fuzzy``, where there is none, that of its fuzzy_text."""
    lines = lines_of(text)
    if fuzzy:
        lines = T.once(lines, lambda ls: F.when(kind_of(ls, nearest).isNotNull(), ls).otherwise(lines_of(fuzzy_text(text))))
    return T.once(lines, lambda ls: parse(ls, nearest, repair))


def add_zone(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the zone of a column's text or, where there is none, of its fuzzy_text, as ``read_text`` gives it but without number_repaired.

    Lines are columns of their own before they are parsed.
    """
    df = df.withColumn("__ls", lines_of(F.col(text)))
    df = df.withColumn("__ls", F.when(kind_of(F.col("__ls")).isNotNull(), F.col("__ls")).otherwise(lines_of(fuzzy_text(F.col(text)))))
    return df.withColumn(name, parse(F.col("__ls"), repair=False)).drop("__ls")
