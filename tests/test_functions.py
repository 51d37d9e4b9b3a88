import datetime
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given,want", [("31.12.1999", datetime.date(1999, 12, 31)), ("2001-02-03", datetime.date(2001, 2, 3)), ("1/2/2003", datetime.date(2003, 2, 1)), ("5-6-07", datetime.date(2007, 6, 5)), ("5.6.31", datetime.date(1931, 6, 5)), ("740812", datetime.date(1974, 8, 12)), ("31.02.2001", None), ("x", None), (None, None)])
def test_parse_date(spark, given, want):
    assert one(spark, V.parse_date(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize("given,want", [("1.234,56", 1234.56), ("12", 12.0), ("1,2,3", None), ("", None)])
def test_parse_german_number(spark, given, want):
    assert one(spark, V.parse_german_number(F.lit(given))) == want


@pytest.mark.parametrize("given,want", [("1.234,56 EUR", "1234.56"), ("$1,234.50", "1234.50"), ("7,5", "7.50"), ("n/a", "n/a")])
def test_normalize_amount(spark, given, want):
    assert one(spark, V.normalize_amount(F.lit(given))) == want


@pytest.mark.parametrize("given,want", [("DE89 3704 0044 0532 0130 00", True), ("DE89370400440532013001", False), ("GB82WEST12345698765432", True), ("", False), (None, False)])
def test_iban(spark, given, want):
    assert one(spark, V.iban_valid(F.lit(given).cast("string"))) is want


@pytest.mark.parametrize("given,want", [("L898902C3", 6), ("740812", 2), ("120415", 9), ("<<<", 0)])
def test_mrz_digit(spark, given, want):
    assert one(spark, V.mrz_digit(F.lit(given))) == want


@pytest.mark.parametrize("given,want", [("+49 170 1234567", True), ("0170 1234567", False), ("+49 11111111", True), ("+1111111111", False)])
def test_phone(spark, given, want):
    assert one(spark, V.phone_valid(F.lit(given))) is want


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_hmac(spark, key):
    assert one(spark, V.hmac_sha256(key, F.lit("päyload"))) == hmac.new(key, "päyload".encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("a,b,want", [("abc", "ABC", 1.0), ("", "x", 0.0), ("abcd", "abxd", 0.75), ("kitten", "sitting", 2 * 4 / 13)])
def test_lcs_ratio(spark, a, b, want):
    assert abs(one(spark, T.lcs_ratio(F.lit(a), F.lit(b))) - want) < 1e-12


def test_text(spark):
    assert one(spark, T.normalize_key(F.lit(" Birth-Date  of__X "))) == "birth_date_of_x"
    assert one(spark, T.normalize_text(F.lit("Größe: [Ä]"))) == "groesse ae"
    assert one(spark, T.clean_lines(F.lit("a  b\r\n\nsee http://x\n c "))) == ["a b", "c"]


def test_lcs_by_bits_is_the_table(spark):
    r = random.Random(1)

    def table(a, b):
        before = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
            before = row
        return before[-1]

    pairs = [("", ""), ("a", ""), ("Ab", "aB"), (None, "a"), ("xxa", "yya")] + [("".join(r.choice("ab cÄ") for _ in range(r.randrange(40))), "".join(r.choice("ab cÄ") for _ in range(r.randrange(40)))) for _ in range(200)] + [("ab" * 300, "ba" * 290)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", T.lcs_ratio(F.col("a"), F.col("b")).alias("v")).collect()
    for row in got:
        a, b = pairs[row["i"]]
        want = None if a is None else 1.0 if a.lower() == b.lower() else 0.0 if not a or not b else 2 * table(a.lower(), b.lower()) / (len(a) + len(b))
        assert row["v"] == want
