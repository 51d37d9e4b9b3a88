"""Queries of scalar functions over strings made from the orders' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import labelled
from factloom.plans.catalog import query
from factloom.sources import tables as S

#: Strings in the SQL that Spark and DuckDB share; n is the order's number.
STRINGS = """
    SELECT o_orderkey AS n,
      concat(CAST(o_orderkey % 9 + 1 AS STRING), '.', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ',', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')) AS german,
      concat(CAST(o_orderkey % 9 + 1 AS STRING), ',', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')) AS english,
      concat(lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0'), '.', lpad(CAST(o_orderkey % 14 + 1 AS STRING), 2, '0'), '.', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')) AS short_date,
      lpad(CAST(o_orderkey * 7919 % 1000000007 AS STRING), 18, '3') AS bban, lpad(CAST(o_orderkey % 97 + 2 AS STRING), 2, '0') AS check_digits,
      CASE o_orderkey % 6 WHEN 0 THEN '-12,00' WHEN 1 THEN '12,00+' WHEN 2 THEN '12,00 S' WHEN 3 THEN 'H 12,00' WHEN 4 THEN '12,00' ELSE '' END AS signed,
      CASE o_orderkey % 7 WHEN 0 THEN '12 €' WHEN 1 THEN 'euro 5' WHEN 2 THEN 'CHF 3' WHEN 3 THEN '$4' WHEN 4 THEN '£9' WHEN 5 THEN 'gbp' ELSE 'none' END AS money,
      CASE o_orderkey % 8 WHEN 0 THEN 'Unbefristeter Vertrag' WHEN 1 THEN 'befristet' WHEN 2 THEN 'Part-time job' WHEN 3 THEN 'Vollzeit' WHEN 4 THEN 'geringfügig' WHEN 5 THEN 'Internship' WHEN 6 THEN 'freie Mitarbeiter' ELSE 'On  Call' END AS job,
      CASE o_orderkey % 5 WHEN 0 THEN 'pro Monat' WHEN 1 THEN 'jährlich' WHEN 2 THEN 'Weekly' WHEN 3 THEN 'je Stunde' ELSE 'per Sprint' END AS pay_every,
      CASE o_orderkey % 4 WHEN 0 THEN 'Max Muster' WHEN 1 THEN 'max muster' WHEN 2 THEN 'Max' ELSE 'Max 2 Muster' END AS person,
      concat('a  b', chr(9), 'c', chr(10), chr(10), chr(10), chr(10), CAST(o_orderkey AS STRING), ' ') AS loose
    FROM {orders}"""
STRINGS_SQL = STRINGS.replace("{orders}", "orders")


def _strings(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(STRINGS, orders=S.read(spark, d, "orders"))


@query("SELECT o_orderkey AS n, (o_orderkey % 9 + 1) * 1000 + o_orderkey % 1000 + (o_orderkey % 100) / 100::DOUBLE AS number FROM orders")
def german_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", V.parse_german_number(F.col("german")).alias("number"))


@query("SELECT n, v || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS german, v || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS english FROM (SELECT o_orderkey AS n, (o_orderkey % 9 + 1) * 1000 + o_orderkey % 1000 AS v FROM orders)")
def normalized_amounts(spark: SparkSession, d: str) -> DataFrame:
    s = _strings(spark, d)
    return s.select("n", *[V.normalize_amount(F.col(c)).alias(c) for c in ("german", "english")])


@query("SELECT n, CASE WHEN n % 14 + 1 > 12 OR (n % 14 + 1 = 2 AND TRY_CAST(y || '-02-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') AS DATE) IS NULL) THEN NULL ELSE strftime(make_date(y, n % 14 + 1, n % 28 + 1), '%Y-%m-%d') END AS day FROM (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 100 <= 30 THEN 2000 ELSE 1900 END + o_orderkey % 100 AS y FROM orders)")
def short_dates(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", F.date_format(V.parse_date(F.col("short_date")), "yyyy-MM-dd").alias("day"))


@query(f"SELECT n, CAST(bban || '1314' || check_digits AS HUGEINT) % 97 = 1 AS valid FROM ({STRINGS_SQL})")
def iban_checks(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", V.iban_valid(F.concat(F.lit("DE"), "check_digits", "bban")).alias("valid"))


@query(f"SELECT n, CAST(list_sum(list_transform(range(1, 19), lambda i: CAST(bban[i] AS INT) * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END)) % 10 AS INT) AS digit FROM ({STRINGS_SQL})")
def mrz_check_digits(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", V.mrz_digit(F.col("bban")).cast("int").alias("digit"))


@query("SELECT o_orderkey AS n, CASE o_orderkey % 6 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' WHEN 2 THEN 'debit' WHEN 3 THEN 'credit' END AS sign, CASE WHEN o_orderkey % 7 < 2 THEN 'EUR' WHEN o_orderkey % 7 = 2 THEN 'CHF' WHEN o_orderkey % 7 = 3 THEN 'USD' WHEN o_orderkey % 7 < 6 THEN 'GBP' END AS currency FROM orders")
def signs_and_currencies(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", V.balance_sign(F.col("signed")).alias("sign"), V.currency(F.col("money")).alias("currency"))


@query(
    """SELECT o_orderkey AS n, CASE o_orderkey % 8 WHEN 0 THEN 'permanent' WHEN 1 THEN 'fixed_term' WHEN 2 THEN 'part_time' WHEN 3 THEN 'full_time' WHEN 4 THEN 'minijob' WHEN 5 THEN 'internship' WHEN 6 THEN 'freelance' ELSE 'on_call' END AS employment,
      CASE o_orderkey % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'annual' WHEN 2 THEN 'weekly' WHEN 3 THEN 'hourly' ELSE 'per_sprint' END AS interval FROM orders"""
)
def employment_codes(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", labelled.first_code(F.col("job"), labelled.EMPLOYMENT).alias("employment"), labelled.first_code(F.col("pay_every"), labelled.INTERVALS).alias("interval"))


@query("SELECT o_orderkey AS n, o_orderkey % 4 = 0 AS is_name FROM orders")
def human_names(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", V.human_name(F.col("person")).alias("is_name"))


@query("SELECT o_orderkey AS n, 'a b c' || chr(10) || chr(10) || o_orderkey AS squeezed FROM orders")
def squeezed_lines(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", T.squeeze_lines(F.col("loose")).alias("squeezed"))


@query("SELECT o_orderkey AS n, replace(replace(replace(replace(translate('O' || o_orderkey || 'IBSGZQ', 'OIBSGZQ', '0185620'), ' ', ''), '-', ''), '.', ''), ',', '') AS repaired FROM orders")
def ocr_repairs(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).select("n", T.ocr_repair_digits(F.concat(F.lit("O"), F.col("n").cast("string"), F.lit("IBSGZQ"))).alias("repaired"))
