"""Tests of the findings of round 4."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.functions import dates
from factloom.operators import build, decisions

CANDIDATE = "candidate_id string, entity_id long, document_id long, source_id long, fact_type string, raw_value string, normalized_value string, source_stage string, confidence double, metadata map<string,string>"


def _decided(spark, rows):
    made = [(f"c{i}", entity, 2, 3, kind, value, value, "mrz", 0.8, None) for i, (entity, kind, value) in enumerate(rows)]
    return decisions.decide(spark.createDataFrame(made, CANDIDATE), F.lit("2024-06-15").cast("date"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hints_are_looked_up_once_and_by_arrow(spark):
    """A filter on what was decided doesn't decide again below, and no lambda goes over the words of a text."""
    rows = _decided(spark, [(1, "surname", "Mustermann"), (1, "email", "info@firma.example"), (2, "date", "12.05.1984")])
    plan = _plan(build.build(rows, F.lit("2024-06-15").cast("timestamp"))["links"])
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    bits = spark.createDataFrame([(0, None), (1, ""), (2, "geboren am"), (3, "xx"), (4, "geboren am")], "i int, t string").repartition(1).select("i", decisions.hint_bits(F.col("t")).alias("b"))
    got = {r["i"]: r["b"] for r in bits.collect()}
    assert got[0] == got[1] == got[3] == 0 and got[2] == got[4] and got[2] & 1


def test_days_of_odd_texts(spark):
    """Days are read as before: padded years, two digits, eight and six digits, line ends, and nothing from what is no such day."""
    day = datetime.date
    texts = {"03.04.2019\n": day(2019, 4, 3), "1.1.31": day(1931, 1, 1), "1/1-30": day(2030, 1, 1), "1.1.123": day(123, 1, 1), "2020-1.2": day(2020, 1, 2), "19.50.1012": None, "a20010203b": day(2001, 2, 3), "14022025": day(2025, 2, 14), "010203": day(2003, 2, 1), "29.2.1900": None, "soon": None, "": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.knowledge_date(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in rows.collect()} == texts


def test_conflicts_decide_a_candidate_once(spark):
    """Groups and facts come from one pass; rows without an entity or a type are in no conflict, repeated rows count."""
    rows = [(1, "surname", "Mustermann"), (1, "surname", "Sommer"), (1, "surname", "Sommer"), (2, "surname", "Mustermann"), (2, "surname", "Mustermann"), (None, "surname", "Mustermann"), (None, "surname", "Sommer"), (3, "surname", "Mustermann"), (3, "surname", "")]
    found = build.build(_decided(spark, rows), F.lit("2024-06-15").cast("timestamp"))["conflict_facts"]
    assert _plan(found).count("ArrowEvalPython") == 1
    assert sorted((r["entity_id"], r["field_name"], r["n_facts"]) for r in found.collect()) == [(1, "surname", 3)] * 3
