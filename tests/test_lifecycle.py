import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import values as V
from factloom.operators import extract, geometry as G, lifecycle as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("given,want", [("5.6.1999", "1999-06-05"), ("5/6/31", "1931-06-05"), ("5-6-30", "2030-06-05"), ("2001/2/3", "2001-02-03"), ("20010203", "2001-02-03"), ("03022001", "2001-02-03"), ("030201", "2001-02-03"), ("31.02.2001", "2001-02-31"), ("Soon ", "soon"), ("", ""), (None, None)])
def test_date_key(spark, given, want):
    assert one(spark, D.date_key(F.lit(given).cast("string"))) == want


def test_dates(spark):
    assert one(spark, D.knowledge_date(F.lit("31.02.2001"))) is None
    assert one(spark, D.knowledge_date(F.lit("3.2.2001"))) == datetime.date(2001, 2, 3)
    assert one(spark, D.german_date(F.lit("Berlin, den 3. März 2001"))) == "2001-03-03"
    assert one(spark, D.german_date(F.lit("3.12.2001 bis 4.1.2002"))) == "2001-12-03"
    assert one(spark, D.german_date(F.lit("bald"))) is None
    assert [tuple(one(spark, D.pay_month(F.lit(x)))) for x in ("5.1.2020", "3/2021", "März 2022")] == [("2020-01-05", "full_date"), ("2021-03-01", "numeric_month_start"), ("2022-03-01", "month_start_inferred")]
    assert one(spark, D.pay_month(F.lit("Montag 2022"))) is None


@pytest.mark.parametrize("born,on,want", [("1880-01-02", "2000-12-31", True), ("1879-12-31", "2000-12-31", False), ("1880-03-05", "2001-03-04", True), ("1880-03-05", "2001-03-05", False), ("2000-12-31", "2000-12-31", False), (None, "2000-12-31", False)])
def test_birth_date(spark, born, on, want):
    assert one(spark, D.birth_date_ok(F.lit(born).cast("date"), F.lit(on).cast("date"))) is want


def test_expiry_date(spark):
    ok = lambda day: one(spark, D.expiry_date_ok(F.lit(day).cast("date"), F.lit("2000-02-29").cast("date")))
    assert [ok("2030-02-28"), ok("2030-03-01"), ok("2000-02-29"), ok(None)] == [True, False, False, False]


def test_keys_of_facts(spark):
    df = spark.createDataFrame([("DOB ", "5.6.1999"), ("E-Mail", "A @b.de"), ("mobile", "+49 (1) 2"), ("city", " New  York ")], "f string, v string")
    assert [tuple(r) for r in df.select(D.field_key(F.col("f")), D.value_key(D.field_key(F.col("f")), F.col("v"))).collect()] == [("date_of_birth", "1999-06-05"), ("email", "a@b.de"), ("phone_number", "+4912"), ("city", "new york")]


def test_values(spark):
    assert [one(spark, V.balance_sign(F.lit(x))) for x in ("-5,00", "5,00 H", "+1", "7,00 S", "7")] == ["debit", "credit", "credit", "debit", None]
    assert tuple(one(spark, V.amount_check(F.lit("bonus"), F.lit("0.5")))) == (False, 0.55)
    assert tuple(one(spark, V.amount_check(F.lit("other"), F.lit("x")))) == (True, 0.90)
    assert tuple(one(spark, V.amount_check(F.lit("bonus"), F.lit("x")))) == (False, 0.55)
    assert [one(spark, V.social_security_valid(F.lit(x))) for x in ("65 1708 J 003", "A12345678B12", "x")] == [True, True, False]
    assert [one(spark, V.human_name(F.lit(x))) for x in ("Änne Müller-Groß", "anna b", "Anna")] == [True, False, False]
    answers = ['```json\n{"a": 1}\n```', 'Here: {"a": 1} done', "[1]", "none {x}", "", None]
    assert [one(spark, V.recover_json(F.lit(x).cast("string"))) for x in answers] == ['{"a": 1}', '{"a": 1}', "{}", "{}", "{}", "{}"]


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x", "y", "width", "height"))])
    a, b, c = box(0, 0, 4, 4), box(2, 2, 4, 4), box(4, 0, 1, 1)
    assert [one(spark, G.iou(a, b)), one(spark, G.iou(a, c)), one(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)))] == [4 / 28, 0.0, 0.0]
    assert tuple(one(spark, G.union(a, b))) == (0, 0, 6, 6) and tuple(one(spark, G.intersection(a, b))) == (2, 2, 2, 2)
    assert one(spark, G.intersection(a, c)) is None and one(spark, G.contains(a, box(1, 1, 3, 3))) is True
    assert tuple(one(spark, G.expand(a, 1, 2))) == (0, 0, 6, 8) and one(spark, G.distance(a, box(3, 4, 4, 4))) == 5


def test_pages_and_spans(spark):
    size = "doc_id long, page int, width double, height double"
    fused = G.fuse_pages(spark.createDataFrame([(1, 1, 5.0, 9.0), (1, 2, 1.0, 1.0)], size), spark.createDataFrame([(1, 1, 6.0, 8.0), (1, 3, 2.0, 2.0)], size))
    assert rows(fused) == [(1, 1, 6.0, 9.0, "fused"), (1, 2, 1.0, 1.0, "first_only"), (1, 3, 2.0, 2.0, "second_only")]
    parts = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.6), (1, 2, 0.1), (1, 2, 0.1), (1, 2, 0.2), (2, 1, None)], "doc_id long, page int, conf double")
    assert rows(G.page_confidence(parts)) == [(1, 0.3417, 2), (2, 0.0, 1)]
    cands = spark.createDataFrame([(1, 10, "abc"), (1, 11, None), (1, 12, ""), (2, 13, "abc")], "doc_id long, candidate_id long, value string")
    spans = spark.createDataFrame([(1, "s1", "x ABC"), (1, "s2", "abcd"), (1, "s3", None), (2, "s4", "no")], "doc_id long, span_id string, text string")
    assert rows(G.spans_with_value(cands, spans).select("candidate_id", "span_ids")) == [(10, ["s1", "s2"]), (11, []), (12, []), (13, [])]
    assert one(spark, G.span_ids_or_document(F.array(F.lit("bad")), F.lit("DOC-ab_1-z"))) == ["ESP-" + "AB1".ljust(32, "0")]


def test_fold_cases_against_a_loop(spark):
    rng = random.Random(3)
    data = [(rng.randrange(20), i, rng.choice(["assign", "start", "complete", "escalate", "cancel", "other"])) for i in range(400)]
    want = {}
    for case, _, do in data:
        status, priority, refused = want.get(case, ("PENDING", "NORMAL", 0))
        allowed = {"assign": True, "start": status == "ASSIGNED", "complete": status == "IN_REVIEW", "escalate": status == "IN_REVIEW", "cancel": status not in ("COMPLETED", "CANCELLED")}.get(do, False)
        to = {"assign": "ASSIGNED", "start": "IN_REVIEW", "complete": "COMPLETED", "escalate": "PENDING", "cancel": "CANCELLED"}.get(do)
        want[case] = (to, "CRITICAL" if do == "escalate" else priority, refused) if allowed else (status, priority, refused + 1)
    got = L.fold_cases(spark.createDataFrame(data, "case_id long, at long, action string"))
    assert rows(got) == sorted((k, *v) for k, v in want.items())
    assert L.fold_cases(spark.createDataFrame([], "case_id long, at long, action string")).count() == 0


def test_cases_noise_and_versions(spark):
    cases = spark.createDataFrame([(1, 7, "PENDING"), (2, 8, "COMPLETED")], "case_id long, candidate_id long, status string")
    new = spark.createDataFrame([(1, 9, "PENDING"), (3, 7, "PENDING"), (4, 8, "PENDING")], cases.schema)
    assert rows(L.open_cases_only_once(new, cases).select("case_id")) == [(4,)]
    noise = spark.createDataFrame([(1, "a", "open", 0.1), (1, "b", "open", 1.0), (1, "c", "reviewed", 0.5)], "entity_id long, raw_text string, status string, confidence double")
    active = spark.createDataFrame([(1, "a", "PENDING"), (1, "b", "CANCELLED")], "entity_id long, value string, status string")
    assert rows(L.promote_noise(noise, active).select("raw_text", "status", "confidence")) == [("a", "failed", 0.5), ("b", "promoted", 0.99)]
    stored = spark.createDataFrame([("t", 1), ("t", 4)], "template_id string, version int")
    assert rows(L.new_versions(stored, spark.createDataFrame([("t",), ("u",)], "template_id string"))) == [("t", 5), ("u", 1)]


def test_consistency_rule(spark):
    facts = spark.createDataFrame([(1, "expiry", "2.1.2020", "accepted"), (2, "expiry", "x", "accepted"), (3, "expiry", "1.1.2020", "accepted"), (3, "expiry", "2.1.2020", "accepted")], "entity_id long, field_name string, value string, status string")
    cands = spark.createDataFrame([(e, "issue", "1.1.2020", "pending") for e in (1, 2, 3, 4)] + [(1, "name", None, "pending")], facts.schema)
    got = L.consistency_rule(cands, facts, "issue", "expiry", "<", "date")
    assert rows(got.select("entity_id", "field_name", "passed", "error")) == [(1, "issue", True, False), (1, "name", True, False), (2, "issue", False, False), (3, "issue", False, True), (4, "issue", True, False)]
    with pytest.raises(ValueError):
        L.consistency_rule(cands, facts, "issue", "expiry", "<", "string")


def test_contextual_fallback_and_declared(spark):
    docs = spark.createDataFrame([(1, "BIC: deutdeff500\nsome DEUTDEFF\nPass-Nr C01X0006H"), (2, None), (3, "call 0049 30 123456 on\n3.4.22")], "doc_id long, text string")
    got = [tuple(r) for r in extract.contextual_matches(docs).where("fact_type = 'bic'").select("doc_id", "line", "value").collect()]
    assert got == [(1, 0, "DEUTDEFF500")]
    assert ("passport_number", "C01X0006H") in rows(extract.contextual_matches(docs).select("fact_type", "value"))
    assert rows(extract.fallback_matches(docs).select("doc_id", "fact_type", "value")) == [(3, "date", "3.4.22"), (3, "phone_number", "0049 30 123456")]
    turns = spark.createDataFrame([(1, "My name is Ada  Byron and I am here"), (2, "ok, 36 years old"), (3, "my age is 400"), (4, None)], "id long, text string")
    assert rows(extract.self_declared(turns).select("id", "fact_type", "value")) == [(1, "name", "Ada Byron"), (2, "age", "36")]
