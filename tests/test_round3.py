"""Tests of the findings of round 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import classify, evidence_match, passport, universal
from factloom.operators import geometry as G
from factloom.plans import catalog
from factloom.sources import candidates as _  # noqa: F401  registers its records
from factloom.sources import passports as __  # noqa: F401
from factloom.sources.records import record


def _joined_rows(spark, df):
    """df's rows, and how many rows its joins made in all."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, todo, made = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                made += node.metrics().get("numOutputRows").get().value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return rows, made
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_repeated_texts_of_a_document_are_met_once(spark):
    items = spark.createDataFrame([(1, i, ["the  Value 7 of 3 .", ""]) for i in range(300)], "doc_id long, item_id long, texts array<string>")
    known = spark.createDataFrame([(1, i, -i, ["value 7 of 3", "of the value"], False) for i in range(300)], "doc_id long, candidate_id long, ord long, texts array<string>, has_spans boolean")
    rows, made = _joined_rows(spark, evidence_match.match_evidence(items, known))
    assert sorted(rows) == [(1, i, 299, "match") for i in range(300)]
    assert made < 5_000


def test_texts_that_share_words_meet_at_a_rare_gram(spark):
    items = spark.createDataFrame([(1, i, [f"value {i:03}"]) for i in range(300)], "doc_id long, item_id long, texts array<string>")
    known = spark.createDataFrame([(1, i, i, [f"the value {i:03} of all"], False) for i in range(300)], "doc_id long, candidate_id long, ord long, texts array<string>, has_spans boolean")
    rows, made = _joined_rows(spark, evidence_match.match_evidence(items, known))
    assert sorted(rows) == [(1, i, i, "match") for i in range(300)]
    assert made < 20_000

def test_span_letters_keep_their_number_in_upper_case(spark):
    cands = spark.createDataFrame([(1, 10, "Ss"), (1, 11, "WEIẞ"), (1, 12, " "), (1, 13, "ŉ"), (1, 14, "ᾀ")], "doc_id long, candidate_id long, value string")
    spans = spark.createDataFrame([(1, "a", "weiß ŉ"), (1, "b", "lass"), (1, "c", "ʼn ᾈ")], "doc_id long, span_id string, text string")
    found = {r["candidate_id"]: r["span_ids"] for r in G.spans_with_value(cands, spans).collect()}
    assert found == {10: ["b"], 11: ["a"], 12: [], 13: ["a"], 14: ["c"]}


def test_many_labels_asks_no_pattern_made_from_each_row(spark):
    values = ["name", "given name", "surname only", "nothing here", "enamel", "staatsangehörigkeit", "valid until geb", None]
    found = spark.createDataFrame([(v,) for v in values], "v string").select(universal.many_labels(T.normalize_text(F.col("v"))).alias("m"))
    # the German word has two spellings in the table that are one label once normalised
    assert [r["m"] or False for r in found.collect()] == [False, True, False, False, False, True, True, False]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_a_table_of_one_row_group_are_many_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    for name in ("texts", "labelled_texts", "card_texts", "candidate_rows"):
        assert record(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() >= 4 * cores, name


def test_passport_patterns_are_asked_outside_of_lambdas_and_of_texts_that_may_match(spark):
    texts = ["Paſſport No: C01X00T47", "GİVEN NAMES: Ada", "Date of issue: 31.02.2015", "Surname: Muster.", "in MÜNCHEN am 5.6.21", None, ""]
    found = passport.passport_facts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), F.lit("2010-01-01").cast("date"))
    got = {(r["doc_id"], r["fact_type"], r["value"]) for r in found.collect() if r["source"] != "label"}
    assert {(0, "passport_number", "C01X00T47"), (1, "given_names", "Ada"), (2, "date_of_issue", "31.02.2015"), (3, "surname", "Muster"), (4, "possible_location", "MÜNCHEN"), (4, "possible_date", "2021-06-05")} <= got
    lines = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "passnummer" in x and "regexp_extract" in x]
    assert lines and not any("lambda" in x for x in lines)


def test_boxes_are_met_by_page_without_moving_them_again(spark):
    for name in ("page_spans", "ocr_table_cells"):
        found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") - plan.count("Exchange hashpartitioning(l_orderkey") == 0, name


def test_kinds_of_odd_letters_are_found_outside_of_lambdas(spark):
    texts = ["REİSEPASS", "bank\tſtatement", "x" * 29 + " id<abc", "İ" + "A1<" * 10, "Pay\n Slip", "  ", None, "K" * 29]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = classify.add_by_pattern(docs, "text", "kind")
    assert [r["kind"] for r in found.orderBy("doc_id").collect()] == ["passport", "bank_statement", "id_card", "passport", "payslip", None, None, None]
    scored = classify.add_by_score(spark.createDataFrame([(0, "bank \t«statement»"), (1, "Document—No"), (2, None), (3, "tax  iban")], "doc_id int, text string"), "text", "kind")
    assert [r["kind"] for r in scored.orderBy("doc_id").collect()] == ["bank_statement", "passport", "other", "bank_statement"]
    for name in ("doc_type_regex", "doc_type_score"):
        assert "lambda" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString(), name
    # a text in small letters is asked for words first, so that most texts meet no pattern
    assert "Contains" in found._jdf.queryExecution().optimizedPlan().toString()
