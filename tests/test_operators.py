import datetime

from pyspark.sql import functions as F

from factloom.operators import extract, knowledge as K
from factloom.streaming import stages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_patterns_gate_and_first_wins(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de or A@b.de, DE89370400440532013000 and DE89370400440532013001"), (2, None), (3, "")], "doc_id long, text string")
    good = extract.gate(extract.all_matches(docs)).where("reject_reason is null")
    once = extract.first_wins(good, [F.col("doc_id"), F.col("fact_type"), F.lower("value_norm")], [F.col("ord")])
    assert rows(once.select("doc_id", "fact_type", "value_norm")) == [(1, "email", "a@b.de"), (1, "iban", "DE89370400440532013000"), (1, "iban", "DE89370400440532013001")]


def test_first_matches_and_labels(spark):
    docs = spark.createDataFrame([(1, "R-17 and R-18"), (2, "Name:\nErika Muster\nname Max")], "doc_id long, text string")
    assert rows(extract.first_matches(docs, (extract.Pattern("number", r"R-([0-9]+)", 0.5, 1),)).select("doc_id", "fact_type", "value")) == [(1, "number", "17")]
    assert rows(extract.label_values(docs, {"full_name": ["name"]}).select("doc_id", "value")) == [(2, "Erika Muster"), (2, "Max")]


def test_mrz(spark):
    lines = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert [r["value"] for r in extract.mrz_lines(docs).collect()] == lines
    got = docs.select(extract.parse_mrz(F.split("text", "\n")).alias("m")).first()["m"]
    assert (got["kind"], got["document_number"], got["surname"], got["given_names"], got["status"]) == ("TD3", "L898902C3", "ERIKSSON", "ANNA MARIA", "VALID")


def test_new_rows_and_upsert(spark):
    stored = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "x"), (2, "w"), (None, "n"), (None, "n")], "k long, v string")
    assert rows(K.new_rows(new, stored, ["k"], [F.col("v")]).where("k is not null")) == [(2, "w")]
    assert K.new_rows(new, stored, ["k"], [F.col("v")]).count() == 3
    assert rows(K.upsert(stored, new.where("v in ('b', 'x')"), ["k"])) == [(1, "b"), (2, "x")]


def test_chain(spark):
    t = datetime.datetime(2020, 1, 1)
    entries = spark.createDataFrame([(1, None, "a", t), (2, "a", "b", t), (3, "x", "c", t), (4, "c", "d", t - datetime.timedelta(1))], "n long, previous_hash string, entry_hash string, occurred_at timestamp")
    got = K.chain_violations(entries.withColumn("s", F.lit(1)), ["s"], F.col("n"))
    assert [r["violation"] for r in got.orderBy("n").collect()] == [None, None, "link", "time"]


def test_recovery_and_lease(spark):
    f = spark.createDataFrame([(1, "CRITICAL", True, False), (2, "ERROR", True, True), (3, "ERROR", False, True), (4, "ERROR", False, False), (5, None, None, None)], "job_id long, severity string, is_retryable boolean, requires_review boolean")
    assert {r["job_id"]: r["decision"] for r in K.recovery(f).collect()} == {1: "ABORT", 2: "RETRY", 3: "ESCALATE", 4: "ABORT", 5: "CONTINUE"}


def test_ocr(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, 1, 2, "b", 0.5, 10.0, 0.0, 5.0, 4.0), (1, 1, 1, 1, 1, 1, "a", 1.0, 0.0, 1.0, 5.0, 4.0)], "doc_id long, page int, block int, par int, line int, word int, text string, conf double, x double, y double, w double, h double")
    line = K.ocr_lines(words).first()
    assert (line["text"], line["conf"], line["x"], line["w"], line["h"]) == ("a b", 0.75, 0.0, 15.0, 5.0)
    one = spark.createDataFrame([(1, 1, "A  x", 0.0, 0.0, 0.8), (1, 1, "only", 0.0, 5.0, 0.5)], "doc_id long, page int, text string, x double, y double, conf double")
    two = spark.createDataFrame([(1, 1, "a x", 0.0, 0.0, 0.6)], "doc_id long, page int, text string, x double, y double, conf double")
    assert rows(K.fuse_lines(one, two).select("text", "conf", "fused")) == [("A  x", 0.7, True), ("only", 0.5, False)]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"write to user{i}@example.org") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = stages.run_batches(stages.candidate_stream(stream), lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    want = extract.gate(extract.all_matches(docs)).where("reject_reason is null")
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("doc_id", "value")) == rows(want.select("doc_id", "value"))
