"""The pipeline's stages on odd rows, and language ID against a plain coder and on held-out rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import langid

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, text_key string, __node long, rejected boolean, mix_take int"
STAGES = dict(corpus_pipeline.STAGES)


def text(i, n=60):
    return " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing ids and names."""
    texts = [text(1), text(1), text(2), None, "", "  ", "123 45", text(3, 9000), "one", "ein langer Satz\nmit zwei Zeilen\n" * 3, "ß 😀 \x00"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src1", None, "k", i, True, 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (0, text(9), "de", "src2", 5, None, None, None, None), (None, text(1), "en", "src1", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, odd, name):
    found = STAGES[name](spark, odd, "")
    rows = found.collect()
    if name != "packing":
        assert found.columns == odd.columns
        ids = {r["doc_id"] for r in rows}
        assert {1, 2} & ids and 7 in ids  # clean and long texts stay
        assert all(r["text_key"] in ("k", None) for r in rows)
    if name == "language_id":
        assert not any(r["doc_id"] in (3, 4, 5, 6) for r in rows) and len(rows) == 16 - 5
    if name == "line_dedup":
        assert len(rows) == 16 and {r["text"] for r in rows if r["doc_id"] == 3} == {None}
    if name == "near_dedup":
        assert sorted(r["text"] or "" for r in rows if r["doc_id"] == 0) == sorted([text(1), text(9)]) and 1 not in {r["doc_id"] for r in rows}
        assert sum(r["doc_id"] is None for r in rows) == 2
    if name == "packing":
        assert sum(r["length"] for r in rows if r["doc_id"] in (3, 4)) == 2  # the end id alone
    assert STAGES[name](spark, odd.where("false"), "").count() == 0


def test_language_against_a_plain_coder(spark):
    import zstandard as zs

    words = {"en": "the and of thing that with from have there being".split(), "de": "der die und nicht sich auch werden können über schön".split()}
    of = lambda lang, i, n: " ".join(words[lang][(i * 7 + k * k) % 10] for k in range(n))
    rows = [(of(lang, i, 40), lang) for i in range(50) for lang in words] + [(of("en", 0, 40), "en")] * 300 + [(None, "en"), ("x", None)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample_docs=20)
    assert [lang for lang, _ in model.dictionaries] == ["en", "de"] and all(d.count(b"\n") < 20 for _, d in model.dictionaries)
    tests = [of("de", 99, 30), of("en", 98, 300), "The ÜBER", "x" * 70_000 + of("de", 5, 9000), of("en", 3, 20) + of("de", 3, 20)]
    got = {r["t"]: r["p"] for r in spark.createDataFrame([(t,) for t in tests], "t string").select("t", langid.classify(F.col("t"), model).alias("p")).collect()}
    for t in tests:
        raw, sizes = t.lower().encode(), []
        for lang, content in model.dictionaries:
            coder = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), level=19 if len(raw) < 400 else 6, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(coder.compress(raw[i : i + 65_536])) for i in range(0, len(raw), 65_536)), lang))
        least, second = sorted(s for s, _ in sizes)[:2]
        assert got[t]["lang"] == min(sizes, key=lambda x: x[0])[1] and abs(got[t]["margin"] - (second - least) / second) < 1e-9
        assert got[t]["rejected"] == (len(raw) >= 200 and (second - least) / second < 0.002)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    held = docs.where(langid.held_out(F.col("doc_id"))).select("lang", langid.classify(F.col("text"), model).alias("p")).where("not p.rejected")
    right, n = held.agg(F.avg((F.col("p.lang") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 30 and right > 0.95
