"""The margin of a language doesn't fall with the length of the text."""

import random

from pyspark.sql import functions as F

from factloom.llm import langid


def letters(r, n):
    return "".join(r.choices("etaoinshrdlu", k=n))


PHRASES = {lang: [letters(random.Random(f"{lang}{i}"), 40) for i in range(60)] for lang in ("en", "de")}


def written(lang, seed, n):
    """n phrases of the language, after each a word that nothing else holds."""
    r = random.Random(seed)
    return " ".join(f"{r.choice(PHRASES[lang])} {letters(r, 60)}" for _ in range(n))


def test_long_texts_are_not_rejected(spark):
    model = langid.fit(spark.createDataFrame([(written(lang, i, 14), lang) for lang in PHRASES for i in range(60)], "text string, lang string"))
    texts = [(lang, written(lang, 900, n)) for lang in PHRASES for n in (500, 40_000)]
    assert len(texts[-1][1]) > 4_000_000
    got = spark.createDataFrame(texts, "lang string, text string").select("lang", F.length("text").alias("n"), langid.classify(F.col("text"), model).alias("p")).collect()
    for lang in PHRASES:
        short, long = sorted((r["n"], r["p"]) for r in got if r["lang"] == lang)
        assert long[1]["lang"] == lang and not long[1]["rejected"] and long[1]["margin"] > short[1]["margin"] / 2
