"""A training-data pipeline over ``documents``: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, line_dedup, minhash, mixing, packing
from factloom.llm.common import load, materialize
from factloom.llm.queries import LEAST_INK, MIX_WEIGHTS, mix_levels, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes the language found.

    Null, empty and letterless texts go, as their language can't be told; so does every document if none is labelled. Repeated
    rows are treated alike, other columns stay, an empty table gives no rows.
    """
    model = langid.fit(docs)
    found = docs.withColumn("__p", langid.classify(F.col("text"), model)).where(~F.col("__p.rejected"))
    return found.select(*[F.col("__p.lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines of some length; a document of which nothing is left goes.

    Null and empty texts stay as they are, repeated rows are treated alike; an empty table gives no rows.
    """
    found = line_dedup.dedup_lines(docs, min_bytes=LEAST_INK).where((F.size("chunks_cut") == 0) | (F.trim("text") != ""))
    return found.select(*[F.when(F.size("chunks_cut") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The smallest id stays, repeated rows leave one; rows of null id or without words all stay, an empty table gives no rows.
    """
    return minhash.drop_near_duplicates(docs, size=5, threshold=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of all tokens, by the weights of domains and languages, each document once at most.

    A null language or source is a leaf of its own; a document in which the prefix of a leaf ends stays whole. Repeated rows
    count once each, an empty table gives no rows.
    """
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, share=0.8, max_epochs=1, seed=11).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 tokens; null and empty texts are the end id alone, an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_dedup", near_dedup), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL expresses neither compression nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
