"""Reports of an entity as rows that write out as JSON: an envelope's counts, and items in order.

Items are one row each with their place, so that a large entity's report is never gathered in one
row; ``envelopes`` has a row for each entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def items(rows: DataFrame, owner: str, order: list[Column], fields: list[str], report: str) -> DataFrame:
    """One JSON item for each row, numbered within its owner; null fields are left out of the JSON, as to_json does."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return rows.select(F.col(owner).alias("owner_id"), F.lit(report).alias("report"), place.alias("place"), F.to_json(F.struct(*fields)).alias("item"))


def envelopes(rows: DataFrame, owner: str, report: str, counts: dict[str, Column]) -> DataFrame:
    """schema_version, owner, report and the counts of each owner."""
    return rows.groupBy(F.col(owner).alias("owner_id")).agg(*[c.alias(k) for k, c in counts.items()]).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(report).alias("report"), "owner_id", *counts)


def fact_export(facts: DataFrame) -> DataFrame:
    return envelopes(facts.where("status = 'accepted'"), "entity_id", "fact_export", {"fact_count": F.count("*"), "first_at": F.min("created_at"), "last_at": F.max("created_at")})


def conflict_report(conflicts: DataFrame) -> DataFrame:
    counts = {"conflict_count": F.count("*"), "open_count": F.count_if(F.col("status") == "open"), "terminal_count": F.count_if(F.col("status").isin("resolved", "dismissed"))}
    return envelopes(conflicts, "entity_id", "conflict_report", counts)


def audit_report(entries: DataFrame) -> DataFrame:
    """entries(subject_id, verified, violation): counts of each subject."""
    counts = {"entry_count": F.count("*"), "verified": F.count_if("verified"), "failed": F.count_if(~F.col("verified")), "violations": F.count("violation")}
    return envelopes(entries, "subject_id", "audit_report", counts)


def output_documents(outputs: DataFrame) -> DataFrame:
    """Stored outputs with the hash of their content and their path in a package."""
    path = F.concat(F.lit("outputs/"), F.col("output_type"), F.lit("/"), F.col("output_id").cast("string"), F.lit("."), F.col("format"))
    return outputs.withColumns({"content_hash": F.sha2("content", 256), "path": path})


def manifest(outputs: DataFrame, documents: DataFrame) -> DataFrame:
    """The files of each subject's package, outputs and documents: kind, path, and the path's hash for the package's own.

    outputs(subject_id, output_id, path), documents(entity_id, document_id, file_path).
    """
    name = F.regexp_extract("file_path", r"[^/]+$", 0)
    docs = documents.select(F.col("entity_id").alias("subject_id"), F.lit("document").alias("kind"), F.concat(F.lit("documents/"), F.col("document_id").cast("string"), F.lit("_"), name).alias("path"))
    both = outputs.select("subject_id", F.lit("output").alias("kind"), "path").unionByName(docs)
    return both.withColumn("path_hash", F.sha2("path", 256))
