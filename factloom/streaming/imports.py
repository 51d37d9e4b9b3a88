"""Files taken into a store: checked, met with what is stored, and written in batches that count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.ledger import read_table, write_batch
from factloom.sources.tables import EXTENSIONS, MAX_BYTES
from factloom.streaming.stages import run_batches

STORED = "document_id string, entity_id string, file_hash string, path string, length long"
REJECTED = "entity_id string, path string, length long, reason string"


def judged(files: DataFrame, stored: DataFrame) -> DataFrame:
    """files(path, length, file_hash, entity_id) with document_id and reason (null: to be stored).

    In this order: no name, an extension that may not be imported, an empty file, one too large, a file of the same hash and entity that is
    stored, and one earlier by path in this table. The same file may belong to several entities. A null hash or entity is a value of its own.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    checked = F.when(F.coalesce(F.regexp_extract("path", r"[^/]+$", 0), F.lit("")) == "", "no_name").when(~extension.isin(*EXTENSIONS), "extension").when(F.coalesce("length", F.lit(0)) == 0, "empty").when(F.col("length") > MAX_BYTES, "too_large")
    key = F.sha2(F.concat_ws("|", F.coalesce("file_hash", F.lit("")), F.coalesce(F.col("entity_id").cast("string"), F.lit(""))), 256)
    rows = files.withColumns({"__bad": checked, "document_id": F.substring(key, 1, 32)})
    known = stored.select("document_id").distinct().withColumn("__known", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("document_id", F.col("__bad").isNull()).orderBy("path"))
    met = rows.join(known, "document_id", "left").withColumn("__nth", nth)
    reason = F.coalesce("__bad", F.when(F.col("__known"), "stored"), F.when(F.col("__nth") > 1, "twice"))
    return met.withColumn("reason", reason).drop("__bad", "__known", "__nth")


def import_batch(files: DataFrame, root: str, batch: str) -> bool:
    """Take a batch of files into the store at ``root``: tables documents and rejected; a batch that counts already changes nothing."""
    spark = files.sparkSession
    told = judged(files, read_table(spark, root, "documents", STORED))
    entity = F.col("entity_id").cast("string").alias("entity_id")
    return write_batch({"documents": told.where("reason is null").select("document_id", entity, "file_hash", "path", F.col("length").cast("long")), "rejected": told.where("reason is not null").select(entity, "path", F.col("length").cast("long"), "reason")}, root, batch)


def import_stream(spark: SparkSession, folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """Import the files that ``folder`` has and gets; the folder that a file lies in names its entity.

    Spark's reader passes over empty files. The checkpoint tells which files were seen and the ledger which batches count, so that a restart neither loses nor repeats one.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    shaped = files.select("path", "length", F.sha2("content", 256).alias("file_hash"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("entity_id"))
    return run_batches(shaped, lambda rows, n: import_batch(rows, root, f"import-{n}"), checkpoint)
