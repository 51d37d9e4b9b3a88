"""The record tables of the model, as views over the driver's tables, and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that may be imported, and the largest size in bytes.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "docx", "xlsx", "csv", "json", "xml", "webp")
MAX_BYTES = 52_428_800


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out anew if its partitions are no more than the cores, else df itself.

    So few are a small table: even then a file of one row group is read by one task, however many
    partitions there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def dealt(df: DataFrame, *columns: str, tasks_a_core: int = 4, key: str | None = None) -> DataFrame:
    """The columns of a stored table, dealt out to a few tasks a core unless it is read by as many; with ``key`` always, and by it.

    For narrow tables whose rows become long texts or much work: a file of one row group is one task's otherwise, beside whatever else is read.
    """
    n = tasks_a_core * df.sparkSession.sparkContext.defaultParallelism
    if key:
        return df.select(*columns).repartition(max(n, tasks_a_core * df.rdd.getNumPartitions()), key)
    return df.select(*columns).repartition(n) if df.rdd.getNumPartitions() < n else df.select(*columns)


def _confidence(key: str) -> F.Column:
    return (F.col(key) * 37 % 101) / 100.0


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("entity_type"), F.col("c_nationkey").alias("nation_id"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pending, accepted or rejected fact for each order."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("field_name"), F.col("o_totalprice").alias("value"), _confidence("o_orderkey").alias("confidence"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("created_at"), F.col("l_discount").alias("confidence"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"), F.col("s_nationkey").alias("nation_id"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review cases, jobs and audit entries all come from events."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("PENDING", "ASSIGNED", "IN_REVIEW", "COMPLETED", "CANCELLED")]), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("fact_type"), _confidence("event_id").alias("confidence"), status.alias("status"), F.col("ts").alias("created_at"), F.col("value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files with hash, name, extension and whether they may be imported."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.select("path", F.col("length"), F.regexp_extract("path", r"[^/]+$", 0).alias("name"), extension.alias("extension"), F.sha2("content", 256).alias("file_hash"), (extension.isin(*EXTENSIONS) & (F.col("length") <= MAX_BYTES)).alias("allowed"))
