"""Tables that grow by batches, each written whole or not at all, and a ledger of the batches that count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch string, tables array<string>"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def batches(spark: SparkSession, root: str) -> DataFrame:
    """The batches that count: (batch, tables)."""
    path = f"{root}/_ledger"
    return spark.read.schema(LEDGER).json(path, recursiveFileLookup=True) if _there(spark, path) else spark.createDataFrame([], LEDGER)


def write_batch(tables: dict[str, DataFrame], root: str, batch: str) -> bool:
    """Write the rows that a batch adds to each table; false, and nothing changes, if the batch counts already.

    A batch's rows go to folders of its own, which a second try replaces, and its ledger entry comes
    last. Readers look at batches of the ledger only, so all tables of a batch appear together, and a batch that
    died half-way doesn't show. ``root`` is a folder that all executors share; ``batch`` is a file name.
    """
    spark = next(iter(tables.values())).sparkSession
    entry = f"{root}/_ledger/{batch}"
    if _there(spark, f"{entry}/_SUCCESS"):
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    spark.createDataFrame([(batch, sorted(tables))], LEDGER).coalesce(1).write.mode("overwrite").json(entry)
    return True


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table's rows of all batches that count, with their batch; ``schema`` is the table's, also where it has no rows."""
    path, shape = f"{root}/{name}", f"{schema}, batch string"
    if not _there(spark, path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(path).join(batches(spark, root).select("batch"), "batch", "left_semi").select(*spark.createDataFrame([], shape).columns)
