"""The extraction stages over unbounded documents (an extension of the batch operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import extract


def candidate_stream(docs: DataFrame, patterns: tuple = extract.UNIVERSAL) -> DataFrame:
    """Gated candidates of a stream of (doc_id, text); stateless, so late rows need no care."""
    return extract.gate(extract.all_matches(docs, patterns)).where("reject_reason is null")


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand micro-batches to ``step``; the checkpoint makes restarts go on where they stopped."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
