"""Masking an unbounded input with the same row-local columns as the batch tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textguard.functions.detection import Detector
from textguard.functions.sealing import hide_keys
from textguard.operators.protection import seal_mappings, with_expiry
from textguard.operators.texts import masked_table, report_columns, with_analysis
from textguard.sources.mappings import MappingTable
from textguard.sources.storage import Scratch
from textguard.streaming.sinks import start

MASKED_SCHEMA = (
    "request_id string, masked_text string, detection_count int, token_count int, "
    "detection_types string"
)


def mask_stream(texts: DataFrame, detectors: Iterable[Detector] = ()) -> DataFrame:
    """Masked rows of a stream of ``request_id, text``; stateless."""
    return masked_table(with_analysis(texts, "text", detectors))


def mask_and_protect(
    texts: DataFrame,
    key: str | None,
    masked_path: str,
    mapping_path: str,
    ttl: timedelta | None = None,
    checkpoint: str | None = None,
    available_now: bool = True,
    detectors: Iterable[Detector] = (),
) -> StreamingQuery:
    """Write each micro-batch's masked texts and its sealed mapping sets.

    Both come from one analysis, which is staged with its values sealed: no plain value is kept
    anywhere, and a lost executor seals nothing anew. Masked rows go to one folder per batch,
    sets to a ``MappingTable`` under the name of ``masked_path`` and the batch. So a batch that
    runs again after a failure replaces its own rows in both.
    """
    detectors = tuple(detectors)
    hide_keys(texts.sparkSession)
    masked_columns = ["request_id", "masked_text", "detection_count", "token_count", "detection_types"]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        analyzed = with_analysis(batch.select("request_id", "text"), "text", detectors)
        sealed = seal_mappings(F.col("analysis.mappings"), key).alias("mappings")
        staged = analyzed.select(
            F.col("request_id"), F.col("analysis.masked_text").alias("masked_text"), *report_columns(),
            F.when(F.size("analysis.mappings") > 0, sealed).alias("mappings"), F.current_timestamp().alias("stored_at"),
        )
        with Scratch(spark) as scratch:
            staged = scratch.write(staged, "masked-and-sealed")
            sets = staged.filter(F.col("mappings").isNotNull())
            sets = with_expiry(sets.select(F.col("request_id").cast("string").alias("request_id"), "mappings", "stored_at"), ttl)
            MappingTable(spark, mapping_path).store(sets, masked_path, batch_id)
            staged.select(*masked_columns).write.mode("overwrite").parquet(f"{masked_path}/batch={batch_id}")

    return start(texts, write_batch, "mask", checkpoint, available_now)
