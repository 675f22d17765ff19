"""Counts over detections, rejects and throttle decisions. Hash aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions.masking import value_key


def detections_by_type(detections: DataFrame, *by: str) -> DataFrame:
    """Number of spans and of distinct values per type (and further columns).

    Spans are first counted per value, so a value repeated everywhere reaches the
    shuffle once per task, and the counts per group add up the partial rows.
    """
    keys = [*by, "type"]
    per_value = (
        detections.select(*keys, value_key(F.col("type"), F.col("value")).alias("_key"))
        .groupBy(*keys, "_key")
        .agg(F.count("*").alias("_n"))
    )
    return per_value.groupBy(*keys).agg(
        F.sum("_n").alias("detection_count"), F.count("*").alias("value_count")
    )


def reject_summary(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("status").agg(F.count("*").alias("rejects"))


def throttle_summary(decisions: DataFrame, client: str) -> DataFrame:
    """Admitted and rejected events per client and the longest wait that was told."""
    return decisions.groupBy(client).agg(
        F.count_if(F.col("allowed")).alias("admitted"),
        F.count_if(~F.col("allowed")).alias("rejected"),
        F.max("retry_after").alias("max_retry_after"),
    )
