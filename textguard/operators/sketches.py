"""Distinct counts that merge: small sketches per day and type instead of scans of old days.

A sketch is a HyperLogLog of the values of a group; the sketch of several groups is made from theirs
alone. With ``2 ** lg_k`` buckets the relative standard error is about ``0.83 / sqrt(2 ** lg_k)``: 1.3 %
for the default of 12, so an estimate lies within 4 % with near certainty. Up to some hundred values
the count is exact. A sketch holds hashes from which no value can be read, but tells whether a
known value may be in it, so it is kept like other aggregates, not published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions.masking import value_key
from textguard.operators.protection import utc_day

LG_K = 12


def request_sketches(sets: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``expires_on, requests``: the requests whose sets expire on a day (UTC); no sealed value is read.
    Made from the sets of one store, to be merged with what is kept for the day."""
    rows = sets.select(utc_day("expires_at").alias("expires_on"), "request_id")
    return rows.groupBy("expires_on").agg(F.hll_sketch_agg("request_id", lg_k).alias("requests"))


def value_sketches(detections: DataFrame, *by: str, lg_k: int = LG_K) -> DataFrame:
    """``type, *by, detections, values``: how many were found, and a sketch of the distinct values by the
    key under which masking takes them for one."""
    keyed = detections.select("type", *by, value_key(F.col("type"), F.col("value")).alias("key"))
    return keyed.groupBy("type", *by).agg(F.count("*").alias("detections"), F.hll_sketch_agg("key", lg_k).alias("values"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of the same ``by`` put together; counts beside them are added up."""
    kinds = {f.name: f.dataType.typeName() for f in sketches.schema if f.name not in by}
    sums = [
        (F.hll_union_agg(c) if kind == "binary" else F.sum(c)).alias(c) for c, kind in kinds.items() if kind in ("binary", "long", "integer")
    ]
    return sketches.groupBy(*by).agg(*sums)


def estimated(sketches: DataFrame, *columns: str) -> DataFrame:
    """The sketches in ``columns`` as whole counts."""
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in columns})
