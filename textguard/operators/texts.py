"""Detection and masking over tables of texts. Narrow: no operator here shuffles."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from textguard.functions import masking as M
from textguard.functions.binding import attach
from textguard.functions.detection import Detector, detect, may_contain_pii


def spans_table(df: DataFrame, id_col: str, spans: Column) -> DataFrame:
    """One row per span of an array column.

    The outer generator keeps Catalyst from adding a ``size(spans) > 0`` filter, which
    would run the whole scan a second time.
    """
    exploded = df.select(id_col, F.explode_outer(spans).alias("span"))
    return exploded.filter(F.col("span").isNotNull()).select(id_col, "span.*")


def detections_table(
    df: DataFrame,
    id_col: str = "request_id",
    text_col: str = "text",
    detectors: Iterable[Detector] = (),
) -> DataFrame:
    """One row per resolved span: ``id, type, value, start, end``.

    Texts that cannot hold any of the six types are dropped by a cheap row filter
    inside whole-stage codegen before the patterns run.
    """
    detectors = tuple(detectors)
    rows = df if detectors else df.filter(may_contain_pii(text_col))
    return spans_table(rows, id_col, detect(text_col, detectors))


def with_analysis(
    df: DataFrame, text_col: str = "text", detectors: Iterable[Detector] = ()
) -> DataFrame:
    """Add ``analysis struct<masked_text, detections, mappings>``, computed once per row."""
    return attach(df, "analysis", M.analyze_text(text_col, tuple(detectors)))


def with_passthrough(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("analysis", M.passthrough(F.col(text_col)))


def masked_table(analyzed: DataFrame, id_col: str = "request_id") -> DataFrame:
    """``id, masked_text`` and the per-text report columns. Holds no original value."""
    return analyzed.select(
        id_col, F.col("analysis.masked_text").alias("masked_text"), *report_columns()
    )


def report_columns() -> list[Column]:
    """Detection count, unique token count and the sorted type names as ``[A,B]``."""
    types = F.array_sort(F.array_distinct(F.col("analysis.detections.type")))
    return [
        F.size("analysis.detections").alias("detection_count"),
        F.size("analysis.mappings").alias("token_count"),
        F.concat(F.lit("["), F.array_join(types, ","), F.lit("]")).alias("detection_types"),
    ]


def mappings_table(analyzed: DataFrame, id_col: str = "request_id") -> DataFrame:
    """One row per token with its plain value. Transient: never write this to a sink."""
    return spans_table(analyzed, id_col, F.col("analysis.mappings"))


def segments_table(df: DataFrame, id_col: str, masked_col: str = "masked_text") -> DataFrame:
    """Masked text cut into plain and token pieces: ``id, pos, is_token, piece``."""
    return spans_table(df, id_col, M.segment_masked(masked_col))


#: Values times characters up to which a text is searched for one value after the other.
SEARCHED_APART = 4_000_000


@F.pandas_udf(ArrayType(IntegerType()))
def _standing(texts: pd.Series, values: pd.Series) -> pd.Series:
    """For each text the positions of those values that stand in it, found in one pass over the text."""

    def found(text: str | None, wanted: np.ndarray | None) -> list[int] | None:
        if text is None or wanted is None:
            return None
        at: dict[str, list[int]] = {}
        for i, value in enumerate(wanted):
            if value is not None:
                at.setdefault(value, []).append(i)
        known = set(at.pop("", []))
        if at:
            search = ahocorasick.Automaton()
            for value, places in at.items():
                search.add_word(value, places)
            search.make_automaton()
            for _, places in search.iter(text):
                known.update(places)
        return sorted(known)

    return pd.Series([found(t, v) for t, v in zip(texts, values)], dtype=object)


def leaks(
    masked_col: str, mappings_col: str, detectors: Iterable[Detector] = (), apart: int = SEARCHED_APART
) -> Column:
    """``array<struct<type,reason>>``: what an outbound text still gives away.

    Two row-local tests: an original value standing in the text, and anything a fresh
    detection pass finds in it. No values come out, only types and the reason. Where values times
    length exceed ``apart``, an automaton of all values goes over the text once, in Arrow batches.
    """

    def reason(name: str):
        return lambda s: F.struct(s["type"].alias("type"), F.lit(name).alias("reason"))

    masked, mappings = F.col(masked_col), F.col(mappings_col) if isinstance(mappings_col, str) else mappings_col
    many = F.size(mappings).cast("bigint") * F.length(masked) > apart
    values = F.transform(mappings, lambda m: m["original_value"])
    standing = _standing(F.when(many, masked), F.when(many, values))
    kept = F.when(many, F.transform(standing, lambda i: F.get(mappings, i))).otherwise(
        F.filter(mappings, lambda m: F.contains(masked, m["original_value"]))
    )
    return F.concat(
        F.transform(kept, reason("original_value")),
        F.transform(detect(masked_col, tuple(detectors)), reason("detected")),
    )


def leak_check(
    df: DataFrame,
    id_col: str = "request_id",
    masked_col: str = "masked_text",
    mappings_col: str = "mappings",
    detectors: Iterable[Detector] = (),
    apart: int = SEARCHED_APART,
) -> DataFrame:
    """One row per leak of an outbound table; empty when the boundary holds."""
    return spans_table(df, id_col, leaks(masked_col, mappings_col, detectors, apart))
