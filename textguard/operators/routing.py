"""Splitting requests into accepted and rejected rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions import validation as V


def _checked(requests: DataFrame, providers: Iterable[str], max_length: int | None) -> DataFrame:
    kind = V.reject_kind(F.col("text"), F.col("provider"), providers, max_length)
    return requests.withColumn("reject_kind", kind)


def accepted_requests(
    requests: DataFrame,
    providers: Iterable[str] = P.PROVIDERS,
    max_length: int | None = None,
) -> DataFrame:
    """Rows that pass every check, with the provider name made canonical.

    The checks form a plain row filter below the pattern scan, so a rejected text is
    never scanned, sealed or mapped.
    """
    providers = tuple(providers)
    kept = _checked(requests, providers, max_length).filter(F.col("reject_kind").isNull())
    canonical = V.resolve_provider(F.col("provider"), providers)
    return kept.withColumn("provider", canonical).drop("reject_kind")


def error_rows(
    df: DataFrame, kind: Column, at: Column, max_length: int | None = None
) -> DataFrame:
    """``request_id, status, error, message, at`` for rows with a failure kind; no text.

    ``df`` may carry ``provider``; it is named in the message when unsupported.
    """
    error = V.classify_error(kind, max_length)
    message = error["message"]
    if "provider" in df.columns:
        message = F.when(
            kind == "unsupported_provider", V.unsupported_provider_message(F.col("provider"))
        ).otherwise(message)
    return df.select(
        "request_id", error["status"].alias("status"), error["error"].alias("error"),
        V.sanitize_message(message).alias("message"), at.alias("at"),
    )


def rejected_requests(
    requests: DataFrame,
    providers: Iterable[str] = P.PROVIDERS,
    max_length: int | None = None,
    at: Column | None = None,
) -> DataFrame:
    """Rows that fail a check. Order of checks: blank 400, size 413, provider 400."""
    checked = _checked(requests, tuple(providers), max_length)
    failed = checked.filter(F.col("reject_kind").isNotNull())
    at = F.current_timestamp() if at is None else at
    return error_rows(failed, F.col("reject_kind"), at, max_length)


def route_requests(
    requests: DataFrame,
    providers: Iterable[str] = P.PROVIDERS,
    max_length: int | None = None,
    at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: two filters over one input, no shuffle.

    Texts of any length pass unless ``max_length`` asks for the size check.

    Each output reads the input on its own; where both are written, the input can be
    persisted by the caller.
    """
    providers = tuple(providers)
    return (
        accepted_requests(requests, providers, max_length),
        rejected_requests(requests, providers, max_length, at),
    )
