"""What goes out to a reply provider and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions import replies as R
from textguard.functions.binding import attach
from textguard.operators.routing import error_rows


def outbound(analyzed: DataFrame) -> DataFrame:
    """The only columns that may leave: ``request_id, provider, masked_text``."""
    return analyzed.select(
        "request_id", "provider", F.col("analysis.masked_text").alias("masked_text")
    )


def provider_requests(
    sent: DataFrame,
    openai_model: str = P.OPENAI_MODEL,
    anthropic_model: str = P.ANTHROPIC_MODEL,
) -> DataFrame:
    """JSON request body per row of an outbound table: ``request_id, provider, body``."""
    masked = F.col("masked_text")
    body = F.when(
        F.col("provider") == "openai", R.openai_request(masked, openai_model)
    ).when(F.col("provider") == "anthropic", R.anthropic_request(masked, anthropic_model))
    return sent.filter(F.col("provider").isin("openai", "anthropic")).select(
        "request_id", "provider", body.alias("body")
    )


def export_provider_requests(sent: DataFrame, provider: str, path: str) -> None:
    """Write one provider's request bodies as JSON lines."""
    bodies = provider_requests(sent).filter(F.col("provider") == provider)
    bodies.select("body").write.text(path)


def mock_replies(sent: DataFrame) -> DataFrame:
    """The built-in stand-in provider: ``request_id, provider, response_text``."""
    return sent.select(
        "request_id", "provider", R.mock_reply(F.col("masked_text")).alias("response_text")
    )


def _parsed(bodies: DataFrame) -> DataFrame:
    # of a key that an object repeats the last counts; the parser asks the session
    bodies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    body = F.col("body")
    text = F.when(F.col("provider") == "openai", R.extract_openai_text(body)).when(
        F.col("provider") == "anthropic", R.extract_anthropic_text(body)
    )
    return attach(bodies, "response_text", text).select("request_id", "provider", "response_text")


def parse_replies(
    bodies: DataFrame, at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(replies, rejects)`` from reply bodies; one without usable text is a 502."""
    parsed = _parsed(bodies)
    at = F.current_timestamp() if at is None else at
    missing = parsed.filter(F.col("response_text").isNull())
    return (
        parsed.filter(F.col("response_text").isNotNull()),
        error_rows(missing, F.lit("provider_failure"), at),
    )
