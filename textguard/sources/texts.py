"""Reading texts and requests, writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators.routing import error_rows

REQUEST_SCHEMA = "request_id string, text string, provider string"
RESULT_COLUMNS = (
    "request_id", "original_text", "processed_text", "provider", "status", "detections",
    "response",
)


def read_texts(
    spark: SparkSession,
    path: str,
    id_col: str = "request_id",
    text_col: str = "text",
    provider: str | Column = "provider",
    fmt: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """``request_id, text, provider`` from a table with an id and a text column.

    ``provider`` is a column name or expression. Only the named columns are read.
    """
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(path)
    provider = F.col(provider) if isinstance(provider, str) else provider
    return rows.select(id_col, text_col, provider.alias("provider")).select(
        F.col(id_col).cast("string").alias("request_id"), F.col(text_col).alias("text"),
        "provider",
    )


def read_json_requests(
    spark: SparkSession, path: str, at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """JSON-lines requests as ``(requests, rejects)``; unparsable lines are rejected.

    Lines are read as text and parsed by a column, so that the corrupt-record marker
    needs no cache. A request without an id gets a digest of its line, its file and its place in
    the scan, so equal lines stay apart; the same files give the same ids within a session.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    spec = REQUEST_SCHEMA + ", _corrupt string"
    parsed = lines.select(
        "value",
        F.from_json(
            "value", spec, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        ).alias("r"),
        F.input_file_name().alias("file"),
        F.monotonically_increasing_id().cast("string").alias("place"),
    )
    row_id = F.coalesce("r.request_id", F.sha2(F.concat_ws("\0", "file", "place", "value"), 256))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    good = parsed.filter(~broken).select(row_id.alias("request_id"), "r.text", "r.provider")
    bad = parsed.filter(broken).select(row_id.alias("request_id"))
    at = F.current_timestamp() if at is None else at
    return good, error_rows(bad, F.lit("bad_input"), at)


def write_results(
    results: DataFrame, path: str, expose_raw: bool = False, mode: str = "errorifexists"
) -> None:
    """Write results in a fixed column order; raw text and values only on request."""
    if expose_raw:
        results.select(*RESULT_COLUMNS).write.mode(mode).parquet(path)
    else:
        without_raw(results).write.mode(mode).parquet(path)


def without_raw(results: DataFrame) -> DataFrame:
    """Results without the original text and the detected values."""
    places = F.transform(
        "detections",
        lambda d: F.struct(
            d["type"].alias("type"), d["start"].alias("start"), d["end"].alias("end")
        ),
    )
    kept = [c for c in RESULT_COLUMNS if c != "original_text"]
    return results.withColumn("detections", places).select(*kept)
