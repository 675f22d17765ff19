"""Texts and requests derived from the given tables; every row and the whole text."""

from __future__ import annotations

import base64
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.binding import attach
from textguard.functions.sealing import key_from_env

# Values are sealed with the key from the environment, else with one made per process.
KEY = key_from_env() or base64.b64encode(os.urandom(32)).decode()
OTHER_KEY = base64.b64encode(os.urandom(32)).decode()

PARTITIONS = "spark.textguard.input.partitions"
NOTES_PER_TASK = 10_000
AT_SECONDS = 1_704_067_200  # 2024-01-01 00:00:00 UTC
NOW_SECONDS = AT_SECONDS + 15 * 60

# A text for each customer holding every type, an e-mail repeated in other case, cards
# that fail the checksum and octets above 255.
CASE_NOTE = """
'Mail user' || cast(c_custkey as string) || '@example.com or USER'
  || cast(c_custkey as string) || '@EXAMPLE.COM, call +1 (555) 123-'
  || lpad(cast(c_custkey % 10000 as string), 4, '0') || ', SSN '
  || lpad(cast(c_custkey % 1000 as string), 3, '0') || '-'
  || lpad(cast(c_custkey % 100 as string), 2, '0') || '-'
  || lpad(cast(c_custkey % 10000 as string), 4, '0') || ', card '
  || case c_custkey % 3 when 0 then '4111 1111 1111 1111' when 1 then '378282246310005'
     else '4111 1111 1111 1112' end
  || ', host 10.' || cast(c_custkey % 300 as string) || '.8.1, see https://example.com/c/'
  || cast(c_custkey as string) || '?id=1.'
"""


def at() -> Column:
    return F.timestamp_seconds(F.lit(AT_SECONDS))


def now() -> Column:
    return F.timestamp_seconds(F.lit(NOW_SECONDS))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns. A session that reads files of one row group can ask for more tasks
    with ``spark.textguard.input.partitions``; without it a scan stays as it is."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    parts = spark.conf.get(PARTITIONS, None)
    return rows.repartition(int(parts)) if parts else rows


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, text`` of a note for each customer.

    Hundreds of thousands of keys fit into one row group, which one task would read, and a note is worth
    half a millisecond of detection. So the keys, not the notes, are dealt out by their number.
    """
    customers = table(spark, sf_dir, "customer", "c_custkey")
    if not spark.conf.get(PARTITIONS, None):
        tasks = -(-customers.count() // NOTES_PER_TASK)
        customers = customers.repartition(max(tasks, spark.sparkContext.defaultParallelism))
    return attach(customers, "text", F.expr(CASE_NOTE)).select(
        _ids("note", "c_custkey").alias("request_id"), "text"
    )


def _ids(prefix: str, *columns: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[F.col(c).cast("string") for c in columns])


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, text`` of all documents, pages, page addresses, turns and notes."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    parts = [
        documents.select(_ids("doc", "doc_id").alias("request_id"), "text"),
        pages.select(_ids("page", "page_id").alias("request_id"), F.col("html").alias("text")),
        pages.select(_ids("url", "page_id").alias("request_id"), F.col("url").alias("text")),
        turns.select(_ids("turn", "conv_id", "turn").alias("request_id"), "text"),
        notes(spark, sf_dir),
    ]
    texts = parts[0]
    for part in parts[1:]:
        texts = texts.unionByName(part)
    return texts


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, text, provider``: every text with a known, partly odd-cased provider, and
    beside them requests with an unknown or blank provider or without a text."""
    size = F.length("text")
    provider = (
        F.when(size % 11 == 0, F.lit(" OpenAI ")).when(size % 11 == 1, F.lit("ANTHROPIC"))
        .otherwise(F.lit("mock"))
    )
    unusable = F.when(size % 11 == 2, F.lit("unknown-provider")).when(size % 11 == 3, F.lit(" \t "))

    def made(prefix: str, text: Column, by: Column) -> Column:
        name = F.concat(F.lit(prefix), "request_id")
        return F.struct(name.alias("request_id"), text.alias("text"), by.alias("provider"))

    def only(wanted: Column, row: Column) -> Column:
        return F.when(wanted, row)

    nothing = F.when(size % 13 == 0, F.lit(" \n\t "))
    rows = F.array_compact(F.array(
        made("", F.col("text"), provider),
        only((size % 11).isin(2, 3), made("provider-", F.col("text"), unusable)),
        only((size % 13).isin(0, 1), made("text-", nothing, provider)),
    ))
    return all_texts(spark, sf_dir).select(F.explode(rows).alias("r")).select("r.*")
