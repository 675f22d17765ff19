"""A content-addressed archive of WARC records.

``write_archive`` splits records into two Parquet tables: ``payloads`` holds each payload once
under its SHA-256, ``headers`` holds each record's header block byte for byte with the digest of
its payload. ``read_archive`` verifies every payload against its digest, once, and joins the two
to the original records. ``export_warc`` writes them as standard WARC files.

Payload digests are what is shuffled to find repeats, with the smallest id added up before the
shuffle; a payload that a third of all records share is therefore one row per task. In the join
that puts records together again a hot digest is split by adaptive execution; without the payload
column that join carries two numbers per payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """The rows of pages (page_id, url, html) with payload and digest, and what their headers say.

    Of records with equal payloads of at least ``min_revisit`` bytes those with the smallest
    page_id are responses and the others revisit it. A null html is an empty payload; rows
    without a page_id are responses, as nothing can refer to them; a row that comes twice gives
    two records. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    firsts = (
        rows.filter(F.col("n") >= min_revisit).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("times"))
        .filter("times > 1").drop("times")
    )
    # Digests first, payloads later: the join below must not carry the html.
    marked = (
        rows.select("page_id", "url", "digest", "n")
        .join(firsts, "digest", "left")
        .withColumn("revisits", F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False)))
    )
    return rows, marked


def header_block(marked: DataFrame) -> Column:
    """The exact header bytes, up to and with the empty line. Of a revisit, whose block is empty,
    they say where the payload is."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    revisits = F.col("revisits")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", uri)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisits,
            F.concat(line("WARC-Refers-To", record_id(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE))),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisits, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(CRLF),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str) -> None:
    """Write the records of ``pages`` as an archive below ``path``."""
    rows, marked = page_records(pages)
    marked.select(header_block(marked).alias("header"), "digest").write.parquet(f"{path}/headers")
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.parquet(f"{path}/payloads")


def field(header: Column, name: str) -> Column:
    """A header field, or null."""
    found = F.regexp_extract(header.cast("string"), f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.nullif(found, F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, digest, payload, payload_bytes): the original records.

    ``payload`` is the full payload, of revisits too. Fails if a payload does not have the digest
    it is stored under, or if one is missing.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    verified = payloads.select(
        F.col("digest").alias("stored"), "payload",
        F.when(right, F.octet_length("payload").cast("long"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("long"))
        .alias("payload_bytes"),
    )
    joined = headers.join(verified, F.col("digest") == F.col("stored"), "left")
    whole = F.when(F.col("stored").isNotNull(), F.col("payload_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("long")
    )
    return joined.select("header", "digest", "payload", whole.alias("payload_bytes"))


def parsed(records: DataFrame) -> DataFrame:
    """One row per record: what its header says, beside size and digest of the full payload."""
    number = lambda name: F.regexp_extract(field(F.col("header"), name), "^<urn:page:(-?[0-9]+)>$", 1)
    return records.select(
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        field(F.col("header"), "WARC-Type").alias("record_type"),
        F.nullif(number("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files: the end of a record is two line ends, which the text writer
    puts after every row."""
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    whole = F.concat(F.col("header"), block).cast("string")
    records.select(whole.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
r AS (SELECT *, coalesce(payload_bytes >= 100 AND page_id > first_id, false) AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to FROM r
"""
