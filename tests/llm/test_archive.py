"""The archive gives back every record byte for byte."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from textguard.llm import warc
from textguard.sources.storage import new_path

LONG = "<p>" + "x" * 120 + "</p>"
ROWS = [
    (1, "u1", LONG, "a"), (2, "u2", LONG, "b"), (3, None, LONG, "c"), (4, "u4", "short", "d"), (5, "u5", "short", "e"),
    (6, "u6", None, "f"), (7, "u7", "", "g"), (8, "a\r\nb", "é" * 60, "h"), (2, "u2", LONG, "b"), (None, "u9", LONG, "i"),
    (10, "u10", "y" * 3_000_000, "j"), (11, "u11", "\r\n\r\nWARC/1.1\r\n" * 20, "k"),
]


@pytest.fixture(scope="module")
def archive(spark):
    path = new_path(spark, "archive")
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")
    warc.write_archive(pages, path)
    return path


def test_rows(spark, archive):
    got = sorted((tuple(r) for r in warc.parsed(warc.read_archive(spark, archive)).collect()), key=str)
    wanted = []
    for page, _, html, _ in ROWS:
        b = (html or "").encode()
        first = min(p for p, _, h, _ in ROWS if p is not None and (h or "") == (html or ""))
        again = page is not None and len(b) >= 100 and page > first
        wanted.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(wanted, key=str)


def test_payloads_are_stored_once_and_come_back(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == len({h or "" for _, _, h, _ in ROWS})
    records = warc.read_archive(spark, archive)
    got = sorted(bytes(r.payload) for r in records.select("payload").collect())
    assert got == sorted((h or "").encode() for _, _, h, _ in ROWS)


def test_damage_is_noticed(spark, archive):
    path = new_path(spark, "damaged")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{archive}/payloads")
    payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, path).select("payload_bytes").collect()


def test_standard_files(spark, archive):
    path = new_path(spark, "warc") + uuid.uuid4().hex
    warc.export_warc(warc.read_archive(spark, archive).filter("digest is not null").repartition(1), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/*.gz").select("content").collect())
    import gzip

    data, at, seen = gzip.decompress(data), 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end].decode()
        assert head.startswith("WARC/1.1\r\n")
        n = int(head.split("Content-Length: ")[1].split("\r\n")[0])
        if "WARC-Type: response" in head:
            assert f"sha256:{hashlib.sha256(data[end:end + n]).hexdigest()}" in head
        assert data[end + n : end + n + 4] == b"\r\n\r\n"
        seen.append(head)
        at = end + n + 4
    assert len(seen) == len(ROWS)


def test_empty(spark):
    path = new_path(spark, "empty")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0
