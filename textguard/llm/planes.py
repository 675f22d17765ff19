"""Token ids in byte-plane blocks.

Ids are written in ascending order of doc_id as 32-bit little-endian numbers, in blocks of a fixed
number of ids. A block is transposed to four byte planes, each compressed by zstandard: high bytes
are nearly constant and cost next to nothing. Beside its planes a block has its entry of the chunk
index: where it stands, and which documents or parts of documents it holds. A part of the output
is one range of ids; parts are Parquet files of blocks, so they are committed as a whole by any
store that Spark writes to, and the index can be read without the planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.llm.tokens import encoded

BLOCK_IDS = 65_536
LEVEL = 3
WIDTH = 4

SCHEMA = (
    "part int, block int, start long, n_ids int, planes array<binary>, "
    "docs array<struct<ordinal:long,doc_id:long,total:long,before:long,count:int>>"
)

ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int32()),
    ("planes", pa.list_(pa.binary())),
    ("docs", pa.list_(pa.struct([
        ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("total", pa.int64()), ("before", pa.int64()), ("count", pa.int32()),
    ]))),
])


def to_planes(ids: bytes) -> list[bytes]:
    rows = np.frombuffer(ids, np.uint8).reshape(-1, WIDTH)
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(np.ascontiguousarray(plane).tobytes()) for plane in rows.T]


def from_planes(planes: list[bytes]) -> bytes:
    unpack = zstandard.ZstdDecompressor().decompress
    return np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes], axis=1).tobytes()


class _Blocks:
    """Cuts the ids of one part into blocks."""

    def __init__(self, part: int, size: int):
        self.part, self.size = part, size
        self.block = self.start = self.ordinal = self.held = 0
        self.bytes: list[bytes] = []
        self.docs: list[dict] = []

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[dict]:
        total, before = len(ids) // WIDTH, 0
        while before < total:
            count = min(total - before, self.size - self.held)
            self.bytes.append(ids[WIDTH * before : WIDTH * (before + count)])
            self.docs.append({"ordinal": self.ordinal, "doc_id": doc_id, "total": total, "before": before, "count": count})
            self.held += count
            before += count
            if self.held == self.size:
                yield self.flush()
        self.ordinal += 1

    def flush(self) -> dict:
        row = {
            "part": self.part, "block": self.block, "start": self.start, "n_ids": self.held,
            "planes": to_planes(b"".join(self.bytes)), "docs": self.docs,
        }
        self.block, self.start, self.held = self.block + 1, self.start + self.held, 0
        self.bytes, self.docs = [], []
        return row


def write_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text of ``docs`` (doc_id, text), end it with ``end_id`` and write the blocks.

    Null and empty texts are the end id alone; null doc_ids come first; rows with equal ids stand
    by their texts; other columns are ignored; an empty table writes no block.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(TaskContext.get().partitionId(), block_ids)
        for batch in batches:
            ids = encoded(tokenizer, batch.column(1).to_pylist())
            for doc_id, found in zip(batch.column(0).to_pylist(), ids):
                for row in blocks.add(doc_id, found + end):
                    yield pa.RecordBatch.from_pylist([row], ARROW)
        if blocks.held:
            yield pa.RecordBatch.from_pylist([blocks.flush()], ARROW)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start_in_part, n_tokens, ids) of every document, from the blocks.

    Documents within one block come straight from it; only those that reach over the end of a
    block are gathered, by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = {name: batch.schema.get_field_index(name) for name in batch.schema.names}
            for n in range(batch.num_rows):
                ids = from_planes(batch.column(place["planes"])[n].as_py())
                docs = pa.RecordBatch.from_struct_array(batch.column(place["docs"])[n].values)
                count, before = docs.column("count").to_numpy(), docs.column("before").to_numpy()
                ends = np.cumsum(count.astype(np.int64))
                begins = ends - count
                start = batch.column(place["start"])[n].as_py()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(ends), batch.column(place["part"])[n].as_py(), np.int32)),
                    "ordinal": docs.column("ordinal"), "doc_id": docs.column("doc_id"),
                    "start_in_part": pa.array(start + begins - before), "n_tokens": docs.column("total"),
                    "before": docs.column("before"),
                    "ids": pa.array([ids[a:b] for a, b in zip((WIDTH * begins).tolist(), (WIDTH * ends).tolist())], pa.binary()),
                })

    pieces = spark.read.schema(SCHEMA).parquet(path).mapInArrow(
        run, "part int, ordinal long, doc_id long, start_in_part long, n_tokens long, before long, ids binary"
    )
    key = ["part", "ordinal", "doc_id", "start_in_part", "n_tokens"]
    whole = F.octet_length("ids") == WIDTH * F.col("n_tokens")
    parts = F.array_sort(F.collect_list(F.struct("before", "ids")))
    gathered = pieces.filter(~whole).groupBy(*key).agg(parts.alias("parts")).select(
        *key, F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")
    )
    return pieces.filter(whole).select(*key, "ids").unionAll(gathered).drop("ordinal")


def with_starts(documents: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``start`` in place of part and start_in_part: the number of ids of all documents before."""
    parts = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    placed = documents.join(first, "part").withColumn("start", F.col("first") + F.col("start_in_part"))
    return placed.drop("part", "first", "start_in_part")
