"""Two-pass external shuffle into shards.

First pass: a seeded hash scatters the rows uniformly over buckets of a memory size. Second pass:
a seeded Fisher-Yates shuffle of the numbers of a bucket's rows gives each row its final place
there, and the rows are sorted by place and written. The buckets one after another are the whole
order, which is cut into shards whose row counts differ by one at most.

Neighbouring buckets lie in one partition, so few files are written. Texts are shuffled once and
written once, and never gathered in arrays. What is known of a bucket is one count, so the sums
that place the buckets are over as many rows as there are buckets. A text with very many copies
is no hot key: the hash takes in the id. Rows that agree in id and in text share a bucket; one
that they make longer than ``LONGEST`` rows is shuffled in stretches of that length.

Null texts have size 16 and checksum null; null ids are scattered by their text; an empty table
gives empty shards; other input columns are written along with the rows, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.functions.binding import bind
from textguard.llm.common import moved_aside, private

SHARDS = 40
SEED = 20_241
PART_BYTES = 64 << 20
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 4096  # buckets have about so many rows at most
LONGEST = 2 * BUCKET_ROWS  # further than chance takes a bucket of different rows
OVERHEAD = 16


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def permutation(n: Column, *key: Column) -> Column:
    """A seeded Fisher-Yates shuffle of 0 to n-1, built inside out: entry i goes to a drawn place
    and what stood there moves to the end. ``key`` and i decide the draws, nothing else does."""

    def step(done: Column, i: Column) -> Column:
        drawn = F.pmod(F.xxhash64(*key, i), i.cast("long") + 1).cast("int")
        return bind(
            drawn,
            lambda at: F.when(at == i, F.concat(done, F.array(i))).otherwise(
                F.concat(
                    F.slice(done, 1, at), F.array(i), F.slice(done, at + 2, i - at - 1),
                    F.array(F.get(done, at)),
                )
            ),
        )

    start = F.array(F.lit(0))
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), n - 1), start, step)).otherwise(start)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write ``docs`` (doc_id, text and any others) as Parquet below ``path``; read it back.

    The rows are partitioned by ``shard`` and carry ``slot``, ``size`` and ``text_crc32``; input
    columns of these names are written with trailing underscores.
    """
    docs = moved_aside(docs, ("shard", "slot", "size", "text_crc32", "law", "grown_shard"))
    held = docs.columns
    key, part, bucket, n, at, upto, full, rest, of_part, of_bucket = map(
        private, ("key", "part", "bucket", "n", "at", "upto", "full", "rest", "of_part", "of_bucket")
    )
    total = docs.agg(F.count("*").alias("n"), F.sum(size_of(F.col("text"))).alias("bytes")).head()
    count, size = max(1, total["n"]), total["bytes"] or 0
    parts = max(1, -(-size // PART_BYTES), min(shards, total["n"]))
    each = max(1, -(-size // (BUCKET_BYTES * parts)), -(-count // (BUCKET_ROWS * parts)))
    scattered = docs.withColumn("text_crc32", F.crc32("text")).withColumn(
        key, F.xxhash64(F.lit(seed), "doc_id", "text_crc32")
    ).withColumn(bucket, F.expr(f"cast(pmod(shiftright({key}, 8), {parts * each}) as int)"))
    in_part = F.expr(f"cast({bucket} div {each} as int)")

    counts = scattered.groupBy(bucket).agg(F.count("*").alias(n))
    before = F.sum(n).over(W.orderBy(bucket)) - F.col(n)
    placed = counts.withColumn(upto, before).withColumn(of_part, in_part).repartitionById(parts, of_part)
    draws = F.lit(seed), F.col(bucket)
    placed = placed.select(
        of_part, F.col(bucket).alias(of_bucket), n, upto,
        F.when(F.col(n) >= LONGEST, permutation(F.lit(LONGEST), *draws, F.lit(0))).alias(full),
        permutation(F.expr(f"cast({n} % {LONGEST} as int)"), *draws, F.lit(1)).alias(rest),
    )
    numbered = (
        scattered.withColumn("size", size_of(F.col("text")))
        .withColumn(part, in_part)
        .repartitionById(parts, part)
        .withColumn(at, F.row_number().over(W.partitionBy(part, bucket).orderBy(key, "doc_id", "text")) - 1)
    )
    # Both sides are dealt by partition number already: the join moves nothing.
    joined = numbered.join(
        placed.hint("merge"), (F.col(part) == F.col(of_part)) & (F.col(bucket) == F.col(of_bucket))
    )
    within = F.col(at) % LONGEST
    stretch = F.expr(f"{at} div {LONGEST}")
    drawn = F.when(stretch < F.expr(f"{n} div {LONGEST}"), F.get(full, within)).otherwise(F.get(rest, within))
    out = joined.select(*held, "size", "text_crc32", (F.col(upto) + stretch * LONGEST + drawn).alias(at))
    # Shard s holds places ceil(s * n / shards) up to the next such bound.
    out = out.withColumn("shard", F.expr(f"cast({at} * {shards} div {count} as int)"))
    first = F.expr(f"(shard * cast({count} as bigint) + {shards} - 1) div {shards}")
    out = out.withColumn("slot", F.col(at) - first).drop(at)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
