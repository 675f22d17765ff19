"""Near-duplicates by SimHash fingerprints, searched in BK-trees.

A fingerprint is one or more 64-bit words. Equal fingerprints are one node. A shard is what
agrees in some blocks of bits: each shard has a tree of its own, which only the fingerprints of
the shard are searched in. With one word and ``radius + 2`` blocks any two fingerprints within the
radius agree in two blocks, so no link is missed; with more words the radius holds for all bits
together. Blocks that must agree hold 24 bits or more, so fingerprints that are not alike hardly
ever meet, however many there are.

The trees travel to their queries by the shard key: sending every tree to every task would grow
with the corpus. A shard with more than ``TREE`` fingerprints has several trees, and its
fingerprints meet them in cells of two chunks, so no task holds more than two chunks of a shard.
A cell gives one link per fingerprint, to the first of its component there, which keeps every
connection without listing the pairs of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.bktree import Forest, union
from textguard.llm.common import private, stored
from textguard.llm.components import components
from textguard.llm.groups import whole_groups

SEED = 42
TREE = 16_384
BLOCK = 1 << 16


@dataclass(frozen=True)
class Settings:
    """Words per shingle, words per fingerprint, differing bits allowed, bit blocks per word, and
    how many blocks agree in a shard."""

    shingle: int = 3
    words: int = 1
    radius: int = 3
    blocks: int = 5
    agree: int = 2

    @property
    def columns(self) -> list[str]:
        return [f"fp{i}" for i in range(self.words)]


#: Links at 3 bits, all of them.
EXACT = Settings()

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words than a shingle are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([_hash(b" ".join(words))], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(_hash, runs), np.uint64, len(words) - size + 1)


def remixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a further word of the fingerprint; word 0 takes them as they are."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, settings: Settings = EXACT) -> np.ndarray:
    """The words of the fingerprint of a whole text: a bit is 1 if set in over half the hashes.
    A text without words gives zeros."""
    hashes = shingle_hashes((text or "").encode().lower().split(), settings.shingle)
    ones = np.zeros((settings.words, 64), np.int64)
    for i in range(0, len(hashes), BLOCK):
        for word in range(settings.words):
            part = remixed(hashes[i : i + BLOCK], word)
            bits = np.unpackbits(part[:, None].view(np.uint8), axis=1, bitorder="little")
            ones[word] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, settings: Settings = EXACT) -> DataFrame:
    """doc_id and the words of the fingerprint, for every row."""
    names = ["doc_id", *settings.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, settings) for t in batch.column(1).to_pylist()], np.uint64)
            found = found.reshape(batch.num_rows, settings.words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in settings.columns)
    )


def shard_keys(settings: Settings) -> Column:
    """One key per choice of blocks."""
    bounds = [64 * i // settings.blocks for i in range(settings.blocks + 1)]
    value = [
        F.shiftrightunsigned(F.shiftleft(c, 64 - b), 64 - b + a)
        for c in settings.columns for a, b in zip(bounds, bounds[1:])
    ]
    chosen = [c for c in combinations(range(len(value)), settings.agree)]
    return F.array(*[F.xxhash64(F.lit(n), *[value[i] for i in c]) for n, c in enumerate(chosen)])


def links(prints: DataFrame, settings: Settings = EXACT, tree: int = TREE) -> DataFrame:
    """(a, b): links between the nodes of ``prints`` (node and the words of the fingerprint)
    which connect all that lie within the radius of each other."""
    names = ["node", *settings.columns]
    keyed = prints.select("node", F.explode(shard_keys(settings)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunk = F.expr(f"cast(pmod(xxhash64(node), (n + {tree} - 1) div {tree}) as int)")
    cells = (
        keyed.join(sizes, "key").withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {tree} as int)"))))
        .select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node")
        .join(prints.select(*names), "node")  # only what is not alone in a shard needs its words
    )
    radius, columns = settings.radius, settings.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "i", "j"], BLOCK):
            key, i, j, chunk, node = (table[c].to_numpy() for c in ("key", "i", "j", "chunk", "node"))
            prints = np.stack([table[c].to_numpy() for c in columns], axis=1).view(np.uint64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.cumsum(new)
            trees, asked = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            label = np.arange(len(node))
            forest = Forest(group[trees], prints[trees])
            for query, found in forest.within(group[asked], prints[asked], radius):
                label = union(label, asked[query], trees[found])
            linked = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["a", "b"])

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, settings: Settings = EXACT) -> DataFrame:
    """doc_id, the words of the fingerprint, and component_id: the smallest doc_id that links lead to.

    Texts without words have fingerprint 0 and are linked like others. Null ids count for no
    component; a component of null ids alone has id null. Repeated rows come back as often; an
    empty table gives an empty result; other columns are ignored.
    """
    fp = settings.columns
    node = F.col("fp0") if settings.words == 1 else F.xxhash64(*fp)
    each = stored(fingerprints(docs, settings).withColumn("node", node), "fingerprints")
    firsts = each.groupBy("node", *fp).agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("node", *fp), settings))
    rooted = firsts.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select(
        "node", "first", F.coalesce("root", "node").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "root").select("node", "component_id").distinct()
    return each.join(known, "node").select("doc_id", *fp, "component_id")


def deduplicated(docs: DataFrame, settings: Settings = EXACT) -> DataFrame:
    """The rows of ``docs`` of which no other document of their group has a smaller id.

    A group is what links of fingerprints connect, see ``near_duplicates``. Of rows with equal ids
    one stays; rows without an id stay.
    """
    found = near_duplicates(docs, settings)
    first = private("first")
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(first)).distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col(first), "left_semi")
    return named.dropDuplicates(["doc_id"]).unionAll(docs.filter(F.col("doc_id").isNull()))
