"""A trie of conversation prefixes, encoded as balanced parentheses per shard.

Conversations become paths of turn keys (a digest of role and text) with the words of each turn;
equal paths are counted first. Paths are sorted over the cluster and cut into shards. The trie of a
shard is a sequence of parentheses in preorder, one pair for each node. Blocks of the running excess
keep their minimum in a tree, by which ``findclose`` delimits the subtree of a node; the rank of
pairs "()" counts its leaves, and cumulative arrays over the preorder give its members and savings.

A node lies in several shards only if it is a prefix of what two neighbours end and begin with.
These shared spines are known from the borders of the shards, are left open there and are
merged afterwards; all other nodes are done in their shard. A first turn that a third of all
conversations share is one node of the spines, whatever its subtree holds.

A shard holds the paths of some ``TURNS`` turns. A single conversation must fit into a row by the
keys of its turns (some 50 bytes a turn, texts are not kept).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import partitions, stored, words

#: Turns of a shard, ids of a chunk of a digest's input, positions of a block of excesses.
TURNS = 200_000
IDS = 50_000
BLOCK = 64
COPIED = 3  # turns that a conversation may take over, at most
EVERY = 20
NOBODY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with a tree of the least excess of each block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits == 1, 1, -1))
        blocks = max(1, -(-len(bits) // BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        padded = np.full(self.leaves * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.least = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.least[self.leaves :] = padded.reshape(-1, BLOCK).min(axis=1)
        at = self.leaves
        while at > 1:
            self.least[at // 2 : at] = np.minimum(self.least[at : 2 * at : 2], self.least[at + 1 : 2 * at : 2])
            at //= 2
        pairs = np.zeros(len(bits), np.int64)
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.leaf_rank = np.cumsum(pairs)
        self.open_rank = np.cumsum(bits)

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first position from ``at`` on, in its block, whose excess is the target, or -1."""
        found = np.full(len(at), -1)
        end = np.minimum((at // BLOCK + 1) * BLOCK, len(self.bits))
        open_ = np.arange(len(at))
        while len(open_):
            open_ = open_[at[open_] < end[open_]]
            hit = self.excess[at[open_]] == target[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        return found

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where the pairs that open at ``opens`` close."""
        target = self.excess[opens] - 1
        close = np.empty(len(opens), np.int64)
        inside = (opens + 1) % BLOCK != 0
        close[inside] = self._scan(opens[inside] + 1, target[inside])
        close[~inside] = -1
        far = np.flatnonzero(close < 0)
        if len(far):
            node, wanted = self.leaves + opens[far] // BLOCK, target[far]
            moving = np.arange(len(far))
            while len(moving):  # up, to the next subtree on the right that falls low enough
                at = node[moving]
                right = at & 1 == 1
                at = np.where(right, at >> 1, at + 1)
                node[moving] = at
                moving = moving[right | (self.least[at] > wanted[moving])]
            moving = np.flatnonzero(node < self.leaves)
            while len(moving):  # and down, leftmost first
                left = 2 * node[moving]
                node[moving] = np.where(self.least[left] <= wanted[moving], left, left + 1)
                moving = moving[node[moving] < self.leaves]
            close[far] = self._scan((node - self.leaves) * BLOCK, wanted)
        return close


def _least_of(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of values[low:high] for each range, from tables over powers of two."""
    span = np.frexp(high - low)[1] - 1
    out, table, width = np.empty(len(low), values.dtype), values, 1
    for k in range(int(span.max(initial=0)) + 1):
        at = np.flatnonzero(span == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - width])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2
    return out


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


ROWS = (
    "node binary, depth bigint, parent binary, parent_conv_id bigint, shared boolean, last_words bigint, n_convs bigint, conv_id bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, above array<binary>"
)


def encode(table: pa.Table) -> pa.Table:
    """The nodes of a shard of paths (keys, sizes, n, first, ends_sha256, before, after): whole rows, or for
    ``shared`` nodes what this shard holds of them besides other shared ones."""
    keys = table["keys"].to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys = [keys[i] for i in order]
    sizes, members, first, sha = ([c[i] for i in order] for c in (table[x].to_pylist() for x in ("sizes", "n", "first", "ends_sha256")))
    before, after = table["before"][0].as_py(), table["after"][0].as_py()
    common = [0, *(_common(a, b) for a, b in zip(keys, keys[1:]))]
    depth = [len(k) for k in keys]
    made = np.array([d - c for d, c in zip(depth, common)], np.int64)
    closed = np.array([0, *(d - c for d, c in zip(depth, common[1:]))], np.int64)
    runs = np.stack([closed, made], axis=1).ravel()  # closing, then opening, path by path
    bits = np.repeat(np.tile(np.array([0, 1], np.int8), len(keys)), runs)
    bits = np.r_[np.int8(1), bits, np.zeros(depth[-1] + 1, np.int8)]

    total = 1 + int(made.sum())
    parent, level, size = np.full(total, -1), np.zeros(total, np.int64), np.zeros(total, np.int64)
    own, least, ends = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max), np.empty(total, object)
    name: list[bytes] = [hashlib.md5().digest()] * total
    stack, digests, at = [0], [hashlib.md5()], 1
    shared = np.zeros(total, bool)
    for i, path in enumerate(keys):
        del stack[common[i] + 1 :], digests[common[i] + 1 :]
        for d in range(common[i], depth[i]):
            state = digests[-1].copy()
            state.update(path[d])
            parent[at], level[at], size[at], name[at] = stack[-1], d + 1, sizes[i][d], state.digest()
            stack.append(at)
            digests.append(state)
            at += 1
        last = stack[-1]
        own[last], least[last], ends[last] = members[i], first[i] if first[i] is not None else least[last], sha[i]
        if i == 0 and before is not None:
            shared[stack[: before + 1]] = True
    if after is not None:
        shared[stack[: after + 1]] = True

    tree = Parentheses(bits)
    opens = np.flatnonzero(bits == 1)
    close = tree.findclose(opens)
    end = tree.open_rank[close]  # the subtree of node v is v:end[v] in preorder
    node = np.arange(total)

    def summed(values: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(values)]
        return run[end] - run[node]

    n_convs = summed(own)
    n_leaves = tree.leaf_rank[close] - np.r_[0, tree.leaf_rank][opens]
    n_children = np.bincount(parent[1:], minlength=total)
    saved = summed((n_convs - 1) * size * ~shared)
    conv_id = _least_of(least, node, end)
    if shared.any():  # shared nodes are leaves and children once, when they are merged
        leaf = n_children == 0
        n_leaves = n_leaves - summed(leaf & shared)
        n_children = n_children - np.bincount(parent[1:][shared[1:]], minlength=total)
    above = [None] * total
    for v in np.flatnonzero(shared).tolist():
        above[v] = [*(above[parent[v]] if v else []), name[v]]
    of_shared = np.r_[True, shared[parent[1:]]]
    kind = pa.int64()
    columns = [
        pa.array(name, pa.binary()), pa.array(level), pa.array([name[parent[v]] if v and of_shared[v] else None for v in range(total)], pa.binary()),
        pa.array(conv_id[parent], kind, mask=of_shared), pa.array(shared), pa.array(size), pa.array(n_convs), pa.array(conv_id, kind),
        pa.array(n_children, kind), pa.array(n_leaves, kind), pa.array(saved, kind), pa.array(ends.tolist(), pa.string()), pa.array(above, pa.list_(pa.binary())),
    ]
    return pa.table(columns, [c.split()[0] for c in ROWS.split(", ")])


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): the rebuilt turns of each conversation, as (key, size) in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", key.alias("key"), F.size(words(text)).cast("bigint").alias("size")
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "size"))).alias("turns"))
    own = stored(own.select("conv_id", F.transform("turns", lambda x: F.struct(x["key"], x["size"])).alias("path")), "turns")
    heads = own.filter(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, COPIED).alias("head"))
    copied = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (COPIED + 1)
    with_base = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).join(heads, "base", "left").withColumn("h", copied.cast("int"))
    head = F.when(F.col("head").isNull(), F.slice("path", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return stored(with_base.select("conv_id", F.concat(head, rest).alias("path")), "rebuilt")


def _end(path: Column | str) -> Column:
    return F.md5(F.array_join(F.transform(path, lambda x: F.hex(x["key"])), ""))


def end_digests(members: DataFrame) -> DataFrame:
    """(end, ends_sha256): the digest of the ids of each ``end`` of (end, conv_id), in order and comma-joined.

    Ids are sorted over the cluster and joined to chunks, so a task holds a chunk of an end however many
    conversations end there; the digest then runs over the chunks.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(end)) if end[i] != end[i - 1] or i % IDS == 0), len(end)]
            spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
            rows = [(end[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int64(), pa.string()))], ["end", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for end, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if end != current:
                    if state is not None:
                        out.append((current, state.hexdigest()))
                    current, state = end, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["end", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], ["end", "ends_sha256"])

    n = partitions(members)
    joined = members.repartitionByRange(n, "end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(chunks, "end string, first bigint, ids string")
    return joined.repartition(n, "end").sortWithinPartitions("end", "first").mapInArrow(digests, "end string, ends_sha256 string")


def _bordered(sharded: DataFrame) -> DataFrame:
    """Paths with how many turns the shard's first path shares with what comes before it (``before``)
    and its last path with what follows (``after``); null at the ends. One row per shard is compared."""
    borders = sharded.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    along = Window.orderBy("shard")

    def shared(a: Column, b: Column) -> Column:
        both = F.arrays_zip(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))))
        apart = F.array_position(F.transform(both, lambda x: x["0"]["key"] == x["1"]["key"]), F.lit(False))
        return F.when(a.isNull() | b.isNull(), F.lit(None)).when(apart > 0, apart - 1).otherwise(F.size(both))

    near = borders.withColumn("previous", F.lag("high").over(along)).withColumn("following", F.lead("low").over(along))
    near = near.select("shard", shared(F.col("previous"), F.col("low")).alias("before"), shared(F.col("high"), F.col("following")).alias("after"))
    return sharded.join(near, "shard")


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    Turns are ordered by turn, null first; turns of equal number by the digest of role and text, repeated
    rows are repeated turns. Null roles and texts are empty ones; rows without a conv_id belong to no
    conversation. An empty table has no node, not even a root. Other columns are ignored.
    """
    rebuilt = paths(conversations)
    ends = end_digests(rebuilt.select(_end("path").alias("end"), "conv_id"))
    distinct = rebuilt.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).withColumn("end", _end("path"))
    distinct = stored(distinct.join(ends, "end").drop("end"), "paths")
    if shards is None:
        turns = distinct.agg(F.sum(F.size("path"))).head()[0] or 0
        shards = max(8, -(-turns // TURNS))
    sharded = stored(distinct.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "sharded")
    rows = _bordered(sharded).select(
        "shard", F.col("path.key").alias("keys"), F.col("path.size").alias("sizes"), "n", "first", "ends_sha256",
        F.col("before").cast("int").alias("before"), F.col("after").cast("int").alias("after"),
    )
    nodes = stored(rows.groupBy("shard").applyInArrow(lambda t: encode(t.drop_columns(["shard"])), ROWS), "nodes")

    parts = nodes.filter("shared").groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("last_words").alias("last_words"), F.first("above").alias("above"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    )
    parts = stored(parts, "spines")
    children = parts.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    parts = parts.join(children, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    parts = stored(parts.drop("more"), "spines")
    below = parts.select(
        F.explode("above").alias("node"), ((F.col("n_convs") - 1) * F.col("last_words")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf")
    ).groupBy("node").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    full = parts.join(below, "node").withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("saved"))
    named = parts.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256")]
    done = nodes.filter(~F.col("shared"))
    inside = done.filter(F.col("parent").isNull()).select(*columns)
    under = done.filter(F.col("parent").isNotNull()).join(named, "parent").withColumn("parent_conv_id", F.col("parent_conv")).select(*columns)
    spine = full.join(named, "parent", "left").withColumn("parent_conv_id", F.col("parent_conv")).select(*columns)
    return inside.unionAll(under).unionAll(spine)


SQL = r"""
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS whole,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id AS c, list({'k': md5(whole), 's': size} ORDER BY turn NULLS FIRST, md5(whole)) AS path FROM turns GROUP BY conv_id
), crc AS (
    SELECT c, 0 AS k, 4294967295::BIGINT AS v FROM own
    UNION ALL
    SELECT c, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
    FROM (SELECT c, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(c::VARCHAR, k // 8 + 1, 1))) ELSE v END AS x
          FROM crc WHERE k < 8 * length(c::VARCHAR))
), taken AS (
    SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE k = 8 * length(c::VARCHAR)
), rebuilt AS (
    SELECT o.c, list_concat(coalesce(list_slice(b.path, 1, h), []), list_slice(o.path, h + 1, len(o.path))) AS path
    FROM own o JOIN taken USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 20
), members AS (
    SELECT c, len(path) AS full_depth, d, array_to_string(list_transform(list_slice(path, 1, d), lambda x: x.k), '') AS id,
        CASE WHEN d = 0 THEN 0 ELSE path[d].s END AS size
    FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT id, d, min(c) AS conv_id, count(*) AS n, any_value(size) AS size,
        coalesce(string_agg(CASE WHEN full_depth = d THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends
    FROM members GROUP BY id, d
), counted AS (
    SELECT a.id, a.d, a.conv_id, a.n, a.ends, count(b.id) AS children
    FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND substr(b.id, 1, 32 * a.d::INT) = a.id GROUP BY ALL
), below AS (
    SELECT a.id, count(*) FILTER (c.children = 0) AS leaves, sum((b.n - 1) * b.size) AS saved
    FROM nodes a JOIN nodes b ON b.d >= a.d AND starts_with(b.id, a.id) JOIN counted c ON c.id = b.id GROUP BY a.id
)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.children AS n_children, leaves AS n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM counted x JOIN below USING (id) LEFT JOIN nodes p ON x.d > 0 AND p.d = x.d - 1 AND p.id = substr(x.id, 1, 32 * (x.d::INT - 1))
"""
