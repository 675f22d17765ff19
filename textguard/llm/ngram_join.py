"""Documents whose sets of word n-grams agree (Jaccard), joined by vertical partitioning.

All n-grams that can matter have one global order, rare ones first, and the order is cut into
fragments that hold about equally many occurrences. Each set falls into one segment per fragment;
the overlap of two sets is counted fragment by fragment and the partial counts of a pair are
summed, so no task ever holds two whole sets.

What comes before the fragments keeps nearly all texts out of them, without losing a link:

* Equal sets are one node. A node of which more than a tenth of the n-grams stand nowhere else can
  link with nothing. For most this shows in a quarter of the hashes: n-grams of that quarter are
  counted over all nodes, by ranges of their hashes. What is left is counted once more and in full.
* Two sets that agree share one of the first n-grams of both (of n, the first n - ceil(0.9n) + 1).
  A posting holds the nodes that begin with one n-gram. In rounds, every node of a posting is paired
  with one hub of it, links make components, and nodes of one component are never paired again: a
  large group of near copies gives one pair per copy, not all pairs. Once no more pairs are open than a
  task can go through, all of different components are compared by what they hold in each of
  ``PARTS`` ranges of hashes, which bounds their overlap, and those within it are counted, so the
  rounds never decide what is found. Postings are dealt to cells of two chunks.

Every step reads a table that the step before it wrote, so a lost executor costs one step.
Numbers of n-grams and nodes are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import partitions, stored
from textguard.llm.components import components
from textguard.llm.groups import whole_groups

SIZE = 3
PERCENT = 90
FRAGMENTS = 8
#: n-grams that a task counts at once, and that a task gathers before it sends them.
BUCKET = 4_000_000
LEAST_BUCKETS = 16
GATHER = 1_000_000
#: The part of all hashes that is counted first, and the ranges whose sizes bound an overlap.
QUARTER = np.uint64(1 << 62)
PARTS = 64
#: Open pairs per row of a posting up to which all are compared.
COMPARED = 256
KEY_BYTES = 5  # of an n-gram's hash within its bucket; equal ones by chance only let a node stay longer
CHUNK = 4_096
BLOCK = 1 << 16
ROUNDS = 6

_hash = xxhash.xxh64_intdigest


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a whole text, A-Z lower-cased; fewer words than
    ``size`` are one n-gram, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([_hash(b" ".join(words), seed=size)], np.uint64)
    each = np.fromiter(map(_hash, words), np.uint64, len(words))
    n = len(words) - size + 1
    found = np.full(n, size, np.uint64)
    for i in range(size):
        found = _mix(found + each[i : i + n])
    return np.unique(found)


def node_of(found: np.ndarray) -> int | None:
    """The number of a set, signed."""
    value = _hash(found.tobytes())
    return None if not len(found) else value - (value >> 63 << 64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(30)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _short(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _long(parts: list[bytes]) -> np.ndarray:
    short = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, KEY_BYTES)
    keys = np.zeros((len(short), 8), np.uint8)
    keys[:, :KEY_BYTES] = short
    return keys.view("<u8")[:, 0]


def _packed(sets: list[np.ndarray], nodes: list[int], buckets: int) -> Iterator[tuple]:
    """(bucket, keys that one set has, its sets' numbers and how many keys each, keys that more have)."""
    keys, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(keys, kind="stable")
    start = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    n = np.diff(np.r_[start, len(keys)])
    more = keys[order][start[n > 1]]
    alone = np.ones(len(keys), bool)
    alone[order[np.repeat(n > 1, n)]] = False
    keys, of = keys[alone], of[alone]
    at = _bucket(keys, buckets)
    order = np.argsort(at, kind="stable")
    keys, of, at = keys[order], of[order], at[order]
    cut = np.searchsorted(at, np.arange(buckets + 1))
    more_cut = np.searchsorted(_bucket(more, buckets), np.arange(buckets + 1))
    known = np.array(nodes, np.int64)
    for b in np.flatnonzero((np.diff(cut) > 0) | (np.diff(more_cut) > 0)).tolist():
        part = slice(cut[b], cut[b + 1])
        run = np.flatnonzero(np.diff(of[part], prepend=-1))
        counts = np.diff(np.r_[run, cut[b + 1] - cut[b]]).astype(np.int32)
        yield b, _short(keys[part]), known[of[part][run]].tobytes(), counts.tobytes(), _short(more[more_cut[b] : more_cut[b + 1]])


def surveyed(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Two kinds of rows, stored: (doc_id, node, n) for each document, and (node, alone) with how many
    n-grams of a bucket no other node has. The buckets hold the first quarter of the hashes."""
    kind = docs.schema["doc_id"].dataType
    length = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-(length // 24) // BUCKET))
    names = ["bucket", "doc_id", "node", "n", "keys", "nodes", "counts", "more"]
    rows = f"bucket int, doc_id {kind.simpleString()}, node bigint, n bigint, keys binary, nodes binary, counts binary, more binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets, nodes, held = [], [], 0

        def sent() -> pa.RecordBatch:
            b, keys, of, counts, more = zip(*_packed(sets, nodes, buckets))
            none = pa.nulls(len(b), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), pa.nulls(len(b), id_type), none, none, *(pa.array(x, pa.binary()) for x in (keys, of, counts, more))], names
            )

        for batch in batches:
            id_type = batch.column(0).type
            numbers, sizes = [], []
            for text in batch.column(1).to_pylist():
                found = ngrams(text, size)
                node = node_of(found)
                numbers.append(node)
                sizes.append(len(found))
                if node is not None and node not in seen:
                    seen.add(node)
                    sets.append(found[: np.searchsorted(found, QUARTER)])
                    nodes.append(node)
                    held += len(sets[-1])
                if held >= GATHER:
                    yield sent()
                    sets, nodes, held = [], [], 0
                    if len(seen) > GATHER:
                        seen.clear()
            own = pa.array([(x or 0) % buckets for x in numbers], pa.int32())
            empty = pa.nulls(len(numbers), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [own, batch.column(0), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), empty, empty, empty, empty], names
            )
        if held:
            yield sent()

    def count(table: pa.Table) -> pa.Table:
        packed = table.filter(pa.compute.is_valid(table["keys"]))
        keys, more = _long(packed["keys"].to_pylist()), np.unique(_long(packed["more"].to_pylist()))
        nodes = np.frombuffer(b"".join(packed["nodes"].to_pylist()), np.int64)
        nodes = np.repeat(nodes, np.frombuffer(b"".join(packed["counts"].to_pylist()), np.int32))
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        if len(start):
            one = np.minimum.reduceat(nodes, start) == np.maximum.reduceat(nodes, start)
            start = start[one & ~np.isin(keys[start], more)]
        node, alone = np.unique(nodes[start], return_counts=True)
        docs = table.filter(pa.compute.is_null(table["keys"])).select(["doc_id", "node", "n"])
        none = pa.nulls(len(node), pa.int64())
        counted = pa.table([pa.nulls(len(node), table["doc_id"].type), pa.array(node), none, pa.array(alone, pa.int64())], ["doc_id", "node", "n", "alone"])
        return pa.concat_tables([docs.append_column("alone", pa.nulls(len(docs), pa.int64())), counted])

    dealt = docs.select("doc_id", "text").mapInArrow(gather, rows).groupBy("bucket")
    return stored(dealt.applyInArrow(count, f"doc_id {kind.simpleString()}, node bigint, n bigint, alone bigint"), "surveyed")


def ordered(docs: DataFrame, classes: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(node, n, parts, rarity, shared): the n-grams that a node shares with others, in the global order,
    each with its place from 0 to 1; nodes that can agree with no other are left out. ``parts`` is the
    number of n-grams in each range of hashes, a byte each, null where one is too large for that.

    ``classes`` (node, n, first) names a document of each node. The order goes by bands of
    frequency, which are counted over all of them, and within a band by hash.
    """
    # what is left grows with the corpus, so both sides are sorted whatever their size here
    texts = docs.select("doc_id", "text").join(classes.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "n", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, found = batch.column(0).to_pylist(), [ngrams(t, size) for t in batch.column(2).to_pylist()]
            own = [i for i, x in enumerate(found) if node_of(x) == node[i]]  # an id may have several texts
            lists = pa.array([found[i].view(np.int64) for i in own], pa.list_(pa.int64()))
            sizes = [np.bincount((found[i] >> np.uint64(58)).astype(np.int64), minlength=PARTS) for i in own]
            parts = pa.array([s.astype(np.uint8).tobytes() if s.max() < 256 else None for s in sizes], pa.binary())
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), parts, lists], ["node", "n", "parts", "grams"])

    sets = stored(texts.mapInArrow(cut, "node bigint, n bigint, parts binary, grams array<bigint>").dropDuplicates(["node"]), "sets")
    flat = sets.select("node", F.explode("grams").alias("gram"))
    often = stored(flat.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    band = F.floor(8 * F.log2(F.col("df").cast("double"))).cast("int")
    bands = {r.band: r.n for r in often.groupBy(band.alias("band")).agg(F.sum("df").alias("n")).collect()}  # some hundreds at most
    top, total = max(bands, default=0) + 1, max(1, sum(bands.values()))
    width = [bands.get(b, 0) / total for b in range(top)]
    before = np.cumsum([0, *width])[:-1].tolist()
    within = F.shiftrightunsigned("gram", 11) / F.lit(float(1 << 53))
    place = F.get(F.array(*map(F.lit, before)), band) + F.get(F.array(*map(F.lit, width)), band) * within
    placed = flat.join(often, "gram").select("node", F.struct(place.alias("place"), "gram").alias("x"))
    shared = placed.groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("shared"), F.sum("x.place").alias("sum"))
    able = shared.join(sets.select("node", "n", "parts"), "node").filter(100 * F.size("shared") >= percent * F.col("n"))
    return stored(able.select("node", "n", "parts", (1 - F.col("sum") / F.col("n")).alias("rarity"), "shared"), "ordered")


def _segments(sets: DataFrame, fragments: int) -> DataFrame:
    """(node, n, fragment, grams): what a set has in each fragment of the order."""
    of = lambda x: F.least(F.lit(fragments - 1), F.floor(x["place"] * fragments))
    cut = F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment")
    part = F.transform(F.filter("shared", lambda x: of(x) == F.col("fragment")), lambda x: x["gram"])
    return sets.select("node", "n", "shared", cut).select("node", "n", "fragment", part.alias("grams")).filter(F.size("grams") > 0)


def _counted(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, drawn) that agree: overlaps are counted for each fragment and summed."""
    def side(c: str) -> DataFrame:
        return segments.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), "fragment", F.col("grams").alias(f"grams_{c}"))

    both = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"])
    part = both.select("a", "b", "drawn", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    whole = part.groupBy("a", "b", "drawn", "n_a", "n_b").agg(F.sum("part").alias("common"))
    return whole.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b", "drawn")


def _open_pairs(postings: DataFrame) -> tuple[int, int]:
    """Rows of postings with nodes of several components, and how many pairs these could make."""
    each = postings.groupBy("gram", "label").agg(F.count("*").cast("double").alias("n"))
    sums = each.groupBy("gram").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).filter("n * n > own")
    row = sums.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).head()
    return int(row[0] or 0), int(row[1] or 0)


def _with_hub(postings: DataFrame, number: int, percent: int) -> DataFrame:
    """(a, b, drawn): every node of a posting and the hub of it, if they are of two components and of like
    size. The first hub is the node with the commonest n-grams, such as the text that others were
    copied from; later ones are drawn."""
    drawn = F.col("rarity") if number == 0 else F.xxhash64(F.lit(number), "node").cast("double")
    hub = postings.groupBy("gram").agg(
        F.min(F.struct(drawn.alias("drawn"), "node", "n", "label")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")
    ).filter("low <> high").select("gram", "hub")
    joined = postings.join(hub, "gram").filter(F.col("label") != F.col("hub.label"))
    like = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    return joined.filter(like).select(F.col("node").alias("a"), F.col("hub.node").alias("b"), "hub.drawn").distinct()


def _with_all(postings: DataFrame, sets: DataFrame, percent: int, size: int = CHUNK) -> DataFrame:
    """(a, b, drawn): all pairs of a posting that are of two components and can agree by size, place and
    what they hold in each range of hashes."""
    sizes = postings.groupBy("gram").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = sizes.filter("low <> high").select("gram", "m")
    chunk = F.expr(f"cast(pmod(xxhash64(node), (m + {size} - 1) div {size}) as int)")
    names = ["gram", "i", "j", "n", "chunk", "node", "label", "place"]
    cells = (  # only what is open needs its parts
        postings.join(sizes, "gram").withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.expr(f"cast((m - 1) div {size} as int)"))))
        .withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).select(names)
        .join(sets.select("node", "parts"), "node").select(*names, "parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["gram", "i", "j"], BLOCK):
            gram, i, j, n, chunk, node, label, place = (table[c].to_numpy().astype(np.int64) for c in names)
            new = np.flatnonzero(np.r_[True, (np.diff(gram) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
            end = np.repeat(np.r_[new[1:], len(gram)], np.diff(np.r_[new, len(gram)]))
            held = table["parts"].to_pylist()
            bounded = np.array([x is not None for x in held])
            parts = np.frombuffer(b"".join(x or bytes(PARTS) for x in held), np.uint8).reshape(-1, PARTS)
            at, step = np.arange(len(gram)), 0
            while True:
                step += 1
                at = at[at + step < end[at]]
                at = at[100 * n[at] >= percent * n[at + step]]  # sorted by n: none further on is smaller
                if not len(at):
                    break
                to = at + step
                left = np.minimum(n[at] - place[at], n[to] - place[to])  # what both have from here on
                able = (100 + percent) * left >= percent * (n[at] + n[to])
                near = np.flatnonzero(able & (label[at] != label[to]) & ((i[at] == j[at]) | (chunk[at] != chunk[to])))
                x, y = at[near], to[near]
                most = np.minimum(parts[x], parts[y]).sum(axis=1, dtype=np.int64)
                near = ((100 + percent) * most >= percent * (n[x] + n[y])) | ~bounded[x] | ~bounded[y]
                if near.any():
                    x, y = node[x[near]], node[y[near]]
                    none = pa.nulls(len(x), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), none], ["a", "b", "drawn"])

    dealt = cells.repartition(partitions(postings), "gram", "i", "j").sortWithinPartitions("gram", "i", "j", "n", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, drawn double").distinct()


def links(sets: DataFrame, percent: int = PERCENT, fragments: int = FRAGMENTS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): pairs of nodes of ``sets`` (as ``ordered`` gives it) that agree; they connect all that do."""
    segments = stored(_segments(sets, fragments), "segments")
    grams = F.transform("shared", lambda x: x["gram"])
    first = F.expr(f"size(shared) - cast(ceil(n * {percent} / 100.0) as int) + 1")
    begin = F.posexplode(F.slice(grams, F.lit(1), F.least(F.size("shared"), first))).alias("at", "gram")
    postings = sets.select("node", "n", "rarity", F.expr("n - size(shared)").alias("missing"), begin)
    postings = stored(postings.select("gram", "node", "n", "rarity", (F.col("missing") + F.col("at")).alias("place")), "postings")
    found = tried = None
    labelled = postings.withColumn("label", F.col("node"))
    for number in range(ROUNDS + 1):
        rows, pairs = (0, 1) if number == 0 else _open_pairs(labelled)
        last = number == ROUNDS or pairs <= COMPARED * rows
        pairs = _with_all(labelled, sets, percent, chunk) if last else _with_hub(labelled, number, percent)
        low, high = F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")
        if tried is not None:
            pairs = pairs.withColumns({"x": low, "y": high}).join(tried, ["x", "y"], "left_anti").drop("x", "y")
        pairs = stored(pairs, "pairs")
        near = stored(_counted(pairs, segments, percent), "near")
        found = near if found is None else found.unionAll(near)
        if last:
            return found.select("a", "b")
        more = pairs.select(low, high)
        tried = more if tried is None else tried.unionAll(more)
        if number == 0:  # with its best hub: one label for all copies of a text
            roots = near.groupBy("a").agg(F.min(F.struct("drawn", "b"))["b"].alias("root")).withColumnRenamed("a", "node")
        else:
            roots = components(found)
        labelled = postings.join(roots, "node", "left").select(*postings.columns, F.coalesce("root", "node").alias("label"))


def joined(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, fragments: int = FRAGMENTS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles (of its set) and component_id (the smallest doc_id that links lead to, itself
    included) for each document; sets link when 100 * intersection >= ``percent`` * union.

    Null and empty texts and texts without words have an empty set, which links with nothing: their
    component is their own id. Null ids count for no component; a component of null ids alone has
    id null. Repeated rows come back as often; an empty table gives an empty result; other
    columns are ignored. Texts of any length are taken whole.
    """
    table = surveyed(docs, size)
    each = table.filter("n is not null").select("doc_id", "node", "n")
    alone = table.filter("alone is not null").groupBy("node").agg(F.sum("alone").alias("alone"))
    classes = each.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    classes = stored(classes, "classes")
    able = classes.join(alone, "node", "left").filter(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n"))
    sets = ordered(docs, able.select("node", "n", "first"), size, percent)
    roots = components(links(sets, percent, fragments, chunk))
    rooted = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "root").select("node", "component_id")
    full = each.join(known, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


SQL = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
    FROM docs
), flat AS (
    SELECT r, len(g) AS n, unnest(g) AS gram FROM sets
), links AS (
    SELECT a.r AS a, b.r AS b FROM flat a JOIN flat b ON a.gram = b.gram AND a.r <> b.r
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
    SELECT r, r AS other FROM sets UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT s.doc_id, len(s.g) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN sets s ON s.r = reach.r JOIN sets o ON o.r = reach.other
GROUP BY s.r, s.doc_id, len(s.g)
"""
