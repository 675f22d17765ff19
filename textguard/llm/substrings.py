"""Removal of repeated passages, by prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one document. A word goes if a window that covers it
also starts in a document with a smaller id.

1. Documents are dealt to shards of a memory size. Each shard names the anchors of its windows:
   the 5-word gram with the least hash in each window, the same wherever the same window stands.
   Anchors that two documents have are kept; only windows with such an anchor can repeat, so all
   others stay where they are. The windows of each anchor are counted over all shards.
2. Of the remaining windows a shard sends each distinct one once, with its smallest document, to
   the group of a prefix. The prefix is the anchor; where more than ``GROUP_WINDOWS`` windows share
   that, it is lengthened to the whole window. Windows one after another that go to one group
   travel as one run of words, and each begins a suffix that ends with the run.
3. A group is the subtree of its prefixes. Its suffixes are sorted by prefix doubling; the words
   that neighbours have in common are the depths of the internal nodes. The highest node of
   ``length`` or more words above a suffix is a repeat as long as the node is deep, and its
   smallest document goes back to the shards. Nodes are no deeper than the runs are long.
4. The shards remove what the repeats cover.

A passage that a third of all documents share is sent once per shard; one with ever other words
around it is spread over the groups by those. Shards, groups and replies hold a bounded number of
words; the texts are shuffled once and that exchange is read three times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import moved_aside, private

LENGTH = 13
GRAM = 5
SHARD_BYTES = 8 << 20
GROUP_WINDOWS = 1 << 16  # windows that may share a prefix before it is lengthened
LATE = np.iinfo(np.int64).max  # rows without an id come after all others

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        out = (out + words[i : i + len(out)]) * _M1
    return _mixed(out)


class Shard:
    """The words of some documents, in order of id and text one after another, and their windows."""

    def __init__(self, table: pa.Table, length: int):
        known = _Hashes()
        self.length = length
        ids = table["doc_id"].combine_chunks().fill_null(LATE).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [(t or "").encode() for t in table["text"].to_pylist()]
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.words = [texts[i].split() for i in self.order]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.r_[0, np.cumsum(counts)]
        self.hash = np.fromiter((known[x] for w in self.words for x in w), np.uint64, int(self.starts[-1]))
        fits = np.maximum(counts - length + 1, 0)
        row = np.repeat(np.arange(len(counts)), fits)
        self.at = np.arange(len(row)) - np.repeat(np.cumsum(fits) - fits, fits) + self.starts[row]
        self.document = ids[self.order][row] if len(row) else np.empty(0, np.int64)

    def _grams(self) -> np.ndarray:
        return sliding_window_view(_runs(self.hash, GRAM), self.length - GRAM + 1)

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        return self._grams().min(axis=1)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def windows(self) -> np.ndarray:
        """A hash of each window."""
        return _runs(self.hash, self.length)[self.at] if len(self.at) else np.empty(0, np.uint64)


def _least(keys: np.ndarray, values: np.ndarray):
    """Distinct keys, the first place of each, least and greatest of their values, and for every
    place the number of its key."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, np.diff(keys[order]) != 0] if len(keys) else np.empty(0, bool)
    first = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    if not len(first):
        return keys, order, values, values, number
    values = values[order]
    return keys[order][first], order[first], np.minimum.reduceat(values, first), np.maximum.reduceat(values, first), number


def _dealt(of: np.ndarray):
    """Each group number and the places that hold it."""
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0]) if len(of) else np.empty(0, np.int64)
    for a, b in zip(cuts, np.r_[cuts[1:], len(of)]):
        yield int(of[order[a]]), order[a:b]


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, kinds.items())})


def suffix_order(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at the places ``at``, and how many words each has in
    common with the one before it.

    Suffixes end at numbers that stand nowhere else; the last of ``words`` is one. Ranks by the
    first 1, 2, 4, ... words are refined while suffixes share one; two suffixes have as many words
    in common as the ranks say that agree.
    """
    last = len(words) - 1
    rank = np.zeros(len(words), np.int64)
    tied = np.arange(len(words))
    key, size, ranks = words.astype(np.int64), 1, []
    while len(tied):
        by = np.argsort(key, kind="stable")
        tied, key, before = tied[by], key[by], rank[tied[by]]
        new = np.r_[True, np.diff(key) != 0]
        place = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(new, place, 0))
        older = np.maximum.accumulate(np.where(np.r_[True, np.diff(before) != 0], place, 0))
        rank[tied] = before + start - older
        ranks.append(rank.astype(np.int32))
        tied = tied[~(new & np.r_[new[1:], True])]
        key = (rank[tied] << 32) | rank[np.minimum(tied + size, last)]
        size *= 2
    order = np.argsort(rank[at], kind="stable")
    a, b = at[order][:-1], at[order][1:]
    common = np.zeros(max(0, len(at) - 1), np.int64)
    for i in range(len(ranks) - 1, -1, -1):
        agree = ranks[i][np.minimum(a + common, last)] == ranks[i][np.minimum(b + common, last)]
        common += agree.astype(np.int64) << i
    return order, np.r_[np.zeros(min(1, len(at)), np.int64), common]


def deep_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in sorted order the number of the highest internal node of ``least`` or more
    words above each, and the words of each node. A suffix without such a node has one of its own,
    of no words."""
    first = common < least
    node = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    none = np.iinfo(np.int64).max
    depth = np.minimum.reduceat(np.where(first, none, common), begins) if len(begins) else begins
    return node, np.where(depth == none, 0, depth)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept_text`` (the words left, joined by one space), ``n_words`` and
    ``n_removed``; input columns of these names get trailing underscores.

    Null and empty texts have no words. Rows without an id come after all others and remove
    nothing from each other; nor do rows with the same id. Texts shorter than a window are kept.
    Repeated rows come back as often; an empty table gives an empty result.
    """
    new = ("kept_text", "n_words", "n_removed")
    docs = moved_aside(docs, new)
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    shard = private("shard")
    dealt = docs.withColumn(shard, F.expr(f"cast(pmod(xxhash64(doc_id, text), {shards}) as int)")).repartition(shards, shard)
    most = GROUP_WINDOWS

    def anchors(table: pa.Table) -> pa.Table:
        own = Shard(table, length)
        own.words.clear()  # hashes are all that is needed here
        found, _, low, high, number = _least(own.anchors(), own.document)
        _, distinct = np.unique(own.windows(), return_index=True)
        n = np.bincount(number[distinct], minlength=len(found))
        counted = (2 * n + (low < high)).astype(np.uint32)  # the lowest bit: two documents have it
        of = table[shard][0].as_py()
        rows = [
            (group, of, found[at].tobytes(), counted[at].tobytes())
            for group, at in _dealt((found % np.uint64(shards)).astype(np.int64))
        ]
        return _table(rows, grp=pa.int32(), shard=pa.int32(), anchors=pa.binary(), counted=pa.binary())

    def known(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["anchors"].to_pylist()]
        counted = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counted"].to_pylist()]).astype(np.int64)
        distinct, inverse, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        twice = times > 1
        np.logical_or.at(twice, inverse, counted % 2 == 1)
        long = np.bincount(inverse, counted // 2, len(distinct)) > most
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        rows = [
            (s, p[k].tobytes(), m[k].tobytes())
            for s, p, k, m in zip(table["shard"].to_pylist(), parts, np.split(twice[inverse], cuts), np.split(long[inverse], cuts))
            if k.any()
        ]
        return _table(rows, shard=pa.int32(), anchors=pa.binary(), long=pa.binary())

    def suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            own = Shard(left, length)
            wanted = np.concatenate([np.frombuffer(x, np.uint64) for x in right["anchors"].to_pylist()])
            long = np.concatenate([np.frombuffer(x, bool) for x in right["long"].to_pylist()])
            anchor, window = own.anchors(), own.windows()
            asked = np.flatnonzero(np.isin(anchor, wanted, kind="sort"))
            _, first, low, _, _ = _least(window[asked], own.document[asked])
            by = np.argsort(first)
            sent, low = asked[first[by]], low[by]
            at = own.at[sent]
            prefix = np.where(np.isin(anchor[sent], wanted[long]), window[sent], anchor[sent])
            group = (_mixed(prefix) % np.uint64(shards)).astype(np.int64)
            begins = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(group) != 0)])
            counts = np.diff(np.r_[begins, len(at)])
            flat = [w for words in own.words for w in words]
            of = left[shard][0].as_py()
            for number, runs in _dealt(group[begins]):
                start, count = at[begins[runs]], counts[runs]
                text = b"\n".join([b" ".join(flat[a : a + n + length - 1]) for a, n in zip(start.tolist(), count.tolist())])
                rows.append((number, of, _pack(start), _pack(count), _pack(low[begins[runs]]), zstandard.compress(text, 1)))
        return _table(
            rows, grp=pa.int32(), shard=pa.int32(), starts=pa.binary(), counts=pa.binary(), low=pa.binary(), words=pa.binary()
        )

    def tree(table: pa.Table) -> pa.Table:
        known, parts = _Numbers({b"\n": 0}), []
        for text in table["words"].to_pylist():
            split = zstandard.decompress(text).replace(b"\n", b" \n ").split(b" ")
            parts.append(np.fromiter(map(known.__getitem__, split), np.int64, len(split)))
            parts.append(np.zeros(1, np.int64))
        words = np.concatenate(parts)
        ends = np.flatnonzero(words == 0)
        words[ends] = len(known) + np.arange(len(ends))
        begin = np.r_[0, ends[:-1] + 1]
        start, count, low = (np.concatenate([_unpack(x, np.int64) for x in table[c].to_pylist()]) for c in ("starts", "counts", "low"))
        runs = np.cumsum([len(_unpack(x, np.int64)) for x in table["counts"].to_pylist()])
        run = np.repeat(np.arange(len(count)), count)
        along = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        order, common = suffix_order(words, begin[run] + along)
        node, depth = deep_nodes(common, length)
        run, along = run[order], along[order]
        own = low[run]
        least = np.minimum.reduceat(own, np.flatnonzero(common < length))
        hit = np.flatnonzero(least[node] < own)
        of = np.searchsorted(runs, run[hit], "right")
        place, size, other = start[run[hit]] + along[hit], depth[node[hit]], least[node[hit]]
        rows = []
        for part, at in _dealt(of):
            at = at[np.argsort(place[at], kind="stable")]
            upto = place[at] + size[at]
            # What lies within a repeat before it says nothing new.
            at = at[upto > np.r_[0, np.maximum.accumulate(upto)[:-1]]]
            rows.append((table["shard"][part].as_py(), _pack(place[at]), _pack(size[at]), _pack(other[at])))
        return _table(rows, shard=pa.int32(), places=pa.binary(), sizes=pa.binary(), low=pa.binary())

    outer = docs.columns

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Shard(left, length)
        gone = np.zeros(len(own.hash) + 1, np.int64)
        if len(own.at):
            _, first, low, _, number = _least(own.windows(), own.document)
            if right.num_rows:
                place = np.concatenate([_unpack(x, np.int64) for x in right["places"].to_pylist()])
                other = np.concatenate([_unpack(x, np.int64) for x in right["low"].to_pylist()])
                windows = np.concatenate([_unpack(x, np.int64) for x in right["sizes"].to_pylist()]) - length + 1
                along = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                hit = np.repeat(np.searchsorted(own.at, place), windows) + along
                np.minimum.at(low, number[hit], np.repeat(other, windows))
            hit = own.at[low[number] < own.document]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + length, -1)
        kept = np.cumsum(gone)[:-1] == 0
        texts, counts = [], []
        for words, a, b in zip(own.words, own.starts[:-1].tolist(), own.starts[1:].tolist()):
            stay = np.flatnonzero(kept[a:b])
            counts.append(int(b - a - len(stay)))
            texts.append(b" ".join([words[i] for i in stay.tolist()] if counts[-1] else words).decode())
        out = left.select(outer).take(pa.array(own.order, pa.int64()))
        for name, values in zip(new, (pa.array(texts, pa.string()), pa.array(np.diff(own.starts)), pa.array(counts, pa.int64()))):
            out = out.append_column(name, values)
        return out

    named = dealt.groupBy(shard).applyInArrow(anchors, "grp int, shard int, anchors binary, counted binary")
    back = named.groupBy("grp").applyInArrow(known, "shard int, anchors binary, long binary")
    sent = dealt.groupBy(shard).cogroup(back.groupBy("shard")).applyInArrow(
        suffixes, "grp int, shard int, starts binary, counts binary, low binary, words binary"
    )
    repeats = sent.groupBy("grp").applyInArrow(tree, "shard int, places binary, sizes binary, low binary")
    added = {"kept_text": F.lit(""), "n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}
    return dealt.groupBy(shard).cogroup(repeats.groupBy("shard")).applyInArrow(removed, docs.withColumns(added).schema)


SQL = """
WITH w AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id OR (doc_id IS NULL AND first IS NOT NULL)),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM f),
l AS (SELECT rid, list(p) AS gone FROM c GROUP BY rid),
k AS (SELECT rid, array_to_string(list(x ORDER BY p), ' ') AS kept FROM (
  SELECT w.rid, unnest(w.w) AS x, unnest(range(1, len(w.w) + 1)) AS p FROM w) e
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rid = e.rid AND c.p = e.p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (rid) LEFT JOIN k USING (rid)
"""
