"""Benchmark decontamination by greedy string tiling.

Benchmark items are taken in blocks of a bounded number of words. The words of a block get
numbers, and every run of ``SEED_WORDS`` of them is a seed. A pass over the documents joins their
runs with the seeds; where a document shares seeds with an item, the longest common runs of both
are marked again and again, longest first and without overlap, by running Karp-Rabin hashes. The
share of the item that is marked is its coverage. Passages whose parts stand in another order or
apart are tiled like whole ones.

Nothing is shuffled: a document meets a block in the task that reads it. A larger benchmark means
more blocks and more passes, not a larger broadcast.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_WORDS = 5
MIN_TILE = 3
COVERAGE = 0.5
BLOCK_WORDS = 500_000
LONGEST = 64  # first length that tiles are looked for; longer matches are extended

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of ``size`` ids, rolled on from one run to the next."""
    if len(ids) < size:
        return np.empty(0, np.uint64)
    base = np.uint64(1_000_003)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), base)])
    total = np.r_[np.uint64(0), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)])]
    # The sum over a run carries the power of its place; an odd base can be divided out again.
    inverse = np.uint64(pow(1_000_003, -1, 2**64))
    undo = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), inverse)])
    return (total[size:] - total[:-size]) * undo[: len(ids) - size + 1]


def tiles(pattern: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of the tiles; ids below 0 match nothing."""
    free_p, free_t = pattern >= 0, text >= 0
    found = []
    size = max(least, min(LONGEST, len(pattern), len(text)))
    while True:
        matches = _matches(pattern, text, free_p, free_t, size)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * size:
            size = longest
            continue
        for p, t, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            if free_p[p : p + n].all() and free_t[t : t + n].all():
                free_p[p : p + n] = free_t[t : t + n] = False
                found.append((p, t, n))
        if size <= least:
            return found
        size = max(least, size // 2) if size > 2 * least else size - 1


def _matches(pattern, text, free_p, free_t, size) -> list[tuple[int, int, int]]:
    """Maximal common runs of unmarked ids, of ``size`` at least."""
    def starts(ids, free):
        if len(ids) < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        run = np.cumsum(np.r_[0, free])
        at = np.flatnonzero(run[size:] - run[:-size] == size)
        return at, _hashes(ids, size)[at]

    at_p, hash_p = starts(pattern, free_p)
    at_t, hash_t = starts(text, free_t)
    table = defaultdict(list)
    for p, h in zip(at_p.tolist(), hash_p.tolist()):
        table[h].append(p)
    out = []
    for t, h in zip(at_t.tolist(), hash_t.tolist()):
        for p in table.get(h, ()):
            if p and t and free_p[p - 1] and free_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # the run began earlier
            n = 0
            while p + n < len(pattern) and t + n < len(text) and free_p[p + n] and free_t[t + n] and pattern[p + n] == text[t + n]:
                n += 1
            if n >= size:
                out.append((p, t, n))
    return out


class Block:
    """Some benchmark items, the numbers of their words, and their seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.items = []
        seeds, owners = [], []
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in tokens(text)], np.int64)
            self.items.append((item_id, ids))
            found = np.unique(_hashes(ids, min(SEED_WORDS, max(1, len(ids)))))
            if len(ids) < SEED_WORDS:
                continue  # shorter than a seed: nothing to find it by
            seeds.append(found)
            owners.append(np.full(len(found), len(self.items) - 1))
        seed = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], owner[order]

    def leaks(self, text: str | None, coverage: float) -> list[tuple[int, float]]:
        """(item_id, coverage) of the items that the text covers at least so far."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in tokens(text)], np.int64)
        inside = np.cumsum(np.r_[0, ids >= 0])
        if len(ids) < SEED_WORDS or not len(self.seed):
            return []
        at = np.flatnonzero(inside[SEED_WORDS:] - inside[:-SEED_WORDS] == SEED_WORDS)
        if not len(at):
            return []
        hashes = _hashes(ids, SEED_WORDS)[at]
        low, high = np.searchsorted(self.seed, hashes), np.searchsorted(self.seed, hashes, "right")
        if not (high > low).any():
            return []
        candidates = sorted({int(o) for a, b in zip(low, high) for o in self.owner[a:b]})
        out = []
        for number in candidates:
            item_id, pattern = self.items[number]
            known = np.isin(ids, pattern)
            own = np.where(known, ids, -1)
            runs = np.flatnonzero(np.diff(np.r_[0, known.astype(np.int8), 0])).reshape(-1, 2)
            runs = runs[runs[:, 1] - runs[:, 0] >= MIN_TILE]
            near = np.concatenate([np.r_[own[a:b], -1] for a, b in runs]) if len(runs) else np.empty(0, np.int64)
            marked = sum(n for _, _, n in tiles(pattern, near))
            if marked >= coverage * len(pattern):
                out.append((item_id, marked / len(pattern)))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage) of every document and item it covers to ``coverage`` or more.

    Null and empty texts cover nothing, items of fewer than ``SEED_WORDS`` words are not looked
    for; null ids are returned as such and repeated rows as often as they come; other columns are
    ignored; an empty table on either side gives an empty result.
    """
    found = [pairs for block in blocks(benchmark, block_words) if (pairs := _scan(docs, block, coverage)) is not None]
    kinds = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    if not found:
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, coverage double")
    return reduce(DataFrame.unionAll, found)


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[Block]:
    """The items in blocks of about ``block_words`` words, chosen by hash."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    words = items.agg(F.sum(F.size(F.split("text", "\\s+")))).head()[0] or 0
    count = -(-words // block_words)
    for n in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == n).distinct()
        yield Block(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1])))


def _scan(docs: DataFrame, block: Block, coverage: float) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, item_id, share)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for item_id, share in known.value.leaks(text, coverage)
            ]
            kind = batch.schema.field(0).type
            doc, item, share = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, kind), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "coverage"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, coverage double")


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that cover no item to ``coverage`` or more; a narrow pass per block."""
    place = docs.columns.index("text")
    for block in blocks(benchmark, block_words):
        known = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not known.value.leaks(t, coverage) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
