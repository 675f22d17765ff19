"""Packing of documents into windows of a fixed number of tokens.

Documents are cut into whole windows and a tail. What is known of the tails is a histogram of at
most ``WINDOW - 1`` lengths. Pairs and triples of lengths that fill a window exactly are its
columns; non-negative least squares finds how often to repeat each, rounded down so that no tail
is promised twice. The tails left over are packed greedily one behind the other, cut where a
window ends, so that no window but the last has padding.

The plan depends on the histogram alone, not on the size of the corpus. Tails of one length get
consecutive numbers from counts per task and length; a length that a third of all documents have
is numbered in as many tasks as hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.llm.common import stored
from textguard.llm.tokens import encoded, forget, slices

WINDOW = 2048
PARTNERS = 24  # most frequent lengths that triples are built around
STEPS = 400


def combinations(histogram: np.ndarray, window: int, partners: int = PARTNERS) -> np.ndarray:
    """Pairs and triples of present lengths that fill the window, as rows with 0 for no third."""
    have = np.flatnonzero(histogram)
    pairs = have[(2 * have <= window)]
    pairs = pairs[histogram[window - pairs] > 0]
    rows = [np.stack([window - pairs, pairs, np.zeros_like(pairs)], axis=1)]
    for b in have[np.argsort(-histogram[have], kind="stable")[:partners]]:
        c = window - b - have
        fits = (c > 0) & (c <= have)
        a, c = have[fits], c[fits]
        a, c = a[histogram[c] > 0], c[histogram[c] > 0]
        rows.append(np.sort(np.stack([a, np.full_like(a, b), c], axis=1), axis=1)[:, ::-1])
    return np.unique(np.concatenate(rows), axis=0)


def repeats(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares: how often to use each row so that the lengths used come close
    to the histogram. Projected gradient steps with momentum; each is a few sums over the rows."""
    used = rows.ravel()
    goal = histogram.astype(float)
    goal[0] = 0

    def lengths(x: np.ndarray) -> np.ndarray:
        out = np.bincount(used, np.repeat(x, rows.shape[1]), len(histogram))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(30):
        v = back(lengths(v))
        v /= np.linalg.norm(v) or 1.0
    pace = 1 / max(1.0, 1.05 * np.linalg.norm(back(lengths(v))))
    x = ahead = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - pace * back(lengths(ahead) - goal))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, ahead, t = new, new + (t - 1) / following * (new - x), following
    return x


@dataclass
class Plan:
    """Which tail goes where. ``key`` is length * 2^40 + rank of the first tail of an interval."""

    window: int
    key: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    times: np.ndarray  # tails of this length in one sequence
    taken: np.ndarray  # tails of each length in combinations
    behind: np.ndarray  # place of the first other tail of each length in the row of leftovers
    first: int  # sequence in which that row begins

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a tail."""
        if rank < self.taken[length]:
            i = int(np.searchsorted(self.key, (length << 40) + rank, "right")) - 1
            n, k = divmod(rank - int(self.rank[i]), int(self.times[i]))
            return [(0, length, int(self.sequence[i]) + n, int(self.offset[i]) + k * length)]
        at = int(self.behind[length]) + (rank - int(self.taken[length])) * length
        out, start = [], 0
        while start < length:
            n, offset = divmod(at + start, self.window)
            size = min(length - start, self.window - offset)
            out.append((start, size, self.first + n, offset))
            start += size
        return out


def plan(histogram: np.ndarray, window: int = WINDOW, first: int = 0) -> Plan:
    """Plan for ``histogram[length]`` tails of each length below the window; sequences from ``first``."""
    histogram = np.asarray(histogram, np.int64).copy()
    histogram[0] = 0
    left = histogram.copy()
    rows = combinations(np.r_[histogram, 0], window) if histogram.any() else np.empty((0, 3), np.int64)
    wanted = np.floor(repeats(rows, np.r_[histogram, 0]) + 1e-9).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    intervals = []
    sequence = first
    for i in np.argsort(-wanted, kind="stable"):
        lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        count = min(int(wanted[i]), *(int(left[a] // k) for a, k in zip(lengths, times)))
        if count <= 0:
            continue
        offset = 0
        for a, k in zip(lengths.tolist(), times.tolist()):
            intervals.append((a, int(histogram[a] - left[a]), sequence, offset, k))
            offset += a * k
            left[a] -= k * count
        sequence += count
    table = np.array(sorted(intervals), np.int64).reshape(-1, 5)
    size = np.arange(len(left)) * left
    return Plan(
        window, (table[:, 0] << 40) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4],
        histogram - left, np.cumsum(size) - size, sequence,
    )


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, release: bool = True) -> DataFrame:
    """doc_id, ids and length of every document, with the rank of its tail among those of its
    length and of its whole windows, both within the task; written once, so ranks stay."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "ids", "n", "task", "tail", "tail_rank", "full_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ranks, fulls = np.zeros(window, np.int64), 0
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), encoded(tokenizer, batch.column(1).to_pylist())):
                ids = found + end
                full, tail = divmod(len(ids) // 4, window)
                rows.append((doc_id, ids, len(ids) // 4, task, tail, int(ranks[tail]), fulls))
                ranks[tail] += 1
                fulls += full
            kinds = [batch.schema.field(0).type, pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if release:
            forget(tokenizer)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids binary, n long, task int, tail int, tail_rank long, full_rank long"
    ), "tokenized")


def packed(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False, release: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with ``with_ids`` the ids as little-endian unsigned 32-bit numbers.

    Null and empty texts are the end id alone; rows without a doc_id and repeated rows are packed
    like others; other columns are ignored; an empty table gives no piece.

    With ``release`` a task lets go of the pieces it remembers, for later work in the same workers;
    without, the next task of a worker knows them already.
    """
    rows = tokenized(docs, tokenizer, end_id, window, release)
    by_task = rows.groupBy("task", "tail").agg(F.count("*").alias("k"), F.sum(F.expr(f"n div {window}")).alias("full"))
    by_task = stored(by_task, "lengths")
    histogram = np.zeros(window, np.int64)
    for row in by_task.groupBy("tail").agg(F.sum("k").alias("k")).collect():
        histogram[row["tail"]] = row["k"]
    fulls = by_task.groupBy("task").agg(F.sum("full").alias("full"))
    total = fulls.agg(F.sum("full")).head()[0] or 0
    first_full = fulls.select(F.col("task").alias("of"), (F.sum("full").over(W.orderBy("task")) - F.col("full")).alias("full_base"))
    ranks = W.partitionBy("tail").orderBy("task")
    bases = by_task.select(
        F.col("task").alias("in_task"), F.col("tail").alias("in_tail"), (F.sum("k").over(ranks) - F.col("k")).alias("tail_base")
    ).join(first_full, F.col("in_task") == F.col("of"))
    placed = rows.join(bases, (F.col("task") == F.col("in_task")) & (F.col("tail") == F.col("in_tail"))).select(
        "doc_id", "ids", "n", "tail", (F.col("tail_base") + F.col("tail_rank")).alias("rank"),
        (F.col("full_base") + F.col("full_rank")).alias("full"),
    )
    known = docs.sparkSession.sparkContext.broadcast(plan(histogram, window, int(total)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.place
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for doc_id, ids, n, tail, rank, full in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = [(i * window, window, full + i, 0) for i in range(n // window)]
                pieces += [(n - tail + s, size, seq, off) for s, size, seq, off in place(tail, rank)] if tail else []
                for start, size, seq, off in pieces:
                    own = ids[4 * start : 4 * (start + size)]
                    out.append((doc_id, start, size, zlib.crc32(own), n, seq, off, own)[: len(names)])
            columns = list(zip(*out)) if out else [()] * len(names)
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema + ", ids binary" * with_ids)
