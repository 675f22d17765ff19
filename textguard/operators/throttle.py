"""Token-bucket decisions for a table of events.

A bucket is a recursion along one client's events, so something has to walk them in
order. What is walked by one task is kept small, and the parts are walked at the same time:

* A client's timeline is cut wherever it pauses long enough to fill the bucket. After
  such a pause the bucket is full whatever happened before, so the parts ("chains") are
  independent and spread over the cluster. The pauses are found on counts per client and
  time slice, which are aggregated before the shuffle.
* A slice with more rows than that is cut further by time.
* A chain with more rows than ``max_rows_per_task`` is cut into parts. Every part is first walked
  without its entry: the fraction of a token it begins with follows from the time that has passed, and
  levels of one fraction move as ordered paths that meet (``functions.bucket.Coupled``), so its exit is
  known for every entry. A short pass along each chain joins the parts; then all parts are decided
  at once. Only a bucket that was full in between changes the fraction: then the parts behind it are
  walked once more, and each such round settles one part of a chain at least.
* Within a task, rows arrive sorted and are walked batch by batch in constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions.bucket import FREE, MET, TOKEN, Coupled, admit, check_rate, exit_from
from textguard.functions.bucket import fill_micros as time_to_fill
from textguard.sources.storage import Scratch

ROWS_PER_TASK = 50_000_000
#: Levels are whole units, see ``functions.bucket``.
STATE_SCHEMA = "_client string, _level bigint, _last bigint"
PARTS_NAMED = 1_000  # parts that a round reads by the names of their folders


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch; a timestamp without zone is read as UTC."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts))


def _split_hot(keyed: DataFrame, rows_per_task: int, scratch: Scratch) -> DataFrame:
    """Add ``_sub``: slices with more rows than a task may walk are cut by time, between their first
    and last event, into twice as many parts as they would fill tasks; all others are one part."""
    whole = keyed.withColumn("_sub", F.lit(0).cast("bigint"))
    sizes = keyed.groupBy("_client", "_slice").agg(
        F.count("*").alias("n"), F.min("_us").alias("_from"), F.max("_us").alias("_to")
    )
    hot = scratch.write(
        sizes.filter(F.col("n") > rows_per_task).select(
            "_client", "_slice", "_from", "_to",
            F.ceil(2 * F.col("n") / rows_per_task).alias("_parts"),
        ), "throttle-hot",
    )
    if not hot.head(1):
        return whole
    part = F.coalesce(F.expr("(_us - _from) * _parts div (_to - _from + 1)"), F.lit(0))
    marked = keyed.join(hot, ["_client", "_slice"], "left").withColumn("_sub", part)
    return marked.drop("_from", "_to", "_parts")


def _slices(
    keyed: DataFrame, state: DataFrame, fill_micros: int, rows_per_task: int
) -> DataFrame:
    """``_client, _slice, _sub, _chain, _part, first, last`` from row counts per client and time slice.

    Slices are as long as the bucket takes to fill, so a long enough pause always has
    a slice boundary in it. One row per slice or part of a slice, however many events fall into
    it. Chain 0 goes on from a known state; every other chain starts with a full bucket. Parts are numbered from 0.
    """
    counted = keyed.groupBy("_client", "_slice", "_sub").agg(
        F.count("*").alias("n"), F.min("_us").alias("first"), F.max("_us").alias("last")
    )
    counted = counted.join(state.select("_client", F.col("_last").alias("seen")), "_client", "left")
    by_time = Window.partitionBy("_client").orderBy("_slice", "_sub")
    pause = F.col("first") - F.greatest(F.lag("last").over(by_time), F.col("seen"))
    opens = F.when(F.coalesce(pause >= fill_micros, F.lit(True)), 1).otherwise(0)
    chains = counted.withColumn("_opens", opens).withColumn(
        "_chain", F.sum("_opens").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    in_chain = Window.partitionBy("_client", "_chain").orderBy("_slice", "_sub")
    before = F.sum("n").over(in_chain.rowsBetween(Window.unboundedPreceding, -1))
    filled = F.floor(F.coalesce(before, F.lit(0)) / rows_per_task)
    # a part with more rows than a task takes skips numbers: count the parts that there are
    parts = F.dense_rank().over(Window.partitionBy("_client", "_chain").orderBy("_filled")) - 1
    return chains.withColumn("_filled", filled).select(
        "_client", "_slice", "_sub", "_chain", parts.cast("int").alias("_part"), "first", "last"
    )


def _bounds(batch: pd.DataFrame, keys: list[str]) -> list[int]:
    opens = np.zeros(max(0, len(batch) - 1), bool)
    for key in keys:
        column = batch[key].to_numpy()
        opens |= column[1:] != column[:-1]
    return [0, *(np.flatnonzero(opens) + 1).tolist(), len(batch)]


def _walk(capacity: int, refill: int):
    """Batch iterator over rows sorted by client, chain, part and time.

    The open bucket is carried from batch to batch, so a part may span any number.
    """
    keys = ["_client", "_chain", "_part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, last = None, 0, 0
        for batch in batches:
            micros = batch["_us"].to_numpy()
            start_level, start_last = batch["_level"], batch["_last"]
            bounds = _bounds(batch, keys)
            allowed, waits = np.zeros(len(micros), bool), np.zeros(len(micros), "int64")
            after_level, after_last = np.zeros(len(micros), "int64"), np.zeros(len(micros), "int64")
            for low, high in zip(bounds, bounds[1:]):
                if low == high:
                    continue
                key = tuple(batch[k].iloc[low] for k in keys)
                if key != current:
                    current = key
                    if pd.isna(start_level.iloc[low]):
                        level, last = capacity * TOKEN, int(micros[low])
                    else:
                        level, last = int(start_level.iloc[low]), int(start_last.iloc[low])
                part = slice(low, high)
                allowed[part], waits[part], level, last = admit(micros[part], level, last, capacity, refill)
                after_level[part], after_last[part] = level, last
            yield batch.assign(
                allowed=allowed, retry_after=pd.Series(waits, batch.index).where(~allowed),
                _level=after_level, _last=after_last,
            ).astype({"retry_after": "Int64"})

    return run


WALKED = "kind int, exit bigint, low bigint, met bigint, top bigint, froms array<bigint>, levels array<bigint>"
SUMMARY = "_client string, _chain bigint, _part int, " + WALKED


def _summary(capacity: int, refill: int):
    """One row for each part: its exit, walked from its entry where that is known, else coupled."""
    keys = ["_client", "_chain", "_part"]
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, last, paths = None, 0, 0, None

        def table(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("exit", "low", "met", "top")})

        def row() -> tuple:
            return (*current, *((FREE, level, None, None, None, [], []) if paths is None else paths.exits()))

        for batch in batches:
            micros, done = batch["_us"].to_numpy(), []
            entry, phi, clock = (batch[c] for c in ("entry", "phi", "clock"))
            bounds = _bounds(batch, keys)
            for low, high in zip(bounds, bounds[1:]):
                if low == high:
                    continue
                key = tuple(batch[k].iloc[low] for k in keys)
                if key != current:
                    if current is not None:
                        done.append(row())
                    current, last = key, int(clock.iloc[low])
                    exact = not pd.isna(entry.iloc[low])
                    level = int(entry.iloc[low]) if exact else 0
                    paths = None if exact else Coupled(int(phi.iloc[low]), last, capacity, refill)
                if paths is None:
                    _, _, level, last = admit(micros[low:high], level, last, capacity, refill)
                else:
                    paths.feed(micros[low:high])
            yield table(done)
        if current is not None:
            yield table([row()])

    return run


PARTS = (
    "_client string, _chain bigint, _part int, first bigint, last bigint, entry bigint, phi bigint, clock bigint, "
    f"{WALKED}, todo boolean"
)
ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
}
PART = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in PARTS.split(", ")])


def _join_parts(capacity: int, refill: int):
    """The short pass along one chain's parts: entries that are known now, and what to walk next.

    A part is walked next if its exit is open. Where its entry is open too, the fraction is taken from
    the last level that is known; a part that ended in a full bucket on all its paths gives one
    whatever it began with, most likely, and if not the pass stops there once more.
    """

    def run(parts: pa.Table) -> pa.Table:
        rows = parts.sort_by("_part").to_pylist()
        level, clock = rows[0]["entry"], rows[0]["clock"]
        base, since = level, clock  # a level that is known, or likely, and when it was
        for at, row in enumerate(rows):
            row["entry"], row["clock"] = level, clock
            if level is not None:
                base, since = level, clock
            phi = (base + (clock - since) * refill) % TOKEN
            if row["kind"] == FREE:
                level = row["exit"]
            elif row["kind"] == MET and level is not None and level % TOKEN == row["phi"]:
                level = exit_from(level, *(row[c] for c in ("phi", "low", "met", "top", "froms", "levels")))
            else:
                again = row["kind"] is None or level is not None or phi != row["phi"]
                row["phi"] = phi
                row["todo"] = again and at + 1 < len(rows)
                level = None
            row.setdefault("todo", False)
            clock = max(clock, row["last"])
            if level is not None:
                base, since = level, clock
            elif row["kind"] == MET and row["top"] < 0 and row["exit"] is not None:
                base, since = row["exit"], clock
        return pa.Table.from_pylist(rows, PART)

    return run


def token_bucket(
    events: DataFrame,
    client: str,
    ts: str,
    tie: str,
    capacity: int = P.BUCKET_CAPACITY,
    refill_per_minute: int = P.BUCKET_REFILL_PER_MINUTE,
    enabled: bool = True,
    max_rows_per_task: int = ROWS_PER_TASK,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``client, ts, tie, allowed, retry_after`` for every event.

    ``tie`` is a unique column that orders events of the same instant. Buckets start
    full at a client's first event. Intermediate tables go to ``scratch``; discard it after
    the last use of the result.
    """
    check_rate(capacity, refill_per_minute)
    columns = [client, ts, tie]
    if not enabled:
        return events.select(
            *columns, F.lit(True).alias("allowed"),
            F.lit(None).cast("bigint").alias("retry_after"),
        )
    scratch = Scratch(events.sparkSession) if scratch is None else scratch
    decided = decide(
        events, client, ts, tie, None, capacity, refill_per_minute, max_rows_per_task, scratch
    )
    return decided.select(*columns, "allowed", "retry_after")


def decide(
    events: DataFrame,
    client: str,
    ts: str,
    tie: str,
    state: DataFrame | None,
    capacity: int,
    refill_per_minute: int,
    max_rows_per_task: int = ROWS_PER_TASK,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``token_bucket`` that also keeps ``_client, _chain, _us, _level, _last``.

    ``state`` holds ``_client, _level, _last`` where buckets go on from earlier events.
    """
    spark = events.sparkSession
    scratch = Scratch(spark) if scratch is None else scratch
    fill = time_to_fill(capacity, refill_per_minute) + 1
    us = micros(events, ts)
    keyed = events.select(
        client, ts, tie, F.coalesce(F.col(client).cast("string"), F.lit("")).alias("_client"),
        us.alias("_us"),
    ).withColumn("_slice", F.expr(f"(_us - pmod(_us, {fill})) div {fill}"))
    keyed = _split_hot(keyed, max_rows_per_task, scratch)
    if state is None:
        state = spark.createDataFrame([], STATE_SCHEMA)
    slices = scratch.write(_slices(keyed, state, fill, max_rows_per_task), "throttle-slices")
    placed = keyed.join(slices.drop("first", "last"), ["_client", "_slice", "_sub"])
    start = state.withColumn("_chain", F.lit(0).cast("bigint"))
    on = ["_client", "_chain", "_part"]

    def sent(rows: DataFrame) -> DataFrame:
        return rows.repartition(*on).sortWithinPartitions(*on, "_us", tie)

    def walk(rows: DataFrame) -> DataFrame:
        spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return sent(rows).mapInPandas(_walk(capacity, refill_per_minute), spec + ", allowed boolean, retry_after bigint")

    if not slices.filter("_part > 0").head(1):
        return walk(placed.join(start, ["_client", "_chain"], "left"))

    # one folder per number of a part: a round reads the parts that it walks
    path = scratch.path("throttle-placed")
    placed.write.partitionBy("_part").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    parts = _settled(placed, slices, start, tie, sent, capacity, refill_per_minute, scratch)
    return walk(placed.join(parts.select(*on, F.col("entry").alias("_level"), F.col("clock").alias("_last")), on))


def _settled(
    placed: DataFrame, slices: DataFrame, start: DataFrame, tie: str, sent: Callable[[DataFrame], DataFrame],
    capacity: int, refill: int, scratch: Scratch,
) -> DataFrame:
    """Every part with the level at its entry. A chain whose parts all meet takes one round."""
    on = ["_client", "_chain", "_part"]
    parts = slices.groupBy(*on).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    opens = F.col("_part") == 0
    walked_columns = WALKED.split(", ")
    parts = parts.join(start, ["_client", "_chain"], "left").select(
        *on, "first", "last",
        F.when(opens, F.coalesce("_level", F.lit(capacity * TOKEN))).alias("entry"), F.lit(None).cast("bigint").alias("phi"),
        F.when(opens, F.coalesce("_last", "first")).alias("clock"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in walked_columns)],
    )
    while True:
        parts = parts.groupBy("_client", "_chain").applyInArrow(_join_parts(capacity, refill), PARTS)
        parts = scratch.write(parts, "throttle-parts")
        if not parts.filter("entry is null").head(1):
            return parts
        todo = parts.filter("todo")
        numbers = [r[0] for r in todo.select("_part").distinct().limit(PARTS_NAMED + 1).collect()]
        rows = placed.filter(F.col("_part").isin(numbers)) if len(numbers) <= PARTS_NAMED else placed
        rows = rows.select(*on, "_us", tie).join(todo.select(*on, "entry", "phi", "clock"), on)
        walked = sent(rows).mapInPandas(_summary(capacity, refill), SUMMARY)
        walked = scratch.write(walked, "throttle-walked")
        names = [c.split()[0] for c in walked_columns]
        old, new = F.struct(*names), walked.select(*on, F.struct(*names).alias("new"))
        parts = parts.drop("todo").join(new, on, "left").withColumn("now", F.coalesce("new", old)).drop(*names, "new").select("*", "now.*").drop("now")


def next_state(decided: DataFrame, tie: str, state: DataFrame | None) -> DataFrame:
    """Buckets after these events; clients without an event keep the state they had."""
    latest = F.struct(F.col("_chain"), F.col("_us"), F.col(tie))
    after = decided.groupBy("_client").agg(
        F.max_by(F.struct("_level", "_last"), latest).alias("s")
    ).select("_client", "s.*")
    if state is None:
        return after
    return after.unionByName(state.join(after, "_client", "left_anti"))
