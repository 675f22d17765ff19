"""Token-bucket decisions on a stream, one small state per client."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textguard.functions import patterns as P
from textguard.functions.bucket import TOKEN, admit, check_rate, fill_micros
from textguard.operators.throttle import STATE_SCHEMA, decide, micros, next_state
from textguard.sources.storage import Scratch, remove
from textguard.streaming.sinks import start, use_rocksdb

OUTPUT = "client string, event_id %s, ts_us bigint, allowed boolean, retry_after bigint"
STATE = "level bigint, last bigint"


def throttle_stream(
    events: DataFrame,
    client: str,
    ts: str,
    event_id: str,
    capacity: int = P.BUCKET_CAPACITY,
    refill_per_minute: int = P.BUCKET_REFILL_PER_MINUTE,
    lateness: timedelta | None = None,
) -> DataFrame:
    """``client, event_id, ts_us, allowed, retry_after`` for a stream of events.

    State is two numbers per client; times without zone are read as UTC and events without a
    client share the bucket of "", as in the batch operator. Events of one micro-batch are taken in time order;
    one that is older than the last refill refills nothing and still consumes.

    One client's share of a micro-batch is sorted in memory, so bound it by the source's
    rate options (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). Where a client can
    bring more than that, use ``throttle_batches``.

    State is kept in RocksDB. With ``lateness`` a bucket leaves it once the watermark says that it has been
    idle long enough to be full, which changes no decision, as a client without state starts with a
    full bucket; Spark then leaves out events that come later than that. Without, every client
    ever seen stays and no event is left out.
    """
    check_rate(capacity, refill_per_minute)
    use_rocksdb(events.sparkSession)
    fill = fill_micros(capacity, refill_per_minute)

    def take(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        if state.exists:
            level, last = state.get
        else:
            level, last = capacity * TOKEN, int(rows["ts_us"].iloc[0])
        allowed, waits, level, last = admit(
            rows["ts_us"].to_numpy(), level, last, capacity, refill_per_minute
        )
        state.update((int(level), int(last)))
        if lateness is not None:
            full_ms = -(-(int(last) + fill) // 1000)
            state.setTimeoutTimestamp(max(full_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "client": key[0],
                "event_id": rows["event_id"].to_numpy(),
                "ts_us": rows["ts_us"].to_numpy(),
                "allowed": allowed,
                "retry_after": pd.Series(waits).where(~allowed).astype("Int64"),
            }
        )

    keyed = events.select(
        F.coalesce(F.col(client).cast("string"), F.lit("")).alias("client"),
        F.col(event_id).alias("event_id"), micros(events, ts).alias("ts_us"),
    )
    timeout = GroupStateTimeout.NoTimeout
    if lateness is not None:
        keyed = keyed.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", f"{int(lateness.total_seconds())} seconds")
        timeout = GroupStateTimeout.EventTimeTimeout
    return keyed.groupBy("client").applyInPandasWithState(
        take, OUTPUT % dict(events.dtypes)[event_id], STATE, "append", timeout
    )


def throttle_batches(
    events: DataFrame,
    client: str,
    ts: str,
    tie: str,
    out_path: str,
    state_path: str,
    capacity: int = P.BUCKET_CAPACITY,
    refill_per_minute: int = P.BUCKET_REFILL_PER_MINUTE,
    checkpoint: str | None = None,
    available_now: bool = True,
    lateness: timedelta = timedelta(days=1),
) -> StreamingQuery:
    """The same decisions by way of the batch operator, with the state in a table.

    Each micro-batch cuts and walks hot clients as the batch operator does, so none has
    to fit into one task. Decisions and the state after them go to one folder per batch:
    a batch that runs again starts from the same state and replaces its own output.

    A bucket that would be full ``lateness`` before the newest event leaves the state: a client without
    state starts with a full bucket, so no decision changes but for events that come later than that.
    No event is left out.
    """
    check_rate(capacity, refill_per_minute)
    idle = fill_micros(capacity, refill_per_minute) + int(lateness.total_seconds() * 1_000_000)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = None
        if batch_id > 0:
            state = spark.read.schema(STATE_SCHEMA).parquet(f"{state_path}/batch={batch_id - 1}")
        with Scratch(spark) as scratch:
            decided = decide(batch, client, ts, tie, state, capacity, refill_per_minute, scratch=scratch)
            decided = scratch.write(decided, "throttled")
            after = scratch.write(next_state(decided, tie, state), "buckets")
            newest = after.agg(F.max("_last")).head()[0]
            kept = after if newest is None else after.filter(F.col("_last") > newest - idle)
            kept.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
            rows = decided.select(client, ts, tie, "allowed", "retry_after")
            rows.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        if batch_id > 1:  # only the last state is read again
            remove(spark, f"{state_path}/batch={batch_id - 2}")

    return start(events, write_batch, "throttle", checkpoint, available_now)
