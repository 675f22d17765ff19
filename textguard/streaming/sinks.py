"""Starting a stream with its checkpoint in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textguard.sources.storage import new_path


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB on the executors, out of the heap; its changes go to the
    checkpoint."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def start(
    stream: DataFrame,
    write_batch: Callable[[DataFrame, int], None],
    name: str,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Run a stream batch by batch. Pass the same ``checkpoint`` to resume it later."""
    writer = stream.writeStream.foreachBatch(write_batch).option(
        "checkpointLocation", checkpoint or new_path(stream.sparkSession, f"{name}-offsets")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def to_parquet(
    stream: DataFrame, path: str, name: str, checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append a stream to a parquet folder, exactly once through the sink's own log."""
    writer = stream.writeStream.format("parquet").outputMode("append").option(
        "path", path
    ).option(
        "checkpointLocation", checkpoint or new_path(stream.sparkSession, f"{name}-offsets")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
