"""Restoring a stream of replies against stored or streaming mapping sets."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textguard.functions import patterns as P
from textguard.functions.binding import attach
from textguard.functions.sealing import hide_keys
from textguard.operators.protection import newest_sets
from textguard.operators.rehydration import TYPES, restore
from textguard.sources.mappings import MappingTable, day_of
from textguard.streaming.sinks import start, use_rocksdb

MAPPINGS = "array<struct<token:string,type:string,sealed:binary,start:int,end:int>>"
ROW = (
    "struct<us:bigint,provider:string,response_text:string,expires:bigint,tie:bigint,mappings:string>"
)
#: A stream's row, the state of a request and its answers go to Python and back as JSON in one column: Spark
#: turns every column of every request into a pandas series of its own. Sealed sets stay text on that way.
STATE = "held string"
AS_WRITTEN = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
ANSWER = "struct<provider:string,response_text:string,us:bigint,request_id:string,mappings:string>"
#: Bytes of ids, 32 more for each, up to which a batch sends them to all tasks that read the mapping table.
SENT_IDS = 32_000_000


class RequestState:
    """One request: the sets that may still matter and the replies that wait for them.

    A reply takes the newest set stored up to its time, if that is still alive then. What was
    stored up to a time is complete once the watermark has reached it, so replies wait until then. Of the sets stored up to
    the watermark only the newest is kept, and that only until it expires: a later store replaces
    a set as a whole, so an older one never comes back.
    """

    def __init__(self, sets: list[dict], replies: list[dict]):
        self.sets, self.replies = sets, replies

    def settle(self, now: int) -> list[tuple]:
        """Replies that can be answered at watermark ``now`` (microseconds), with their mappings."""
        out, waiting = [], []
        self.sets.sort(key=lambda s: (s["stored"], s["expires"], -s["tie"]))
        for reply in self.replies:
            if reply["us"] > now:
                waiting.append(reply)
                continue
            known = [s for s in self.sets if s["stored"] <= reply["us"]]
            alive = known and reply["us"] < known[-1]["expires"]
            out.append((reply["provider"], reply["response_text"], reply["us"], known[-1]["mappings"] if alive else None))
        self.replies = waiting
        old = [s for s in self.sets if s["stored"] <= now]
        if old:
            self.sets = [s for s in old[-1:] if s["expires"] > now] + self.sets[len(old) :]
        return out

    def next_time(self) -> int | None:
        """When something changes without further rows: a reply is due or a set expires."""
        times = [r["us"] for r in self.replies] + [max(s["stored"], s["expires"]) for s in self.sets]
        return min(times, default=None)


def _take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = RequestState(*json.loads(state.get[0])) if state.exists else RequestState([], [])
    for batch in batches:
        for row in map(json.loads, batch["row"] if len(batch) else ()):
            if "tie" in row:  # a set
                held.sets.append({"stored": row["us"], "expires": row["expires"], "tie": row["tie"], "mappings": row.get("mappings")})
            else:
                held.replies.append({"provider": row.get("provider"), "response_text": row.get("response_text"), "us": row["us"]})
    watermark = state.getCurrentWatermarkMs()
    done = held.settle(watermark * 1000)
    due = held.next_time()
    if due is None:
        if state.exists:
            state.remove()
    else:
        state.update((json.dumps([held.sets, held.replies]),))
        state.setTimeoutTimestamp(max(-(-due // 1000), watermark + 1))
    if done:
        names = ("provider", "response_text", "us", "mappings")
        yield pd.DataFrame({"row": [json.dumps({**dict(zip(names, d)), "request_id": key[0]}) for d in done]})


def _matched(replies: DataFrame, sets: DataFrame, lateness: timedelta, spread: int) -> DataFrame:
    """Every reply with the mappings of its request, both from streams."""
    use_rocksdb(replies.sparkSession)
    delay = f"{int(lateness.total_seconds())} seconds"

    def none(kind: str):
        return F.lit(None).cast(kind)

    def packed(**fields: Column) -> Column:
        return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]).cast(ROW)).alias("row")

    reply = packed(
        us=F.unix_micros("reply_ts"), provider=F.col("provider"), response_text=F.col("response_text"),
        expires=none("bigint"), tie=none("bigint"), mappings=none("string"),
    )
    sealed = packed(
        us=F.unix_micros("stored_at"), provider=none("string"), response_text=none("string"),
        expires=F.unix_micros("expires_at"), tie=F.xxhash64("mappings"), mappings=F.to_json(F.col("mappings").cast(MAPPINGS)),
    )
    request = F.col("request_id").cast("string").alias("request_id")
    asked = replies.withWatermark("reply_ts", delay)
    stored = sets.withWatermark("stored_at", delay)
    keys = ["request_id"]
    if spread > 1:
        keys.append("part")
        part = F.pmod(F.xxhash64("provider", "response_text", "reply_ts"), F.lit(spread))
        asked = asked.withColumn("part", part)
        stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    asked = asked.select(request, *keys[1:], F.col("reply_ts").alias("at"), reply)
    stored = stored.select(request, *keys[1:], F.col("stored_at").alias("at"), sealed)
    answers = asked.unionByName(stored).groupBy(*keys).applyInPandasWithState(
        _take, "row string", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    opened = attach(answers, "answer", F.from_json("row", ANSWER, AS_WRITTEN)).select("answer.*")
    return opened.select(
        "provider", "response_text", F.timestamp_micros("us").alias("reply_ts"), "request_id",
        F.from_json("mappings", MAPPINGS, AS_WRITTEN).alias("mappings"),
    )


def rehydrate_stream(
    replies: DataFrame,
    sets: DataFrame,
    key: str | None,
    lateness: timedelta = timedelta(0),
    types: Iterable[str] = TYPES,
    spread: int = 1,
) -> DataFrame:
    """``request_id, provider, reply_ts, response, token_count, failure_kind``.

    ``replies`` is a stream of ``request_id, provider, response_text, reply_ts``. A reply outside the
    lifetime of its set keeps its tokens.

    Of stored ``sets`` the newest of each request is taken: a stream-static left join; for a large
    table use ``rehydrate_batches``.

    Streaming ``sets`` may hold any number of sets per request. State is kept by request: the
    newest set until it expires, and replies until the watermark passes them, so each reply
    comes out once, with the set that was in force at its time. Rows later than ``lateness``
    are left out by Spark. ``spread`` deals the replies of a request to that many keys, each
    with the sets, where one request may have a large share of all replies.
    """
    if sets.isStreaming:
        joined = _matched(replies, sets, lateness, spread)
    else:
        sealed = newest_sets(sets).select(F.col("request_id").alias("_rid"), "mappings", "stored_at", "expires_at")
        alive = (F.col("reply_ts") >= F.col("stored_at")) & (F.col("reply_ts") < F.col("expires_at"))
        joined = replies.join(sealed, (F.col("request_id") == F.col("_rid")) & alive, "left")
    restored = attach(joined, "restored", restore("response_text", "mappings", key, tuple(types)))
    return restored.select("request_id", "provider", "reply_ts", "restored.*")


def rehydrated_batch(
    replies: DataFrame, table: MappingTable, key: str | None, max_ttl: timedelta, types: Iterable[str] = TYPES
) -> DataFrame:
    """Replies of one batch restored from a mapping table.

    Only days are read that can matter to the earliest reply, see ``operators.protection.recent``, and
    only the sets of requests that have a reply with a token here are ranked and shuffled: the ids of a batch
    go to the table, so that it is not shuffled again for each batch. More than ``SENT_IDS`` meet it in a
    shuffle, as a batch may be of any size.
    """
    with_token = F.contains("response_text", F.lit(P.TOKEN_HINT))
    id_bytes = F.sum(F.when(with_token, F.octet_length(F.col("request_id").cast("string")) + 32))
    earliest, sent = replies.agg(F.min(F.unix_micros("reply_ts")), id_bytes).head()
    since = day_of(datetime.fromtimestamp((earliest or 0) / 1_000_000, timezone.utc) - max_ttl)
    asked = replies.filter(with_token).select(F.col("request_id").alias("_rid")).distinct()
    if (sent or 0) <= SENT_IDS:
        asked = F.broadcast(asked)
    mine = table.read(since).join(asked, F.col("request_id") == F.col("_rid"), "left_semi")
    sealed = newest_sets(mine).select(F.col("request_id").alias("_rid"), "mappings", "stored_at", "expires_at")
    alive = (F.col("reply_ts") >= F.col("stored_at")) & (F.col("reply_ts") < F.col("expires_at"))
    joined = replies.join(sealed, (F.col("request_id") == F.col("_rid")) & alive & with_token, "left")
    restored = attach(joined, "restored", restore("response_text", "mappings", key, tuple(types)))
    return restored.select("request_id", "provider", "reply_ts", "restored.*")


def rehydrate_batches(
    replies: DataFrame,
    table_path: str,
    key: str | None,
    out_path: str,
    max_ttl: timedelta = timedelta(seconds=P.MAPPING_TTL_SECONDS),
    compact_every: int = 20,
    types: Iterable[str] = TYPES,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Restore a stream of replies from the ``MappingTable`` at ``table_path``, which others may go on
    filling: each batch reads the newest version. No set may live longer than ``max_ttl``.

    Restored replies go to one folder per batch, which a batch that runs again replaces. Every
    ``compact_every`` batches the days that new stores have added to are merged, so what a batch
    reads does not grow with their number; 0 leaves that to others.
    """
    types = tuple(types)
    hide_keys(replies.sparkSession)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        table = MappingTable(batch.sparkSession, table_path)
        if compact_every and batch_id % compact_every == compact_every - 1:
            table.compact()
        restored = rehydrated_batch(batch, table, key, max_ttl, types)
        restored.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return start(replies, write_batch, "rehydrate", checkpoint, available_now)
