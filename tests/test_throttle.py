import math
import random
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textguard.functions.bucket import FREE, TOKEN, Coupled, admit, exit_from
from textguard.operators import reports
from textguard.operators.throttle import token_bucket
from textguard.sources.storage import Scratch, new_path
from textguard.streaming.throttle import throttle_batches, throttle_stream

START = datetime(2024, 1, 1)
SCHEMA = "client string, ts timestamp, id bigint"


def _events(spark, *clients):
    """(client, seconds...) per client, ids in order of time."""
    rows, n = [], 0
    for name, seconds in clients:
        for s in seconds:
            rows.append((name, START + timedelta(seconds=s), n))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def _run(df, capacity, refill, **kw):
    rows = token_bucket(df, "client", "ts", "id", capacity, refill, **kw).collect()
    return [(r.allowed, r.retry_after) for r in sorted(rows, key=lambda r: r.id)]


def test_goldens(spark):
    one = _events(spark, ("c", [0, 0, 0]))
    assert _run(one, 3, 60) == [(True, None)] * 3
    assert _run(one, 2, 60) == [(True, None), (True, None), (False, 1)]
    assert _run(one, 1, 1) == [(True, None), (False, 60), (False, 60)]
    later = _events(spark, ("c", [0, 0, 0, 61, 61, 61]))
    assert [a for a, _ in _run(later, 2, 60)] == [True, True, False, True, True, False]
    idle = _events(spark, ("c", [0, 3600, 3600, 3600]))
    assert [a for a, _ in _run(idle, 2, 600)] == [True, True, True, False]
    two = _events(spark, ("a", [0, 0]), ("b", [0]))
    assert [a for a, _ in _run(two, 1, 60)] == [True, False, True]


def test_parameters(spark):
    df = _events(spark, ("c", [0, 0]))
    for capacity, refill in ((0, 60), (10, 0), (-5, -5)):
        with pytest.raises(ValueError):
            token_bucket(df, "client", "ts", "id", capacity, refill)
    assert _run(df, 1, 1, enabled=False) == [(True, None), (True, None)]


def _busy(spark, n=4000):
    """One client with nearly all events and no pause, others with pauses."""
    hot = [0.05 * i + (i % 7) * 0.01 for i in range(n)]
    bursts = [600 * (i // 20) + (i % 20) * 0.3 for i in range(400)]
    rare = [97.3 * i for i in range(100)]
    return _events(spark, ("hot", sorted(hot)), ("burst", bursts), ("rare", rare), (None, [0, 1, 2]))


def _plain(micros, level, last, capacity, refill):
    """One event after the other, in whole units of which a token has 60,000,000."""
    decided = []
    for now in micros:
        if now > last:
            level = min(capacity * TOKEN, level + (now - last) * refill)
            last = now
        if level >= TOKEN:
            level -= TOKEN
            decided.append((True, None))
        else:
            decided.append((False, max(1, math.ceil(Fraction(TOKEN - level, 1_000_000 * refill)))))
    return decided, level, last


@settings(max_examples=60, deadline=None)
@given(
    gaps=st.lists(st.integers(-2_000_000, 3_000_000), min_size=1, max_size=200),
    dense=st.integers(1, 60), capacity=st.integers(1, 5), refill=st.integers(1, 200),
)
def test_stretches_equal_single_steps(gaps, dense, capacity, refill):
    """With long refused stretches and clocks that go backwards."""
    micros = np.cumsum(np.repeat(gaps, dense) // dense).astype("int64")
    decided, level, last = _plain(micros.tolist(), capacity * TOKEN, int(micros[0]), capacity, refill)
    allowed, waits, got_level, got_last = admit(micros, capacity * TOKEN, int(micros[0]), capacity, refill)
    assert [(bool(a), None if a else int(w)) for a, w in zip(allowed, waits)] == decided
    assert (got_level, got_last) == (level, last)


def _expected(df, capacity, refill):
    rows = sorted(df.collect(), key=lambda r: (r.client or "", r.ts, r.id))
    by_client = {}
    for r in rows:
        by_client.setdefault(r.client, []).append(r)
    out = {}
    for group in by_client.values():
        micros = [round((r.ts - START).total_seconds() * 1e6) for r in group]
        decided, _, _ = _plain(micros, capacity * TOKEN, micros[0], capacity, refill)
        out |= {r.id: d for r, d in zip(group, decided)}
    return [out[i] for i in sorted(out)]


@pytest.mark.parametrize("capacity, refill", [(1, 60), (5, 120), (120, 120), (3, 7)])
def test_equals_a_plain_loop(spark, capacity, refill):
    df = _busy(spark)
    assert _run(df, capacity, refill) == _expected(df, capacity, refill)


def test_hot_client_in_several_parts(spark):
    """With few rows allowed per task the hot chain is cut into parts; same decisions."""
    df = _busy(spark)
    assert _run(df, 5, 120, max_rows_per_task=700) == _expected(df, 5, 120)


@settings(max_examples=150, deadline=None)
@given(
    seed=st.integers(0, 10**6), capacity=st.sampled_from([1, 2, 5, 30]), refill=st.sampled_from([1, 7, 60, 600]),
    pace=st.sampled_from([0.05, 0.5, 0.95, 1.0, 1.1, 3.0]), patience=st.sampled_from([0, 5, 1000]),
)
def test_known_exits_hold_from_every_entry(seed, capacity, refill, pace, patience):
    rng = random.Random(seed)
    mean = TOKEN / refill * pace
    micros = np.cumsum([int(rng.expovariate(1 / mean)) - (rng.random() < 0.02) * int(mean) for _ in range(150)]).astype("int64")
    last = int(micros[0]) - rng.randrange(int(mean) + 1)
    fraction = rng.randrange(TOKEN)
    paths = Coupled(fraction, last, capacity, refill)
    paths.patience = patience
    for part in np.array_split(micros, 4):
        paths.feed(part)
    kind, one, *table = paths.exits()
    for entry in range(fraction, max(1, (capacity - 1) * TOKEN + 1), TOKEN):
        wanted = _plain(micros.tolist(), entry, last, capacity, refill)[1]
        assert exit_from(entry, fraction, *table) == wanted and one in (None, wanted)
    if kind == FREE:
        assert one == _plain(micros.tolist(), rng.randrange(max(1, (capacity - 1) * TOKEN)), last, capacity, refill)[1]


def _paced(spark, seed, pace, n, capacity=4, refill=60):
    """A client that never pauses: mean gap of ``pace`` refills of a token."""
    rng, at, seconds = random.Random(seed), 0.0, []
    for _ in range(n):
        at += min(capacity * 60 / refill * 0.9, rng.expovariate(1 / (pace * 60 / refill)))
        seconds.append(round(at, 6))
    return seconds


@pytest.mark.parametrize("pace", [0.2, 0.9, 1.0, 1.6])
def test_parts_of_clients_that_never_pause(spark, pace):
    """Over, about and under the rate, and one that changes; parts of 150 rows."""
    mixed = _paced(spark, 1, 0.3, 700)
    mixed += [mixed[-1] + s for s in _paced(spark, 2, 1.5, 700)]
    df = _events(spark, ("a", _paced(spark, 3, pace, 1500)), ("mixed", mixed), ("few", [0, 1, 50]))
    assert _run(df, 4, 60, max_rows_per_task=150) == _expected(df, 4, 60)


def test_many_parts_take_one_round(spark):
    """A chain of 100 parts that meet: as many jobs as one of ten, and nothing is left behind."""
    def jobs(n):
        df = _events(spark, ("hot", _paced(spark, 5, 0.4, n)))
        scratch = Scratch(spark)
        decided = token_bucket(df, "client", "ts", "id", 4, 60, max_rows_per_task=80, scratch=scratch)
        walked = [p for p in scratch.paths if "throttle-walked" in p]
        got = [(r.allowed, r.retry_after) for r in sorted(decided.collect(), key=lambda r: r.id)]
        assert got == _expected(df, 4, 60)
        parts = spark.read.parquet([p for p in scratch.paths if "throttle-parts" in p][-1]).count()
        kept = list(scratch.paths)
        scratch.discard()
        for path in kept:
            with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
                spark.read.parquet(path).count()
        return len(walked), parts

    few, many = jobs(900), jobs(8000)
    assert few[0] <= 2 and many[0] <= 3  # one, and one more behind a bucket that was full
    assert many[1] >= 100


def test_equals_one_walk_on_the_given_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_type", "ts", "event_id")
    decided = token_bucket(events, "event_type", "ts", "event_id", 3, 2, max_rows_per_task=300)
    got = {r.event_id: (r.allowed, r.retry_after) for r in decided.collect()}
    wanted = {}
    for _, rows in events.toPandas().sort_values(["ts", "event_id"]).groupby("event_type"):
        micros = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        allowed, waits, _, _ = admit(micros, 3 * TOKEN, int(micros[0]), 3, 2)
        wanted |= {i: (bool(a), None if a else int(w)) for i, a, w in zip(rows["event_id"], allowed, waits)}
    assert got == wanted


def test_hot_slice_is_cut(spark):
    from textguard.operators import throttle as T

    events = _events(spark, ("hot", [0.7 * i for i in range(1000)]), ("cold", [0, 5000]))
    assert _run(events, 100, 1, max_rows_per_task=200) == _run(events, 100, 1)
    uneven = _events(spark, ("hot", [0.0] * 500 + [60.0 * i for i in range(1, 90)]))
    assert _run(uneven, 100, 1, max_rows_per_task=50) == _run(uneven, 100, 1)
    fill = 100 * 60_000_000 + 1
    keyed = events.select(F.col("client").alias("_client"), T.micros(events, "ts").alias("_us")).withColumn(
        "_slice", F.expr(f"(_us - pmod(_us, {fill})) div {fill}")
    )
    split = T._split_hot(keyed, 100, Scratch(spark))
    state = spark.createDataFrame([], T.STATE_SCHEMA)
    placed = split.join(T._slices(split, state, fill, 100), ["_client", "_slice", "_sub"])
    rounds = placed.groupBy("_client", "_chain", "_part").count().collect()
    assert sum(r["count"] for r in rounds) == 1002 and max(r["count"] for r in rounds) <= 200


def test_stream_reads_times_without_zone_as_utc(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql(
            "SELECT 'c' AS client, timestamp_ntz'2024-03-10 01:59:50' AS ts, 1L AS id "
            "UNION ALL SELECT 'c', timestamp_ntz'2024-03-10 03:00:00', 2L UNION ALL SELECT null, timestamp_ntz'2024-03-10 03:00:00', 3L"
        ).coalesce(1)
        df.write.parquet(f"{tmp_path}/in")
        stream = throttle_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "client", "ts", "id", 1, 1)
        stream.writeStream.format("memory").queryName("zoneless").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = {r.event_id: (r.client, r.allowed) for r in spark.table("zoneless").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {1: ("c", True), 2: ("c", True), 3: ("", True)}


def test_timestamp_without_zone(spark):
    df = _events(spark, ("c", [0, 0, 61])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [a for a, _ in _run(df, 1, 1)] == [True, False, True]


def test_summary(spark):
    decided = token_bucket(_events(spark, ("a", [0, 0, 0]), ("b", [0])), "client", "ts", "id", 1, 1)
    got = {r.client: (r.admitted, r.rejected, r.max_retry_after)
           for r in reports.throttle_summary(decided, "client").collect()}
    assert got == {"a": (1, 2, 60), "b": (1, 0, None)}


def _in_batches(spark, df, cuts):
    """A file stream with one file per time range, in that order."""
    path = new_path(spark, "stream")
    edges = [START + timedelta(seconds=c) for c in cuts]
    for low, high in zip(edges, edges[1:]):
        df.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_with_state(spark):
    df = _busy(spark, 800).filter("client is not null")
    stream = throttle_stream(_in_batches(spark, df, [0, 10, 31, 10**6]), "client", "ts", "id", 5, 120)
    out = new_path(spark, "out")
    stream.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "ck")).option(
        "path", out).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    got = [(r.allowed, r.retry_after) for r in sorted(rows, key=lambda r: r.event_id)]
    assert got == _expected(df, 5, 120)


def test_stream_in_batches(spark):
    df = _busy(spark, 800).filter("client is not null")
    out, state = new_path(spark, "out"), new_path(spark, "state")
    throttle_batches(_in_batches(spark, df, [0, 10, 31, 10**6]), "client", "ts", "id", out, state,
                     5, 120).awaitTermination()
    rows = spark.read.parquet(out).collect()
    got = [(r.allowed, r.retry_after) for r in sorted(rows, key=lambda r: r.id)]
    assert got == _expected(df, 5, 120)
    assert len({r.batch for r in spark.read.parquet(out).select("batch").collect()}) == 3


def test_late_event_refills_nothing(spark):
    """A batch that brings an older event: it consumes, and the clock stays where it was."""
    df = _events(spark, ("c", [100, 100, 40, 101]))
    path = new_path(spark, "stream")
    for ids in ([0], [1, 2, 3]):
        df.filter(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out, state = new_path(spark, "out"), new_path(spark, "state")
    throttle_batches(stream, "client", "ts", "id", out, state, 2, 1).awaitTermination()
    got = {r.id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == {0: True, 2: True, 1: False, 3: False}
