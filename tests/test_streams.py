"""Streams and the kept mapping table: what is replaced, repeated, merged and dropped."""

import base64
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from textguard.operators import protection as PR
from textguard.operators import texts
from textguard.sources.mappings import MappingTable
from textguard.sources.storage import Scratch, new_path
from textguard.streaming import mask as mask_module
from textguard.streaming import rehydrate as rehydrate_module
from textguard.streaming.mask import mask_and_protect
from textguard.streaming.rehydrate import RequestState, rehydrate_batches, rehydrate_stream, rehydrated_batch
from textguard.streaming.sinks import to_parquet
from textguard.streaming.throttle import throttle_batches, throttle_stream

KEY = base64.b64encode(bytes(range(32))).decode()
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
REPLIES = "request_id string, provider string, response_text string, reply_ts timestamp"


def minute(m):
    return START + timedelta(minutes=m)


def sets_of(spark, *rows):
    """(request, text, minute stored, minutes to live)."""
    out = None
    for request, text, stored, ttl in rows:
        df = texts.with_analysis(spark.createDataFrame([(request, text)], "request_id string, text string"))
        one = PR.protect(df, KEY, F.lit(minute(stored)), timedelta(minutes=ttl))
        out = one if out is None else out.unionByName(one)
    return out


def replies_of(spark, *rows):
    return spark.createDataFrame([(r, "mock", t, minute(m)) for r, t, m in rows], REPLIES)


def in_turn(spark, path, df):
    """Add rows to a stream's folder."""
    df.coalesce(1).write.mode("append").parquet(path)


def answers_of(spark, out):
    rows = spark.read.schema("request_id string, reply_ts timestamp, response string").parquet(out).collect()
    return [(r.request_id, r.reply_ts.replace(tzinfo=None), r.response) for r in rows]


def clock(m):
    return minute(m).replace(tzinfo=None)


def test_request_state():
    mark = lambda stored, expires: {"stored": stored, "expires": expires, "tie": 0, "mappings": [stored]}
    ask = lambda us: {"provider": "p", "response_text": "t", "us": us}
    state = RequestState([mark(10, 100), mark(50, 60)], [ask(20), ask(55), ask(70), ask(5), ask(90)])
    assert [(r[2], r[3]) for r in state.settle(30)] == [(20, [10]), (5, None)]
    assert [(r[2], r[3]) for r in state.settle(75)] == [(55, [50]), (70, None)]  # the older set does not come back
    assert state.sets == [] and state.next_time() == 90
    assert state.settle(95) and state.next_time() is None


@pytest.mark.parametrize("spread", [1, 3])
def test_replaced_sets_give_one_reply_each(spark, spread):
    """Sets stored again and replies in any order; state is empty after the last expiry."""
    sets_path, replies_path, out, checkpoint = (new_path(spark, n) for n in ("sets", "replies", "out", "ck"))

    def run():
        replies = spark.readStream.schema(REPLIES).parquet(replies_path)
        sets = spark.readStream.schema(PR.SET_SCHEMA).parquet(sets_path)
        stream = rehydrate_stream(replies, sets, KEY, lateness=timedelta(minutes=1), spread=spread)
        query = to_parquet(stream, out, "rehydrate", checkpoint)
        query.awaitTermination()
        return query

    in_turn(spark, sets_path, sets_of(spark, ("a", "x a1@b.org", 0, 10), ("a", "x a1@b.org", 0, 10), ("b", "x b1@b.org", 0, 30)))
    in_turn(spark, replies_path, replies_of(spark, ("a", "{{EMAIL_001}}", 1), ("a", "{{EMAIL_001}} again", 6), ("b", "{{EMAIL_001}}", 9), ("c", "{{EMAIL_001}}", 2)))
    run()
    in_turn(spark, sets_path, sets_of(spark, ("a", "x a2@b.org", 5, 10), ("b", "x b2@b.org", 7, 1), ("z", "x z@b.org", 60, 1)))
    in_turn(spark, replies_path, replies_of(spark, ("a", "{{EMAIL_001}}", 14), ("a", "{{EMAIL_001}} late", 16), ("z", "none", 60)))
    run()
    in_turn(spark, sets_path, sets_of(spark, ("end", "x e@b.org", 600, 1)))
    in_turn(spark, replies_path, replies_of(spark, ("end", "none", 600)))
    query = run()
    token = "{{EMAIL_001}}"
    assert sorted(answers_of(spark, out)) == sorted([
        ("a", clock(1), "a1@b.org"), ("a", clock(6), "a2@b.org again"), ("a", clock(14), "a2@b.org"), ("a", clock(16), f"{token} late"),
        ("b", clock(9), token), ("c", clock(2), token), ("z", clock(60), "none"),
    ])
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] <= 2 * spread  # only what ends the stream


def test_state_of_a_request_is_one_column_of_text(spark, tmp_path):
    """Few columns go to Python, odd texts come back as they were, and a set without values restores nothing."""
    out, sets_path, replies_path = (str(tmp_path / name) for name in ("out", "sets", "replies"))
    odd = 'q"\\ \u2028\x00 \U0001F600 {"a":1} {{EMAIL_001}}'
    sets = sets_of(spark, ("a", "x a@b.org", 0, 10), ("n", "x n@b.org", 0, 10), ("end", "x e@b.org", 600, 1))
    sets = sets.withColumn("mappings", F.expr("if(request_id = 'n', null, mappings)"))
    replies = replies_of(spark, ("a", odd, 1), ("n", "{{EMAIL_001}}", 1), ("n", None, 1), ("end", "none", 600))
    in_turn(spark, sets_path, sets)
    in_turn(spark, replies_path, replies)
    stream = rehydrate_stream(
        spark.readStream.schema(REPLIES).parquet(replies_path), spark.readStream.schema(sets.schema).parquet(sets_path), KEY
    )
    plan = stream._jdf.queryExecution().analyzed().toString()
    state = [line for line in plan.splitlines() if "FlatMapGroupsInPandasWithState" in line]
    assert len(state) == 1 and "row#" in state[0] and "provider#" not in state[0]
    to_parquet(stream, out, "rehydrate").awaitTermination()
    got = sorted(map(str, answers_of(spark, out)))
    assert got == sorted(map(str, [
        ("a", clock(1), odd.replace("{{EMAIL_001}}", "a@b.org")), ("n", clock(1), "{{EMAIL_001}}"), ("n", clock(1), None),
    ]))


def test_replies_in_batches_against_a_kept_table(spark):
    """Three batches; stores between them are seen; a batch reads only the days that can matter."""
    table, replies, out, checkpoint = (new_path(spark, n) for n in ("table", "replies", "out", "ck"))
    kept = MappingTable(spark, table)
    day = 24 * 60

    def run():
        stream = spark.readStream.schema(REPLIES).parquet(replies)
        rehydrate_batches(stream, table, KEY, out, timedelta(minutes=30), 2, checkpoint=checkpoint).awaitTermination()

    kept.store(sets_of(spark, ("a", "x old@b.org", -3 * day, 10), ("a", "x a1@b.org", 0, 10), ("b", "x b@b.org", 0, 10)))
    in_turn(spark, replies, replies_of(spark, ("a", "{{EMAIL_001}}", 1), ("b", "no token", 1), ("b", None, 1)))
    run()
    kept.store(sets_of(spark, ("a", "x a2@b.org", 2, 1)))
    in_turn(spark, replies, replies_of(spark, ("a", "{{EMAIL_001}}", 4)))
    run()
    kept.store(sets_of(spark, ("a", "x a3@b.org", 5, 20)))
    in_turn(spark, replies, replies_of(spark, ("a", "{{EMAIL_001}}", 6), ("b", "{{EMAIL_001}}", 9.5)))
    run()
    got = sorted(map(str, answers_of(spark, f"{out}/batch=*")))
    assert got == sorted(map(str, [
        ("a", clock(1), "a1@b.org"), ("b", clock(1), "no token"), ("b", clock(1), None), ("a", clock(4), "{{EMAIL_001}}"),
        ("a", clock(6), "a3@b.org"), ("b", clock(9.5), "b@b.org"),
    ]))
    plan = rehydrated_batch(replies_of(spark, ("a", "{{EMAIL_001}}", 6)), kept, KEY, timedelta(minutes=30))
    days = {f.split("day=")[1][:10] for f in plan.inputFiles() if "day=" in f}
    assert days == {"2024-01-01"} and "2023-12-29" in {e["day"] for e in kept.log()["entries"]}


def test_a_batch_does_not_shuffle_the_whole_table(spark, monkeypatch):
    """The ids of a batch go to the table whatever Spark's threshold; beyond the bound they meet in a shuffle."""
    kept = MappingTable(spark, new_path(spark, "table"))
    kept.store(sets_of(spark, ("a", "x a@b.org", 0, 10), ("b", "x b@b.org", 0, 10), ("c", "x c@b.org", 0, 10)))
    kept.store(sets_of(spark, ("a", "x new@b.org", 1, 10)))
    replies = replies_of(
        spark, ("a", "{{EMAIL_001}}", 2), ("a", "{{EMAIL_001}}", 2), ("b", "none", 2), ("z", "{{EMAIL_001}}", 2),
        (None, "{{EMAIL_001}}", 2), ("c", None, 2),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound, join in ((32_000_000, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(rehydrate_module, "SENT_IDS", bound)
            restored = rehydrated_batch(replies, kept, KEY, timedelta(minutes=30))
            plan = restored._jdf.queryExecution().executedPlan().toString()
            assert [join in line for line in plan.splitlines() if "LeftSemi" in line] == [True]
            got = sorted(map(str, (tuple(r) for r in restored.select("request_id", "response", "token_count").collect())))
            assert got == sorted(map(str, [
                ("a", "new@b.org", 1), ("a", "new@b.org", 1), ("b", "none", 0), ("z", "{{EMAIL_001}}", 0),
                (None, "{{EMAIL_001}}", 0), ("c", None, 0),
            ]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_masking_stopped_between_its_writes(spark, monkeypatch):
    """A batch dies after its sets were stored; run again, each set is there once."""
    source, masked, table, checkpoint = (new_path(spark, n) for n in ("in", "masked", "table", "ck"))
    for i in range(2):
        in_turn(spark, source, spark.createDataFrame([(f"r{i}{j}", f"mail u{j}@x.org") for j in range(3)], "request_id string, text string"))

    def run():
        stream = spark.readStream.schema("request_id string, text string").parquet(source)
        mask_and_protect(stream, KEY, masked, table, checkpoint=checkpoint).awaitTermination()

    real = MappingTable.store

    def dying(self, *args):
        real(self, *args)
        raise RuntimeError("stopped")

    monkeypatch.setattr(mask_module.MappingTable, "store", dying)
    with pytest.raises(Exception, match="stopped"):
        run()
    assert MappingTable(spark, table).read().count() == 6
    monkeypatch.setattr(mask_module.MappingTable, "store", real)
    run()
    run()
    sets = MappingTable(spark, table).read()
    assert sets.count() == 6 and sets.select("request_id").distinct().count() == 6
    rows = spark.read.parquet(f"{masked}/batch=*").collect()
    assert {(r.request_id, r.masked_text) for r in rows} == {(f"r{i}{j}", "mail {{EMAIL_001}}") for i in range(2) for j in range(3)}
    assert "x.org" not in str(sets.collect())


def test_kept_table_is_merged_and_purged(spark):
    path = new_path(spark, "table")
    kept = MappingTable(spark, path)
    day = 24 * 60
    for i in range(20):
        kept.store(sets_of(spark, ("a", f"x a{i}@b.org", i / 10, 10)))
    kept.store(sets_of(spark, ("future", "x f@b.org", 0, 3 * day)))
    before, version = kept.read(), kept.versions()[-1]
    assert before.count() == 21
    assert kept.compact() and not kept.compact()
    assert kept.read().count() == 2 and kept.read(version=version).count() == 21 and before.count() == 21
    days = [e["day"] for e in kept.log()["entries"]]
    assert len(days) == len(set(days)) == 2
    future = [e["folder"] for e in kept.log()["entries"] if e["day"] == "2024-01-04"]

    kept.store(sets_of(spark, ("b", "x b1@b.org", 0, 25), ("b", "x b2@b.org", 5, 3)))  # replaced by one that lives shorter
    kept.purge(minute(15), timedelta(minutes=30))
    assert [e["folder"] for e in kept.log()["entries"] if e["day"] == "2024-01-04"] == future  # untouched
    assert {r.request_id for r in PR.live_sets(kept.read(), F.lit(minute(15))).collect()} == {"future"}
    assert {r.request_id: len(r.mappings) for r in PR.newest_sets(kept.read()).collect()} == {"a": 0, "b": 0, "future": 1}
    kept.purge(minute(2 * day), timedelta(minutes=30))
    assert {r.request_id for r in kept.read().collect()} == {"future"}
    kept.vacuum(timedelta(0))
    assert len(kept.versions()) == 1 and kept.read().count() == 1
    folders = {f.split("/data/")[1].split("/")[0] for f in kept.read().inputFiles()}
    assert {n for n, _ in kept._names("data")} == folders


def test_sketches_count_without_old_days(spark):
    from textguard.operators import sketches

    kept = MappingTable(spark, new_path(spark, "table"))
    rows = sets_of(spark, ("x", "x a@b.org", 0, 10)).drop("request_id")
    many = rows.crossJoin(spark.range(30_000).selectExpr("cast(id as string) AS request_id"))
    kept.store(many.withColumn("expires_at", F.when(F.col("request_id") % 3 == 0, F.lit(minute(2000))).otherwise(F.lit(minute(4000)))))
    kept.store(many.filter("request_id < 9000").withColumn("expires_at", F.lit(minute(20))))
    for now, wanted in ((10, 30_000), (30, 30_000), (2001, 20_000), (4001, 0)):
        got = kept.sketched_requests(minute(now))
        assert abs(got.first().live_requests - wanted) <= 0.04 * wanted
    days = {f.split("day=")[1][:10] for f in got.inputFiles() if "day=" in f}
    assert days <= {"2024-01-03"}
    found = spark.range(60_000).selectExpr("'EMAIL' AS type", "concat('U', id % 20000, '@x.org') AS value", "id % 7 AS day")
    both = found.unionByName(spark.range(3).selectExpr("'SSN' AS type", "cast(id as string) AS value", "id AS day"))
    total = sketches.estimated(sketches.merged(sketches.value_sketches(both, "day").drop("day"), "type"), "values")
    rows = {r.type: (r.detections, r["values"]) for r in total.collect()}
    assert rows["SSN"] == (3, 3) and rows["EMAIL"][0] == 60_000 and abs(rows["EMAIL"][1] - 20_000) <= 800


def test_writers_do_not_lose_each_other(spark):
    """Two writers that read the same version: the second one tries again on the newer."""
    path = new_path(spark, "table")
    one, two = MappingTable(spark, path), MappingTable(spark, path)
    seen = []

    def late(log):
        if not seen:
            seen.append(1)
            two.store(sets_of(spark, ("b", "x b@b.org", 0, 10)))
        return {**log, "entries": [*log["entries"], {"folder": "x", "day": "1970-01-01"}]}

    assert one._change(late)
    assert len(one.log()["entries"]) == 2 and one.versions() == [1, 2]
    assert not one._commit(2, {"entries": [], "streams": {}})


def test_batches_of_a_stream_are_stored_once(spark):
    kept = MappingTable(spark, new_path(spark, "table"))
    rows = sets_of(spark, ("a", "x a@b.org", 0, 10))
    kept.store(rows, "s", 0)
    kept.store(rows, "s", 0)
    assert kept.read().count() == 1
    kept.store(rows, "s", 1)
    kept.compact()
    kept.store(rows, "s", 1)  # merged already
    assert kept.read().count() == 1


EVENTS = "client string, ts timestamp, id bigint"


def events_of(spark, *rows):
    return spark.createDataFrame([(c, START + timedelta(seconds=s), i) for i, (c, s) in enumerate(rows)], EVENTS)


def test_idle_buckets_leave_the_stream_state(spark):
    path, out, checkpoint = (new_path(spark, n) for n in ("in", "out", "ck"))

    def run(*rows):
        in_turn(spark, path, events_of(spark, *rows))
        stream = throttle_stream(spark.readStream.schema(EVENTS).parquet(path), "client", "ts", "id", 2, 60, timedelta(seconds=10))
        query = to_parquet(stream, out, "throttle", checkpoint)
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]

    assert run(*[(f"c{i}", 0) for i in range(20)], ("c0", 0), ("c0", 0)) == 20
    assert run(("late", 100)) == 1
    assert run(("c0", 101), ("c0", 101), ("c0", 101), ("end", 10_000)) == 1
    got = sorted((r.client, r.ts_us, r.allowed) for r in spark.read.parquet(out).filter("client = 'c0'").collect())
    assert sorted(a for _, _, a in got) == [False, False, True, True, True, True]
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_idle_buckets_leave_the_batch_state(spark):
    path, out, state, checkpoint = (new_path(spark, n) for n in ("in", "out", "state", "ck"))
    for n, rows in enumerate([[(f"c{i}", 0) for i in range(20)], [("x", 100)], [("c0", 105), ("x", 100)]]):
        in_turn(spark, path, events_of(spark, *rows))
        stream = spark.readStream.schema(EVENTS).parquet(path)
        throttle_batches(stream, "client", "ts", "id", out, state, 1, 60, checkpoint, lateness=timedelta(seconds=10)).awaitTermination()
        held = {r._client for r in spark.read.parquet(f"{state}/batch={n}").collect()}
        assert held == [{f"c{i}" for i in range(20)}, {"x"}, {"c0", "x"}][n]
    assert spark.read.parquet(f"{out}/batch=*").count() == 23


def test_scratch_of_lookups_is_discarded(spark):
    from textguard.operators import rehydration as RH

    sets = sets_of(spark, ("a", "x a@b.org", 0, 10))
    replies = spark.createDataFrame([("a", "mock", "{{EMAIL_001}}")], "request_id string, provider string, response_text string")
    tokens = spark.createDataFrame([("a", "{{EMAIL_001}}")], "request_id string, token string")
    with Scratch(spark) as scratch:
        assert RH.rehydrate(replies, sets, KEY, F.lit(minute(1)), scratch=scratch).first().response == "a@b.org"
        assert PR.lookup_mappings(tokens, sets, F.lit(minute(1)), scratch=scratch).filter("sealed is not null").count() == 1
        assert PR.unresolved_tokens(tokens, sets, F.lit(minute(1)), scratch=scratch).count() == 0
        paths = list(scratch.paths)
    assert len(paths) == 3
    for path in paths:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)
