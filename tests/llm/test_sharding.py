"""Shards: every row once, gapless, even, and the same for the same seed."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from textguard.llm import sharding
from textguard.sources.storage import new_path


def rows(spark, data, schema="doc_id long, text string, slot string"):
    return spark.createDataFrame(data, schema)


def check(got, data, shards):
    assert Counter((r.doc_id, r.text, r.slot_) for r in got) == Counter(data)
    for r in got:
        b = (r.text or "").encode()
        assert r.size == len(b) + 16
        assert r.text_crc32 == (None if r.text is None else zlib.crc32(b))
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.get(s, 0) for s in range(shards)) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))


def test_odd_rows(spark):
    data = [(i, f"text {i % 7}" if i % 5 else None, "x") for i in range(900)]
    data += [(None, "no id", None)] * 5 + [(3, "same", "y")] * 400 + [(4, "", "z"), (5, "é" * 200_000, "long")]
    df = rows(spark, data)
    one = sharding.write_shards(df, new_path(spark, "shards"), shards=7).collect()
    check(one, data, 7)
    two = sharding.write_shards(df.repartition(5), new_path(spark, "shards"), shards=7).collect()
    place = lambda got: sorted((r.shard, r.slot, r.doc_id, r.text) for r in got if r.doc_id is not None)
    assert place(one) == place(two)
    other = sharding.write_shards(df, new_path(spark, "shards"), shards=7, seed=5).collect()
    assert place(one) != place(other)


def test_long_and_many_buckets(spark, monkeypatch):
    """Buckets longer than a stretch, several buckets to a part, and clashing names."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 8)
    monkeypatch.setattr(sharding, "LONGEST", 16)
    data = [(i, f"text {i}", "x") for i in range(500)] + [(7, "same", "y")] * 200
    df = rows(spark, data).withColumn("shard", F.lit(1)).withColumn("shard_", F.lit(2))
    got = sharding.write_shards(df, new_path(spark, "shards"), shards=3).collect()
    check(got, data, 3)
    assert {(r.shard__, r.shard_) for r in got} == {(1, 2)}
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.text != "same"]
    steps = [b - a for a, b in zip(order, order[1:])]
    assert order != sorted(order) and -40 < sum(steps) / len(steps) < 40 and len(set(steps)) > 200


def test_few_and_no_rows(spark):
    data = [(1, "a", None), (2, "b", None)]
    got = sharding.write_shards(rows(spark, data), new_path(spark, "shards")).collect()
    check(got, data, 40)
    assert sharding.write_shards(rows(spark, data).limit(0), new_path(spark, "shards")).count() == 0


def test_permutations_are_fair(spark):
    df = spark.range(3000).select(sharding.permutation(F.lit(3), F.col("id")).alias("p"))
    seen = Counter(tuple(r.p) for r in df.collect())
    assert len(seen) == 6 and min(seen.values()) > 400
    big = spark.range(1).select(sharding.permutation(F.lit(256), F.col("id")).alias("p")).head().p
    assert sorted(big) == list(range(256)) and big != sorted(big)


def test_plan_has_no_python(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["op10_external_shuffle"](spark, "/root/testdata/sf0.001")
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
