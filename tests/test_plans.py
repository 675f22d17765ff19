"""Shapes of physical plans: no shuffle where none is needed, columns pruned, scans once."""

import re
import pytest
from pyspark.sql import functions as F

from textguard.operators import protection as PR
from textguard.operators import rehydration as RH
from textguard.operators.texts import detections_table, masked_table, with_analysis
from textguard.plans.analyze import analyze, analyze_stored
from textguard.sources.storage import new_path, write_once
from tests.session import at

KEY = "a1yaytmjjPfsvlbMzg3aCw//dujMSzodVeXBJ5hrsyk="
DOCS = "/root/testdata/sf0.001/documents.parquet"


def _plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture
def docs(spark):
    return spark.read.parquet(DOCS).select(
        F.col("doc_id").cast("string").alias("request_id"), "text", F.lit("mock").alias("provider"))


def test_masking_is_narrow_and_scans_once(docs, capsys):
    for df in (masked_table(with_analysis(docs)), detections_table(docs), analyze(docs, at=at()).results):
        plan = _plan(df, capsys)
        assert "Exchange" not in plan
        # one extraction per type: the pattern chain is not duplicated
        assert len(re.findall(r"regexp_extract_all\([^,]*, https\?", plan)) == 1


def test_only_needed_columns_are_read(docs, capsys):
    plan = _plan(masked_table(with_analysis(docs)).filter("detection_count > 0"), capsys)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_size_filter_sits_below_the_scan_of_patterns(docs, capsys):
    plan = _plan(analyze(docs, at=at()).results, capsys)
    assert plan.index("Filter") > plan.index("Generate") - 10_000  # both present
    tree = plan.split("(1)")[0]
    assert tree.index("Generate") < tree.index("Filter")


def test_newest_sets_cut_groups_before_the_shuffle(spark, capsys):
    sets = spark.createDataFrame([], PR.SET_SCHEMA)
    path = new_path(spark, "sets")
    sets.write.parquet(path)
    plan = _plan(PR.newest_sets(spark.read.parquet(path)), capsys)
    assert plan.split("(1)")[0].count("WindowGroupLimit") == 2


def test_rehydrate_shuffles_on_request_only(spark, capsys):
    replies = write_once(spark.createDataFrame([("a", "mock", "x")], "request_id string, provider string, response_text string"), "r")
    sets = write_once(spark.createDataFrame([], PR.SET_SCHEMA), "s")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(RH.rehydrate(replies, sets, KEY, at()), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert len(shuffles) == 2 and all(s.startswith("request_id") for s in shuffles)


def test_both_ways_agree(spark, docs):
    notes = docs.select("request_id", F.concat(F.lit("a@b.org "), "text").alias("text"), "provider")
    assert analyze(notes).results.count() == notes.count()  # texts of any length
    direct = analyze(notes, at=at(), max_length=10_000)
    path = new_path(spark, "m")
    stored = analyze_stored(
        notes, KEY, path, now=at(), stored_at=at(), at=at(), max_length=10_000
    )
    assert direct.results.exceptAll(stored.results).count() == 0
    assert stored.results.exceptAll(direct.results).count() == 0
    assert direct.rejects.count() == stored.rejects.count() > 0


def test_stored_way_rejects_what_it_cannot_restore(spark, docs):
    def odd(sent):
        return sent.select("request_id", F.when(F.col("request_id") != "1", F.col("masked_text")).alias("response_text"))

    small = docs.filter(F.length("text") < 10_000)
    done = analyze_stored(small, KEY, new_path(spark, "m"), reply_fn=odd, now=at(), stored_at=at(), at=at())
    assert done.results.filter("request_id = '1'").count() == 0
    assert [(r.request_id, r.status) for r in done.rejects.collect()] == [("1", 400)]


def test_hot_request_is_split(spark, capsys):
    """A request with a third of all replies is read by many tasks of the join."""
    ids = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), "id"))
    text = F.concat(F.lit("{{EMAIL_001}} "), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4))
    replies = write_once(spark.range(60_000).select(
        ids.alias("request_id"), F.lit("mock").alias("provider"), text.alias("response_text")), "r")
    texts = spark.createDataFrame([("hot", "hot@x.org")], "request_id string, text string")
    sets = PR.protect(with_analysis(texts), KEY, at())
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        restored = RH.rehydrate(replies, sets, KEY, at()).groupBy("token_count").count()
        got = {r["token_count"]: r["count"] for r in restored.collect()}
        restored.explain()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {1: 20_000, 0: 40_000}
    assert "skew=true" in capsys.readouterr().out
