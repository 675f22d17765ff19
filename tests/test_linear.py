"""Work per text stays near linear, and the quick forms equal the plain ones."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textguard.functions import detection as D
from textguard.functions import masking as M
from textguard.functions import patterns as P
from textguard.functions import replies as R
from textguard.functions import sealing as S
from textguard.functions import validation as V
from textguard.plans.analyze import analyze_stored
from textguard.sources.providers import mock_replies
from textguard.sources.storage import new_path
from textguard.sources.texts import read_json_requests


def test_email_runs_equal_the_plain_pattern(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "_", ".", "%", "+", "-", "@", "@x.yz", "@q.io.", " ", "é", "1", "zz", ".d@e.ff", "@@", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 18))) for _ in range(6000)]
    plain = lambda t: D._spans(t, "EMAIL", P.EMAIL)
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    rows = df.select("t", D.detect_email(F.col("t")).alias("quick"), plain(F.col("t")).alias("plain")).collect()
    assert sum(bool(r.plain) for r in rows) > 1000
    for r in rows:
        if "@" in r.t:
            assert r.quick == r.plain, r.t


def test_long_runs_and_many_values(spark):
    dotted = "a." * 500_000 + " x@y.zz"
    many = " ".join(f"user{i}@example.com" for i in range(100_000))
    df = spark.createDataFrame([(dotted,), (many,)], "t string").repartition(2)
    started = time.time()
    got = df.select(F.size(D.detect_email(F.col("t"))).alias("n")).collect()
    assert sorted(r.n for r in got) == [1, 100_000] and time.time() - started < 120
    spans = F.transform(
        F.sequence(F.lit(0), F.lit(99_999)),
        lambda i: F.struct(F.lit("EMAIL").alias("type"), F.concat((i % 60_000).cast("string"), F.lit("@x.yz")).alias("value"),
                           (i * 2).alias("start"), (i * 2 + 1).alias("end")),
    )
    started = time.time()
    one = spark.range(1).select(F.explode(F.array(spans)).alias("s")).select(F.explode(F.array(M.assign_tokens(F.col("s")))).alias("t"))
    row = one.select(F.element_at("t", -1)["token"].alias("last"), F.size(M.token_mappings(F.col("t"))).alias("n")).head()
    assert row.n == 60_000 and row["last"] == "{{EMAIL_40000}}" and time.time() - started < 120


def test_numbers_by_first_occurrence(column):
    def spans(text):
        pieces = F.split(text, " ")
        return F.transform(pieces, lambda v, i: F.struct(F.lit("EMAIL").alias("type"), v.alias("value"), i.alias("start"), (i + 1).alias("end")))

    got = column(lambda t: F.transform(M.assign_tokens(spans(t)), lambda x: x["token"]), ["b a B c a", "x"])
    number = lambda *n: [f"{{{{EMAIL_{i:03d}}}}}" for i in n]
    assert got == [number(1, 2, 1, 3, 2), number(1)]


@pytest.mark.parametrize("body,wanted", [
    ('{"output":["str",{"type":"message","content":[{"type":"output_text","text":"hi"}]}]}', "hi"),
    ('{"output":[{"type":"message","content":[5,{"type":"output_text","text":"hi"}]}],"output_text":"fb"}', "hi"),
    ('{"output":[{"type":"message","content":[{"type":"output_text","text":{"k":1}},{"type":"output_text","text":"hi"}]}]}', "hi"),
    ('{"output":[{"type":"message","content":[{"type":"output_text","text":null}]}],"output_text":"fb"}', "fb"),
    ('{"output":7,"output_text":"fb"}', "fb"), ("[]", None), ("nope", None), (None, None),
])
def test_replies_are_parsed_element_by_element(column, body, wanted):
    assert column(R.extract_openai_text, [body]) == [wanted]


def test_blocks_are_parsed_element_by_element(column):
    bodies = ['{"content":[{"type":"text","text":"hi"},"str"]}', '{"content":{"type":"text","text":"hi"}}', '{"content":[null,{"type":"text","text":" "}]}']
    assert column(R.extract_anthropic_text, bodies) == ["hi", None, None]


def test_messages_are_cut_at_utf16_units(column):
    texts = ["x" * 300, "x" * 301, "😀" * 150, "😀" * 151, "x" + "😀" * 200]
    assert column(V.sanitize_message, texts) == ["x" * 300, "x" * 300, "😀" * 150, "😀" * 150, "x" + "😀" * 149]


def test_every_request_is_answered_and_nothing_lies_in_the_clear(spark):
    key = "a1yaytmjjPfsvlbMzg3aCw//dujMSzodVeXBJ5hrsyk="
    rows = [(str(i), f"mail secret{i}@example.com now", "mock") for i in range(20)] + [("long", "word " * 30_000, "mock"), ("bad", "x", "who")]
    df = spark.createDataFrame(rows, "request_id string, text string, provider string")
    some = lambda sent: mock_replies(sent.filter("request_id not in ('3', '4')"))
    done = analyze_stored(df, key, new_path(spark, "mappings"), some)
    answered = {r.request_id: r.response for r in done.results.collect()}
    failed = {r.request_id: r.status for r in done.rejects.collect()}
    assert failed == {"3": 502, "4": 502, "bad": 400} and set(answered) == {r[0] for r in rows} - set(failed)
    assert answered["7"] == "mail secret7@example.com now" + P.MOCK_SUFFIX
    staged = spark.read.parquet(done.staged)
    assert not [r for r in staged.collect() if "secret" in str(r)]
    done.discard()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(done.staged)


def test_repeated_ids_are_refused(spark):
    df = spark.createDataFrame([("1", "a", "mock"), ("1", "b", "mock")], "request_id string, text string, provider string")
    with pytest.raises(ValueError, match="unique"):
        analyze_stored(df, None, new_path(spark, "mappings"))


def test_equal_lines_get_ids_of_their_own(spark):
    path = new_path(spark, "lines")
    spark.createDataFrame([('{"text":"a","provider":"mock"}',)] * 6, "value string").repartition(2).write.text(path)
    good, bad = read_json_requests(spark, path)
    assert len({r.request_id for r in good.collect()}) == 6 and bad.count() == 0


def test_redaction_of_the_user_stays(spark):
    known = spark.conf.get(S.REDACTION, None)
    try:
        spark.conf.set(S.REDACTION, "topsecret")
        S.hide_keys(spark)
        S.hide_keys(spark)
        pattern = spark.conf.get(S.REDACTION)
        assert pattern == f"(?:topsecret)|{S.HEX_KEY}"
        assert re.search(pattern, "a topsecret b") and re.search(pattern, "X'" + "ab" * 32 + "'")
    finally:
        spark.conf.set(S.REDACTION, known) if known else spark.conf.unset(S.REDACTION)


def test_only_days_that_matter_are_read(spark):
    from datetime import timedelta

    from tests.session import at
    from textguard.operators import protection as PR
    from textguard.sources import mappings

    path = new_path(spark, "mappings")
    texts = spark.range(50).select(F.col("id").cast("string").alias("request_id"), F.concat(F.lit("m"), "id", F.lit("@x.yz")).alias("text"))
    from textguard.operators.texts import with_analysis

    key = "a1yaytmjjPfsvlbMzg3aCw//dujMSzodVeXBJ5hrsyk="
    for days in (0, 3):
        mappings.write_mappings(PR.protect(with_analysis(texts), key, F.timestamp_add("DAY", F.lit(days), at())), path)
    sets = mappings.read_mappings(spark, path)
    now = F.timestamp_add("MINUTE", F.lit(3 * 24 * 60 + 5), at())
    pruned = PR.live_sets(sets, now, max_ttl=timedelta(minutes=10))
    assert pruned.count() == PR.live_sets(sets, now).count() == 50
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(expires_on" in plan
    count = PR.live_request_count(sets, now, max_ttl=timedelta(minutes=10))
    assert count.head()[0] == 50 and "mappings" not in count._jdf.queryExecution().executedPlan().toString().split("FileScan")[-1].split("ReadSchema")[-1]
