import base64
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textguard.functions import sealing as S
from textguard.operators import protection as PR
from textguard.operators import rehydration as RH
from textguard.operators.texts import with_analysis
from textguard.sources import mappings
from textguard.sources.storage import new_path, write_once

KEY = "a1yaytmjjPfsvlbMzg3aCw//dujMSzodVeXBJ5hrsyk="
OTHER = "w4CzE0y9r1yRrqx7nrxc2w5GJxK8nMk0r9H3P7nRnME="
START = datetime(2024, 1, 1)


def at(minutes: float = 0):
    return F.lit(START + timedelta(minutes=minutes)).cast("timestamp")


@pytest.mark.parametrize("key", ["", "   ", None, "!!!not-base64!!!", "a1yaytmjjPfsvlbMzg3aCw=",
                                 base64.b64encode(b"x" * 33).decode()])
def test_bad_keys(key):
    with pytest.raises(S.KeyConfigError) as problem:
        S.check_key(key)
    assert not key or not key.strip() or key not in str(problem.value)


def test_good_key():
    assert len(S.check_key(f" {KEY}\n")) == 32


def test_round_trip_and_fresh_nonces(spark):
    df = spark.range(300).select(F.concat(F.lit("ग्राहक"), F.col("id") % 3).alias("v"))
    sealed = write_once(df.select("v", S.seal(F.col("v"), KEY).alias("s")), "sealed")
    rows = sealed.select("v", "s", S.open_sealed(F.col("s"), KEY).alias("o"),
                         S.try_open(F.col("s"), OTHER).alias("w")).collect()
    assert all(r.v == r.o and r.w is None for r in rows)
    assert len({bytes(r.s[:12]) for r in rows}) == 300
    assert all(len(r.s) == 28 + len(r.v.encode()) for r in rows)


def test_empty_text_and_null(spark):
    df = spark.createDataFrame([("",)], "v string")
    sealed = df.select(S.seal(F.col("v"), KEY).alias("s"))
    assert sealed.select(S.open_sealed(F.col("s"), KEY)).first()[0] == ""
    with pytest.raises(Exception, match="null value"):
        spark.createDataFrame([(None,)], "v string").select(S.seal(F.col("v"), KEY)).collect()


def test_tampering(spark):
    sealed = bytearray(
        spark.createDataFrame([("secret",)], "v string").select(S.seal(F.col("v"), KEY)).first()[0])
    for place in (0, 14, len(sealed) - 1):
        broken = bytearray(sealed)
        broken[place] ^= 1
        df = spark.createDataFrame([(bytes(broken),)], "s binary")
        assert df.select(S.try_open(F.col("s"), KEY)).first()[0] is None
        with pytest.raises(Exception):
            df.select(S.open_sealed(F.col("s"), KEY)).collect()
    short = spark.createDataFrame([(b"x",), (b"",)], "s binary")
    assert [r[0] for r in short.select(S.try_open(F.col("s"), KEY)).collect()] == [None, None]


def test_base64_pair(spark):
    df = spark.createDataFrame([("x" * 300,)], "v string")
    sealed = write_once(df.select(S.seal(F.col("v"), KEY).alias("s")), "sealed")
    pair = sealed.select(S.to_base64_pair(F.col("s")).alias("p"), "s").first()
    assert base64.b64decode(pair.p.iv_base64) + base64.b64decode(pair.p.ciphertext_base64) == pair.s
    assert "\n" not in pair.p.ciphertext_base64 and "\r" not in pair.p.ciphertext_base64
    back = spark.createDataFrame(
        [(pair.p.ciphertext_base64, pair.p.iv_base64), ("!!", pair.p.iv_base64),
         (pair.p.ciphertext_base64, "AAAA")], "c string, i string"
    ).select(S.from_base64_pair(F.col("c"), F.col("i")).alias("s")).collect()
    assert [r.s for r in back] == [pair.s, None, None]


def _texts(spark, *rows):
    return with_analysis(spark.createDataFrame(list(rows), "request_id string, text string"))


def test_key_is_only_needed_with_mappings(spark):
    assert PR.protect(_texts(spark, ("1", "nothing")), None).count() == 0
    with pytest.raises(Exception, match="encryption key"):
        PR.protect(_texts(spark, ("1", "a@b.org")), None).collect()


def test_key_stays_out_of_plans(spark, capsys):
    sets = PR.protect(_texts(spark, ("1", "a@b.org")), KEY)
    sets.explain(True)
    shown = capsys.readouterr().out
    assert S.check_key(KEY).hex().upper() not in shown.upper() and KEY not in shown


def _sets(spark, *rows):
    """(request, text, minute stored, ttl in minutes) sealed and written together."""
    out = None
    for request, text, minute, ttl in rows:
        one = PR.protect(_texts(spark, (request, text)), KEY, at(minute), timedelta(minutes=ttl))
        out = one if out is None else out.unionByName(one)
    return write_once(out, "sets")


def test_expiry_defaults(spark):
    df = spark.createDataFrame([(START,)], "stored_at timestamp")
    for ttl in (None, timedelta(0), timedelta(minutes=-1)):
        assert PR.with_expiry(df, ttl).first().expires_at == START + timedelta(minutes=10)
    got = PR.with_expiry(df, timedelta(seconds=90, milliseconds=5)).first().expires_at
    assert got == START + timedelta(seconds=90, milliseconds=5)


def test_live_and_replaced_sets(spark):
    sets = _sets(spark, ("a", "a@b.org", 0, 10), ("b", "b@b.org", 0, 60), ("b", "c@b.org", 5, 3))
    assert {r.request_id for r in PR.live_sets(sets, at(9.99)).collect()} == {"a"}
    # exactly at expiry it is gone; the replaced longer-lived set of b does not return
    assert PR.live_sets(sets, at(10)).count() == 0
    assert PR.live_request_count(sets, at(6)).first().live_requests == 2


def test_one_ttl_gives_the_same(spark):
    sets = _sets(spark, ("a", "a@b.org", 0, 10), ("a", "b@b.org", 5, 10), ("c", "c@b.org", 1, 10))
    for minute in (1, 9, 10.5, 11, 14, 15):
        plain = {(r.request_id, r.stored_at) for r in PR.live_sets(sets, at(minute)).collect()}
        pruned = {(r.request_id, r.stored_at) for r in PR.live_sets(sets, at(minute), True).collect()}
        assert plain == pruned


def test_table_and_purge(spark):
    path, target = new_path(spark, "m"), new_path(spark, "m-live")
    mappings.write_mappings(_sets(spark, ("a", "a@b.org", 0, 10), ("b", "b@b.org", 0, 3000)), path)
    assert mappings.read_mappings(spark, path).count() == 2
    kept = mappings.purge_expired(spark, path, target, at(20))
    assert [r.request_id for r in kept.collect()] == ["b"]


def test_purge_does_not_bring_replaced_sets_back(spark):
    path, target = new_path(spark, "m"), new_path(spark, "m-live")
    mappings.write_mappings(_sets(spark, ("b", "b@b.org", 0, 3000), ("b", "c@b.org", 5, 3)), path)
    kept = mappings.purge_expired(spark, path, target, at(20))
    assert PR.live_sets(kept, at(20)).count() == 0


ODD_TOKENS = "{{EMAIL_999}} {{ALIEN_001}} {{EMAIL_}} {{EMAIL_01}} {EMAIL_001} {{email_001}}"
REPLIES = "request_id string, provider string, response_text string"


def _restore(spark, sets, replies, key=KEY, minute=1.0):
    df = spark.createDataFrame([(r, "mock", t) for r, t in replies], REPLIES)
    return RH.rehydrate(df, sets, key, at(minute))


def test_rehydrate(spark):
    sets = _sets(spark, ("a", "john@example.com 123-45-6789", 0, 10), ("b", "jane@example.com", 0, 10))
    cases = [
        ("a", "Hi {{EMAIL_001}}.", "Hi john@example.com.", 1),
        ("a", "{{EMAIL_001}} {{SSN_002}} {{EMAIL_001}}", "john@example.com 123-45-6789 john@example.com", 2),
        ("b", "Hi {{EMAIL_001}}.", "Hi jane@example.com.", 1),
        ("c", "Hi {{EMAIL_001}}.", "Hi {{EMAIL_001}}.", 0),
        ("a", ODD_TOKENS, ODD_TOKENS, 0),
        ("a", "{{EMAIL_0010}} {{EMAIL_001}}", "{{EMAIL_0010}} john@example.com", 1),
        ("a", "no token", "no token", 0),
        ("a", "", "", 0),
    ]
    got = _restore(spark, sets, [(r, t) for r, t, _, _ in cases]).collect()
    assert sorted((r.request_id, r.response, r.token_count) for r in got) == sorted(
        (r, wanted, n) for r, _, wanted, n in cases)
    assert all(r.failure_kind is None for r in got)


def test_rehydrate_expired(spark):
    sets = _sets(spark, ("a", "john@example.com", 0, 10))
    got = _restore(spark, sets, [("a", "Hi {{EMAIL_001}}")], minute=10).first()
    assert (got.response, got.failure_kind) == ("Hi {{EMAIL_001}}", None)


def test_rehydrate_fails_whole_reply(spark):
    sets = _sets(spark, ("a", "john@example.com 123-45-6789", 0, 10), ("b", "b@x.org", 0, 10))
    broken = write_once(sets.withColumn(
        "mappings", F.transform("mappings", lambda m: F.when(
            m["token"] == "{{SSN_002}}",
            m.withField("sealed", F.overlay(m["sealed"], F.lit(b"x"), F.lit(20)))).otherwise(m))), "broken")
    restored = _restore(spark, broken, [("a", "{{EMAIL_001}} {{SSN_002}}"), ("a", "{{EMAIL_001}}"),
                                        ("b", "{{EMAIL_001}}"), ("b", None)]).collect()
    got = sorted((r.request_id, str(r.response), str(r.failure_kind)) for r in restored)
    assert got == [("a", "None", "protection"), ("a", "john@example.com", "None"),
                   ("b", "None", "bad_input"), ("b", "b@x.org", "None")]
    wrong = _restore(spark, sets, [("a", "{{EMAIL_001}}"), ("a", "plain")], key=OTHER)
    failed = RH.failed_replies(wrong, at()).collect()
    assert [(r.request_id, r.status, r.message) for r in failed] == [
        ("a", 500, "Failed to process request securely.")]
    assert [r.response for r in RH.restored_replies(wrong).collect()] == ["plain"]


def test_lookup_and_unresolved(spark):
    sets = _sets(spark, ("a", "john@example.com", 0, 10))
    tokens = spark.createDataFrame([("a", "{{EMAIL_001}}"), ("a", "{{EMAIL_002}}"), ("b", "{{EMAIL_001}}")],
                                   "request_id string, token string")
    found = PR.lookup_mappings(tokens, sets, at(1))
    assert {(r.request_id, r.token) for r in found.filter("sealed is not null").collect()} == {
        ("a", "{{EMAIL_001}}")}
    missing = {(r.request_id, r.token) for r in PR.unresolved_tokens(tokens, sets, at(1)).collect()}
    assert missing == {("a", "{{EMAIL_002}}"), ("b", "{{EMAIL_001}}")}
    assert PR.unresolved_tokens(tokens, sets, at(11)).count() == 3


def test_key_problems_are_those_of_the_check(column):
    keys = [KEY, f" {KEY}\n", KEY.rstrip("="), "", "  ", None, "*" + KEY, base64.b64encode(b"x" * 31).decode(), base64.b64encode(b"x" * 33).decode(), "a=b", "====", "no key"]
    words = {"No": "missing", "is not valid": "not Base64", "exactly 32": "not 32 bytes"}
    wanted = []
    for key in keys:
        try:
            S.check_key(key)
            wanted.append(None)
        except S.KeyConfigError as error:
            wanted.append(next(w for part, w in words.items() if part in str(error)))
    assert column(S.key_problem, keys) == wanted
