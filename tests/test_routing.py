import pytest
from pyspark.sql import functions as F

from textguard.functions import replies as R
from textguard.functions import validation as V
from textguard.operators import reports, routing
from textguard.sources import providers, texts
from textguard.sources.storage import new_path
from tests.session import at



def test_non_blank(column):
    cases = {None: False, "": False, "  \t\n\x00": False, "a": True, " ": True, " x ": True}
    assert column(V.require_non_blank, list(cases)) == list(cases.values())


def test_size_counts_utf16_units(column):
    texts_ = ["x" * 99, "x" * 100, "x" * 101, "\U0001F600" * 50, "\U0001F600" * 51,
              "x" + "\U0001F600" * 50, "é" * 100, None, ""]
    got = column(lambda t: V.within_size(t, 100), texts_)
    assert got == [True, True, False, True, False, False, True, True, True]


def test_provider(column):
    cases = {"mock": "mock", " OpenAI\t": "openai", "ANTHROPIC": "anthropic", "other": None,
             "": None, None: None, "mo ck": None}
    assert column(V.resolve_provider, list(cases)) == list(cases.values())


def test_messages(column):
    cases = {None: "Request failed.", " \n ": "Request failed.", " ": " ",
             "x" * 301: "x" * 300, "ok": "ok"}
    assert column(V.sanitize_message, list(cases)) == list(cases.values())


def test_client_key(column):
    assert column(V.client_key, ["abc"]) == [
        "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]


def test_outcomes(column):
    cases = {"200": "success", "204": "success", "400": "bad-request", "401": "unauthorized",
             "413": "too-large", "429": "rate-limited", "502": "provider-error",
             "504": "provider-error", "500": "unknown", "302": "unknown", "403": "unknown"}
    got = column(lambda c: V.reply_outcome(c.cast("int")), list(cases))
    assert got == list(cases.values())


def test_errors(column):
    cases = {"bad_input": 400, "too_large": 413, "unsupported_provider": 400, "throttled": 429,
             "provider_failure": 502, "provider_timeout": 504, "key_config": 500,
             "protection": 500, "other": 500, "what": 500, None: 500}
    got = column(V.classify_error, list(cases))
    assert [r.status for r in got] == list(cases.values())


def test_routing_precedence(spark):
    rows = [("ok", "hi", " Mock "), ("blank", " ", "mock"), ("none", None, "mock"),
            ("noprov", "hi", " "), ("big", "x" * 11, "what"), ("prov", "hi", "what"),
            ("edge", "x" * 10, "mock")]
    df = spark.createDataFrame(rows, "request_id string, text string, provider string")
    accepted, rejected = routing.route_requests(df, max_length=10, at=at())
    assert {(r.request_id, r.provider) for r in accepted.collect()} == {("ok", "mock"), ("edge", "mock")}
    got = {r.request_id: (r.status, r.message) for r in rejected.collect()}
    assert got == {
        "blank": (400, "Invalid request."), "none": (400, "Invalid request."),
        "noprov": (400, "Invalid request."),
        "big": (413, "Request text exceeds the maximum allowed length of 10 characters."),
        "prov": (400, "Unsupported provider: what")}
    assert rejected.columns == ["request_id", "status", "error", "message", "at"]
    counts = {r.status: r.rejects for r in reports.reject_summary(rejected).collect()}
    assert counts == {400: 4, 413: 1}


OPENAI = {
    '{"output_text":"plain reply"}': "plain reply",
    '{"output":[{"type":"message","content":[{"type":"output_text","text":"a "},'
    '{"type":"refusal","text":"no"},{"type":"output_text","text":"b"}]},'
    '{"type":"reasoning"},{"type":"message","content":[{"type":"output_text","text":"c"}]}]}': "a bc",
    '{"output":[{"type":"message","content":[{"type":"output_text","text":"  "}]}],'
    '"output_text":"top"}': "top",
    '{"output":[],"output_text":"  "}': None,
    "{}": None,
    '{"output":[{"type":"reasoning"}]}': None,
    '{"output":[{"type":"message"}]}': None,
    '{"output":[{"type":"message","content":[{"type":"output_text"}]}]}': None,
    '{"output":"text","output_text":"top"}': "top",
    "not json at all{{{": None,
    "": None,
    "[]": None,
    None: None,
}
ANTHROPIC = {
    '{"content":[{"type":"text","text":"one "},{"type":"text","text":"two"}]}': "one two",
    '{"content":[{"type":"tool_use"},{"type":"text","text":"x"}]}': "x",
    "{}": None, '{"content":[]}': None, '{"content":[{"type":"tool_use"}]}': None,
    '{"content":[{"type":"text","text":"   "}]}': None, "not json at all{{{": None, "": None,
    None: None,
}


def test_openai_replies(column):
    assert column(R.extract_openai_text, list(OPENAI)) == list(OPENAI.values())


def test_anthropic_replies(column):
    assert column(R.extract_anthropic_text, list(ANTHROPIC)) == list(ANTHROPIC.values())


def test_parse_replies_rejects(spark):
    df = spark.createDataFrame(
        [("1", "openai", '{"output_text":"x"}'), ("2", "anthropic", "{}"), ("3", "other", "{}")],
        "request_id string, provider string, body string")
    good, bad = providers.parse_replies(df, at())
    assert [(r.request_id, r.response_text) for r in good.collect()] == [("1", "x")]
    assert {(r.request_id, r.status) for r in bad.collect()} == {("2", 502), ("3", 502)}


def test_export(spark):
    sent = spark.createDataFrame(
        [("1", "openai", 'say "{{EMAIL_001}}"'), ("2", "anthropic", "x"), ("3", "mock", "y")],
        "request_id string, provider string, masked_text string")
    bodies = {}
    for name in ("openai", "anthropic"):
        path = new_path(spark, name)
        providers.export_provider_requests(sent, name, path)
        bodies[name] = [r.value for r in spark.read.text(path).collect()]
    assert bodies["openai"] == ['{"model":"gpt-4o-mini","input":"say \\"{{EMAIL_001}}\\""}']
    assert bodies["anthropic"] == [
        '{"model":"claude-sonnet-4-20250514","max_tokens":4096,'
        '"messages":[{"role":"user","content":"x"}]}']


@pytest.mark.parametrize("expose", [False, True])
def test_json_and_results(spark, expose):
    path = new_path(spark, "in")
    lines = ['{"request_id":"1","text":"mail a@b.org","provider":"mock"}', '{"text":"cut', "[1]",
             '{"text":"no id","provider":"mock"}', "", '{"request_id":"2","text":null,"provider":"mock"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    requests, bad = texts.read_json_requests(spark, path, at())
    assert requests.count() == 3
    assert [r.status for r in bad.collect()] == [400, 400]
    from textguard.plans.analyze import analyze

    done = analyze(requests, at=at())
    out = new_path(spark, "out")
    texts.write_results(done.results, out, expose_raw=expose)
    row = spark.read.parquet(out).filter("request_id = '1'").first().asDict(recursive=True)
    assert row["response"] == "mail a@b.org Mock analysis completed."
    assert row["processed_text"] == "mail {{EMAIL_001}}"
    assert ("original_text" in row) == expose
    assert ("value" in row["detections"][0]) == expose
    assert [r.status for r in done.rejects.collect()] == [400]


def test_read_texts(spark):
    got = texts.read_texts(spark, "/root/testdata/sf0.001/documents.parquet", "doc_id", "text", F.lit("mock"))
    assert got.columns == ["request_id", "text", "provider"] and got.count() == 200
