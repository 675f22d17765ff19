import random
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textguard.functions import detection as D
from textguard.functions import masking as M
from textguard.operators import rehydration, texts
from textguard.sources.storage import write_once

GOLDEN = {
    "Customer email is john@example.com, phone is +91 9876543210, SSN is 123-45-6789.":
        ("Customer email is {{EMAIL_001}}, phone is {{PHONE_002}}, SSN is {{SSN_003}}.", 3),
    "Email john@example.com. Confirm john@example.com.":
        ("Email {{EMAIL_001}}. Confirm {{EMAIL_001}}.", 1),
    "Email John@Example.com. Confirm john@example.com.":
        ("Email {{EMAIL_001}}. Confirm {{EMAIL_001}}.", 1),
    "Card 4111 1111 1111 1111 call 9876543210 end.":
        ("Card {{CREDIT_CARD_001}} call {{PHONE_002}} end.", 2),
    "Email john@example.com\nPhone   9876543210":
        ("Email {{EMAIL_001}}\nPhone   {{PHONE_002}}", 2),
    "https://a.org/X and https://a.org/x": ("{{URL_001}} and {{URL_002}}", 2),
    "nothing here": ("nothing here", 0),
    "": ("", 0),
    "\U0001F600a@b.org\U0001F600": ("\U0001F600{{EMAIL_001}}\U0001F600", 1),
    None: ("", 0),
}


def test_golden_masks(column):
    got = column(M.analyze_text, list(GOLDEN))
    for (text, (masked, count)), r in zip(GOLDEN.items(), got):
        assert (r.masked_text, len(r.mappings)) == (masked, count), text


def test_mapping_keeps_the_value_seen_first(column):
    (r,) = column(M.analyze_text, ["Jo@X.org, jo@x.org, JO@X.ORG"])
    (m,) = r.mappings
    assert (m.token, m.type, m.original_value, m.start, m.end) == (
        "{{EMAIL_001}}", "EMAIL", "Jo@X.org", 0, 8)


def test_sequence_beyond_three_digits(column):
    text = " ".join(f"u{i}@x.org" for i in range(1, 1003))
    (r,) = column(M.analyze_text, [text])
    assert [m.token for m in r.mappings][998:1001] == [
        "{{EMAIL_999}}", "{{EMAIL_1000}}", "{{EMAIL_1001}}"]
    assert r.masked_text.endswith("{{EMAIL_1001}} {{EMAIL_1002}}")


def _mask(spark, text, spans):
    df = spark.createDataFrame([(text, spans)], f"t string, s {D.SPANS}")
    return df.select(M.mask_text(F.col("t"), F.col("s"))).first()[0]


def test_mask_skips_unusable_spans(spark):
    text = "abcdefghij"
    assert _mask(spark, text, [("PHONE", "cd", 2, 4), ("SSN", "de", 3, 5)]) == "ab{{PHONE_001}}efghij"
    assert _mask(spark, text, [("PHONE", "ij", 8, 20)]) == text
    assert _mask(spark, text, [("PHONE", None, 0, 2), (None, "a", 0, 1), ("SSN", "b", -1, 2)]) == text
    assert _mask(spark, text, [("SSN", "j", 9, 10), ("PHONE", "a", 0, 1)]) == "{{PHONE_001}}bcdefghi{{SSN_002}}"
    assert _mask(spark, text, None) == text
    assert _mask(spark, None, [("SSN", "j", 9, 10)]) == ""


def test_find_tokens(column):
    cases = {
        "{{EMAIL_001}} {{EMAIL_0010}} {{EMAIL_001}}": ["{{EMAIL_001}}", "{{EMAIL_0010}}"],
        "{{ALIEN_001}} {{EMAIL_}} {{EMAIL_01}} {EMAIL_001} {{email_001}}": [],
        "{{{IP_ADDRESS_007}}}": ["{{IP_ADDRESS_007}}"],
        "none": [],
        None: None,
    }
    assert column(M.find_tokens, list(cases)) == list(cases.values())


def test_splice_tokens_is_literal_and_single_pass(spark):
    df = spark.createDataFrame(
        [("{{EMAIL_001}}/{{SSN_002}}/{{EMAIL_001}}{{URL_003}}",
          {"{{EMAIL_001}}": r"a$1\b@x.org", "{{SSN_002}}": "{{URL_003}}"})],
        "t string, m map<string,string>")
    got = df.select(M.splice_tokens(F.col("t"), F.col("m"))).first()[0]
    assert got == r"a$1\b@x.org/{{URL_003}}/a$1\b@x.org{{URL_003}}"


def test_segments(column):
    (got,) = column(M.segment_masked, ["{{EMAIL_001}} and {{X_Y_1}}!"])
    assert [(s.pos, s.is_token, s.piece) for s in got] == [
        (0, False, ""), (1, True, "{{EMAIL_001}}"), (2, False, " and "), (3, True, "{{X_Y_1}}"),
        (4, False, "!")]


def test_leak_check(spark):
    df = spark.createDataFrame(
        [("a", "say a@b.org", [("{{EMAIL_001}}", "EMAIL", "a@b.org", 4, 11)]),
         ("b", "say {{EMAIL_001}}", [("{{EMAIL_001}}", "EMAIL", "a@b.org", 4, 11)])],
        f"request_id string, masked_text string, mappings {M.MAPPINGS}")
    got = {(r.request_id, r.type, r.reason) for r in texts.leak_check(df).collect()}
    assert got == {("a", "EMAIL", "original_value"), ("a", "EMAIL", "detected")}


def test_leak_check_in_one_pass(spark):
    """Many values in a long text: as the plain form, and fast."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdé1-@ ", k=rng.randint(1, 14)))
    rows = []
    for i in range(60):
        values = [*[word() for _ in range(30)], "", None, "x\U0001F600y", "aa", "aaa"]
        text = None if i == 7 else "" if i == 8 else "".join(rng.choices(["aa", "a", "x\U0001F600y", "b", "c1", "é-", "@", " "], k=60))
        rows.append((str(i), text, [("t", f"T{n}", v, 0, 1) for n, v in enumerate(values)] if i % 9 else None))
    df = spark.createDataFrame(rows, f"request_id string, masked_text string, mappings {M.MAPPINGS}")
    got = [sorted(map(tuple, texts.leak_check(df, apart=apart).collect())) for apart in (-1, 10**12)]
    assert got[0] == got[1] and len(got[0]) > 100

    values = [f"user{i}@example.com" for i in range(100_000)]
    body = " ".join(["filler word"] * 80_000 + values[99_999:0:-5000])  # none begins another
    long = spark.createDataFrame([("a", body, [("t", "EMAIL", v, 0, 1) for v in values])], f"request_id string, masked_text string, mappings {M.MAPPINGS}")
    long = write_once(long, "long")
    started = time.perf_counter()
    found = texts.leak_check(long).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in found}["original_value"] == 20
    assert time.perf_counter() - started < 10


def test_passthrough(spark):
    df = spark.createDataFrame([("1", "a@b.org"), ("2", None)], "request_id string, text string")
    rows = texts.masked_table(texts.with_passthrough(df)).orderBy("request_id").collect()
    assert [(r.masked_text, r.detection_count) for r in rows] == [("a@b.org", 0), ("", 0)]


PIECES = st.sampled_from(
    ["a@b.org", "A@B.org", "10.1.2.3", "4111 1111 1111 1111", "123-45-6789", "(555) 123-4567",
     "https://x.org/y", "word", "42", "é", "\U0001F600", "\n", ".", ","])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.lists(PIECES, max_size=14), min_size=30, max_size=40))
def test_mask_and_restore(column, texts):
    """Restoring gives the text back up to e-mail case; numbers are dense; no value stays."""
    texts = [" ".join(pieces) for pieces in texts]

    def both(t):
        from textguard.functions.binding import bind

        return bind(M.analyze_text(t), lambda a: F.struct(
            a.alias("a"),
            rehydration.rehydrate_local(a["masked_text"], a["mappings"]).alias("back")))

    for text, r in zip(texts, column(both, texts)):
        assert r.back.lower() == text.lower()
        numbers = [int(m.token.rstrip("}").rsplit("_", 1)[1]) for m in r.a.mappings]
        assert numbers == list(range(1, len(numbers) + 1))
        assert len({(d.type, d.value.lower() if d.type == "EMAIL" else d.value)
                    for d in r.a.detections}) == len(numbers)


def test_long_text_full_of_values(column):
    """Hundreds of kilobytes with thousands of values: exact, across block borders."""
    places, parts, size = [], [], 0
    for i in range(3000):
        lead = "é\U0001F600 " * (i % 5) + f"host{'abcdefg'[i % 7]} "
        value = f"10.{i % 250}.{i // 250}.7" if i % 3 else f"user{i % 1500}@x.org"
        places.append(("EMAIL" if i % 3 == 0 else "IP_ADDRESS", value, size + len(lead)))
        parts += [lead, value, " said " + "hello " * (i % 40)]
        size += sum(len(p) for p in parts[-3:])
    text = "".join(parts)
    (r,) = column(M.analyze_text, [text])
    assert [(d.type, d.value, d.start) for d in r.detections] == places

    tokens, wanted, end = {}, [], 0
    for kind, value, start in places:
        token = tokens.setdefault((kind, value), "{{%s_%03d}}" % (kind, len(tokens) + 1))
        wanted += [text[end:start], token]
        end = start + len(value)
    assert r.masked_text == "".join(wanted) + text[end:]
    assert [m.token for m in r.mappings] == list(tokens.values())

    (units,) = column(lambda t: D.to_utf16_offsets(t, D.detect(t)), [text])
    for (_, value, start), s in zip(places, units):
        assert s.start == len(text[:start].encode("utf-16-be")) // 2
        assert s.end - s.start == len(value)


def test_pieces_across_blocks(spark):
    from textguard.functions.binding import BLOCK, cut_blocks, cut_piece

    text = "".join(chr(97 + i % 26) for i in range(3 * BLOCK + 5))
    edges = [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 3 * BLOCK, len(text)]
    pairs = [(a, b) for a in edges for b in edges if a <= b]
    df = spark.createDataFrame([(a, b, text) for a, b in pairs], "a int, b int, t string")
    got = df.select("a", "b", cut_piece(cut_blocks(F.col("t")), F.col("a"), F.col("b")).alias("r"))
    assert all(r.r == text[r.a:r.b] for r in got.collect())
