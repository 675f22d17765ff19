import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textguard.functions import detection as D
from textguard.functions import patterns as P
from textguard.operators.texts import detections_table

GOLDEN = [
    ("Contact john@example.com please", [("EMAIL", "john@example.com", 8)]),
    ("Email user+support@example.co.uk today", [("EMAIL", "user+support@example.co.uk", 6)]),
    ("Contact john@example please", []),
    ("Contact john@example.c please", []),
    ("Call 9876543210 now", [("PHONE", "9876543210", 5)]),
    ("Call +91 9876543210 now", [("PHONE", "+91 9876543210", 5)]),
    ("Call +1 555 123 4567 now", [("PHONE", "+1 555 123 4567", 5)]),
    ("Call (555) 123-4567 now", [("PHONE", "(555) 123-4567", 5)]),
    ("Call 555-123-4567 now", [("PHONE", "555-123-4567", 5)]),
    ("Call (555) now", []),
    ("Card 4111 1111 1111 1111 here", [("CREDIT_CARD", "4111 1111 1111 1111", 5)]),
    ("Card 4111111111111111 here", [("CREDIT_CARD", "4111111111111111", 5)]),
    ("Card 4111-1111-1111-1111.", [("CREDIT_CARD", "4111-1111-1111-1111", 5)]),
    ("Card 4111 1111 1111 1112 here", []),
    ("Number 1234567890123456 here", []),
    ("SSN: 123-45-6789.", [("SSN", "123-45-6789", 5)]),
    ("ID 123456789 here", []),
    ("Server 192.168.1.10 is down", [("IP_ADDRESS", "192.168.1.10", 7)]),
    ("Server 999.999.999.999 here", []),
    ("Version 1.2.3.4.5 here", []),
    ("Visit https://example.com.", [("URL", "https://example.com", 6)]),
    ("See (http://example.com/a?b=c#d), ok", [("URL", "http://example.com/a?b=c#d", 5)]),
    ("https://.", [("URL", "https://", 0)]),
    (
        "Mail john@example.com, card 4111-1111-1111-1111, call 9876543210.",
        [("EMAIL", "john@example.com", 5), ("CREDIT_CARD", "4111-1111-1111-1111", 28),
         ("PHONE", "9876543210", 54)],
    ),
    # earliest start wins over type priority
    ("+3782 822463 10005", [("PHONE", "+3782 822463 10005", 0)]),
    # a rejected candidate uses its text up
    ("4111111111111111 2 items", []),
    ("X123-45-6789Y", [("PHONE", "123-45-6789", 1)]),
    ("5551234567 +1 555 123 4567", [("PHONE", "5551234567", 0), ("PHONE", "1 555 123 4567", 12)]),
    # word boundaries are ASCII
    ("éjohn@example.com", [("EMAIL", "john@example.com", 1)]),
    ("a@b.com.c@d.com", [("EMAIL", "a@b.com", 0), ("EMAIL", ".c@d.com", 7)]),
    (" .x@y.org", [("EMAIL", "x@y.org", 2)]),
    # the same value twice: places come from the gaps
    ("10.0.0.1 or 10.0.0.1", [("IP_ADDRESS", "10.0.0.1", 0), ("IP_ADDRESS", "10.0.0.1", 12)]),
    ("v10.0.0.12 then 10.0.0.1", [("IP_ADDRESS", "10.0.0.12", 1), ("IP_ADDRESS", "10.0.0.1", 16)]),
    ("1.10.0.0.1 and 10.0.0.1", [("IP_ADDRESS", "10.0.0.1", 15)]),
    # offsets count code points
    ("\U0001F600 john@example.com", [("EMAIL", "john@example.com", 2)]),
    ("", []),
    (None, []),
]


def test_golden_texts(column):
    got = column(D.detect, [text for text, _ in GOLDEN])
    for (text, wanted), spans in zip(GOLDEN, got):
        assert [(s.type, s.value, s.start) for s in spans] == wanted, text
        for s in spans:
            assert text[s.start:s.end] == s.value


CARDS = {
    "4111111111111111": True, "4111-1111-1111-1111": True, "378282246310005": True,
    "4111 1111 1111 1111": True, "": False, "123": False, "123456789012": False,
    "12345678901234567890": False, "411111111111111a": False, "0000000000000000": False,
    "4111/1111/1111/1111": False, "4111\t1111\t1111\t1111": False, "4111111111111112": False,
}


def test_card_check(column):
    assert column(D.is_card, list(CARDS)) == list(CARDS.values())


def test_ipv4_check(column):
    cases = {"0.0.0.0": True, "255.255.255.255": True, "256.1.1.1": False, "01.02.003.4": True,
             "1.2.3": False, "1.2.3.4.5": False, "1..2.3": False, "1.2.3.4a": False, "": False,
             "1111.2.3.4": False}
    assert column(D.is_ipv4, list(cases)) == list(cases.values())


def test_phone_check(column):
    cases = {"123-4567": True, "123-456": False, "1234567890": True, "123456789": False,
             "+12345678901": False, "+1 2345678901": True, "192.168.1.10": False,
             "1-234-567-890-123-456": False}
    assert column(D.is_phone, list(cases)) == list(cases.values())


def _resolve(spark, spans):
    schema = f"c {D.SPANS}"
    df = spark.createDataFrame([([(t, "x" * (e - s), s, e) for t, s, e in spans],)], schema)
    kept = df.select(D.resolve_overlaps(F.col("c")).alias("r")).first().r
    return [(s.type, s.start, s.end) for s in kept]


@pytest.mark.parametrize(
    "spans, kept",
    [
        ([("PHONE", 5, 16), ("SSN", 5, 16)], [("SSN", 5, 16)]),
        ([("EMAIL", 0, 10), ("URL", 5, 15)], [("EMAIL", 0, 10)]),
        ([("EMAIL", 5, 10), ("EMAIL", 5, 10)], [("EMAIL", 5, 10)]),
        ([("EMAIL", 5, 10), ("EMAIL", 5, 12)], [("EMAIL", 5, 12)]),
        # the rejected middle span must not block the last one
        ([("URL", 0, 10), ("PHONE", 8, 30), ("SSN", 12, 20)], [("URL", 0, 10), ("SSN", 12, 20)]),
        ([("PHONE", 20, 25), ("EMAIL", 0, 5)], [("EMAIL", 0, 5), ("PHONE", 20, 25)]),
        ([("EMAIL", 0, 5), ("URL", 5, 9)], [("EMAIL", 0, 5), ("URL", 5, 9)]),
        ([], []),
    ],
)
def test_overlaps(spark, spans, kept):
    assert _resolve(spark, spans) == kept


def test_utf16_offsets(spark):
    df = spark.createDataFrame([("\U0001F600 a@b.org",)], "t string")
    s = df.select(D.to_utf16_offsets(F.col("t"), D.detect("t")).alias("r")).first().r[0]
    assert (s.value, s.start, s.end) == ("a@b.org", 3, 10)


def test_added_detector(spark):
    """An extra type takes part in the overlap choice; null results are tolerated."""

    def tickets(text):
        return F.transform(
            D.with_offsets(text, r"TKT-\d{10}"),
            lambda h: F.struct(F.lit("TICKET").alias("type"), h["value"].alias("value"),
                               h["start"].alias("start"),
                               (h["start"] + F.length(h["value"])).alias("end")),
        )

    def nothing(text):
        return F.lit(None).cast(D.SPANS)

    extra = (D.Detector("TICKET", 5, tickets), D.Detector("NONE", 70, nothing))
    df = spark.createDataFrame([("1", "see TKT-9876543210 and 9876543210")], "request_id string, text string")
    got = detections_table(df, detectors=extra).orderBy("start").collect()
    assert [(r.type, r.start) for r in got] == [("TICKET", 4), ("PHONE", 23)]


def test_vectorised_detector(spark):
    import pandas as pd

    @F.pandas_udf(D.SPANS)
    def shouting(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [{"type": "SHOUT", "value": m.group(), "start": m.start(), "end": m.end()}
                       for m in re.finditer(r"\b[A-Z]{5,}\b", t or "")]
        )

    df = spark.createDataFrame([("1", "HELLO a@b.org")], "request_id string, text string")
    got = detections_table(df, detectors=(D.Detector("SHOUT", 1, shouting),))
    assert [(r.type, r.value) for r in got.orderBy("start").collect()] == [
        ("SHOUT", "HELLO"), ("EMAIL", "a@b.org")]


def _plain_scan(pattern: str, text: str) -> list[tuple[str, int]]:
    """The same pattern in Python; \\d, \\s and \\w are ASCII in both."""
    return [(m.group(), m.start()) for m in re.finditer(pattern, text, re.ASCII)]


ALPHABET = st.text(alphabet="0123456789 .-()+@aZ_é:/\n", max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(ALPHABET, min_size=40, max_size=60))
def test_offsets_equal_a_plain_scan(column, texts):
    """Places found by search or by gaps equal those of a regex engine that reports them."""
    for name in ("EMAIL", "URL", "IP_ADDRESS", "CREDIT_CARD", "SSN", "PHONE"):
        pattern = getattr(P, name)
        got = column(lambda t, p=pattern: D.with_offsets(t, p), texts)
        for text, hits in zip(texts, got):
            assert [(h.value, h.start) for h in hits] == _plain_scan(pattern, text), (name, text)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(ALPHABET, min_size=40, max_size=60))
def test_spans_are_sorted_disjoint_and_exact(column, texts):
    hinted = column(D.may_contain_pii, texts)
    for text, spans, hint in zip(texts, column(D.detect, texts), hinted):
        end = 0
        for s in spans:
            assert s.start >= end and s.end > s.start
            assert text[s.start:s.end] == s.value
            end = s.end
        assert hint or not spans


def test_looked_up_places_equal_those_of_gaps(column):
    """Values that stand elsewhere too, in other bytes or more often than is looked up."""
    values = [
        "x@b.org", "ax@b.org x@b.org", "-x@b.org, x@b.orgs x@b.org", "1.2.3.4", "91.2.3.4.5 1.2.3.4",
        "\U0001F600 é 1.2.3.4 \U0001F600 x@b.org", " ".join(f"{i}.2.3.{i}" for i in range(12)),
        "1.2.3.4 " + "é" * 5000 + " 5.6.7.8", "", None,
    ]
    for pattern, group in ((P.EMAIL_RUN, 1), (P.IP_ADDRESS, 0)):
        got = column(lambda v: D.with_offsets(v, pattern, group), values)
        gaps = column(lambda v: _by_gaps(v, pattern, group), values)
        assert got == gaps


def _by_gaps(text, pattern, group):
    # with a tail that holds no match the text is longer than those in which values are looked up
    return D.with_offsets(F.concat(text, F.lit("\n" + "ß" * 5000)), pattern, group)
