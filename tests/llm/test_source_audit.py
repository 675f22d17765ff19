"""Source divergences beside exact sums in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from textguard.llm import source_audit
from textguard.llm.source_audit import audited


def naive(rows, least=30, top=50):
    """Rows of (lang, source, text)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted((s for x, s in counts if x == lang), key=lambda s: s.encode())
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(own[s][t] - q[t], t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def rows_of(seed, n=1200):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghijkl" for b in ("ab", "É", "ß", "zz", "日本", "x-y", "O'q")]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, "fr"]), rng.choice(["s1", "s2", "s3", "S4", "é", None, "", "s1"])
        own = vocabulary[: rng.choice([8, 30, len(vocabulary)])]
        rows.append((lang, source, " ".join(rng.choices(own, k=rng.choice([0, 1, 5, 40])))))
    return [*rows, ("xx", "only", "one text"), ("yy", "a", None), ("yy", "b", "!!! 12"), (None, None, None)]


@pytest.mark.parametrize("postings, sources", [(source_audit.POSTINGS, source_audit.SOURCES), (60, 2)])
def test_values_are_exact(spark, postings, sources):
    rows = rows_of(postings)
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, n int").repartition(5)
    got = sorted(tuple(r) for r in audited(df, postings=postings, sources=sources).collect())
    assert got == naive(rows)


def test_odd_rows(spark):
    long = "Deep " * 400_000 + "end"
    rows = [("en", "a", long), ("en", "b", "deep"), ("en", "b", "deep"), ("en", "c", "\x00deep\x7fdeep")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(tuple(r) for r in audited(df, min_docs=2, top=1).collect())
    assert got == naive(rows, 2, 1)
    assert audited(df.limit(0)).count() == 0
    none = df.selectExpr("lang", "source", "cast(null as string) AS text")
    assert {r.value for r in audited(none).collect()} == {0}


def test_runs_are_sorted_and_merge_to_the_counts():
    block = {("en", "a"): (Counter(b"b a b c".split()), Counter(b"a b c".split())), ("de", "a"): (Counter(b"b d".split()), Counter(b"b d".split()))}
    batches = [source_audit._run(block, 3), source_audit._run(block, 3)]
    table = pa.Table.from_batches(batches)
    assert all(t.split(b"\n") == sorted(t.split(b"\n")) for t in table["terms"].to_pylist())
    got = []
    for s in range(3):
        part = table.filter(pa.compute.equal(table["shard"], s))
        got += [tuple(r.values()) for r in source_audit.merged(part, 2).to_pylist()] if len(part) else []
    assert sorted(got) == [
        ("de", "b", "a", 2, 2, True), ("de", "d", "a", 2, 2, True), ("en", "a", "a", 2, 2, True), ("en", "b", "a", 4, 4, True), ("en", "c", "a", 2, 2, True),
    ]


def test_large_counts_stay_exact(spark):
    n, whole, kept = 4 * 10**12, 9 * 10**17, 10**9
    df = spark.createDataFrame([(n, whole, kept)], "n long, whole long, kept long")
    assert df.select(source_audit._share("n", "whole", "kept").alias("p")).head().p == 1 + 10**9 * (n + 5) // (whole + 5 * kept)
