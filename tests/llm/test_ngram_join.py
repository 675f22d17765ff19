"""Set links beside a comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from textguard.llm import ngram_join
from textguard.llm.ngram_join import joined


def naive(rows, percent=90):
    """(doc_id, n, component) of rows (doc_id, text), comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({" ".join(w)} - {""} if len(w) < 3 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def seen(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(seed, groups=12, copies=9, length=120):
    """Texts at and around the bound: each copy changes some words of the one before or of the first."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(length)] if g % 3 else shared * 2 + [word() for _ in range(rng.randint(1, 9))]
        last = base
        for c in range(copies):
            own = list(last if g % 2 else base)
            for at in rng.sample(range(len(own)), rng.randint(0, 5)):
                own[at] = word()
            last = own
            rows.append((100 * g + c, " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fragments, chunk", [(8, 4096), (3, 4)])
def test_components_are_those_of_all_pairs(spark, fragments, chunk):
    rows = near_copies(fragments)
    wanted = naive(rows)
    assert 15 < len({c for _, _, c in wanted}) < 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert seen(joined(df, fragments=fragments, chunk=chunk)) == wanted


def test_a_large_group_does_not_make_all_pairs(spark):
    """Copies of one text, each with words of its own; only through the first are all linked."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(200)]
    rows = [(i, " ".join([*base, *[word() for _ in range(15 if i else 0)]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = ngram_join.surveyed(df).filter("n is not null")
    classes = table.groupBy("node").agg({"doc_id": "min", "n": "max"}).toDF("node", "first", "n")
    sets = ngram_join.ordered(df, classes)
    grams = sets.selectExpr("node", "n", "rarity", "0L AS place", "node AS label", "explode(slice(transform(shared, x -> x.gram), 1, 40)) AS gram")
    hubs = ngram_join._with_hub(grams, 0, 90)
    assert 399 <= hubs.count() < 450  # about one pair for each copy, of 79,800
    assert {r.component_id for r in joined(df).collect()} == {0}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (7, long), (8, long + " end"),
        (9, "É one two three"), (10, "two one"), (11, "x"), (None, None), (12, "a b c a b c a b c"), (13, "a b c a b c"), (None, "alone here now"),
        (14, "one text"), (14, "another text of one id"),
    ]
    df = spark.createDataFrame([(*r, "n", 5) for r in rows], "doc_id long, text string, node string, n int")
    assert seen(joined(df)) == naive(rows)
    assert joined(df.limit(0)).count() == 0
    assert seen(joined(df.filter("text is null"))) == naive([r for r in rows if r[1] is None])
    named = df.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in joined(named).collect() if r.component_id == "d4"} == {"d4", "d5", None}


def test_other_sizes(spark):
    rows = near_copies(5, groups=4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert seen(joined(df, percent=75)) == naive(rows, 75)
    assert seen(joined(df, percent=100)) == naive(rows, 100)


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**62, 50, dtype=np.uint64)) for _ in range(20)]
    sets[3] = np.unique(np.r_[sets[3], sets[7][:5]])
    parts = list(ngram_join._packed(sets, list(range(20)), 7))
    assert sorted(p[0] for p in parts) == list(range(7))
    assert sum(len(p[1]) for p in parts) == ngram_join.KEY_BYTES * (sum(map(len, sets)) - 10)
    assert sum(len(p[4]) for p in parts) == ngram_join.KEY_BYTES * 5
    nodes = np.concatenate([np.repeat(np.frombuffer(p[2], np.int64), np.frombuffer(p[3], np.int32)) for p in parts])
    assert np.bincount(nodes).tolist() == [len(s) - 5 * (i in (3, 7)) for i, s in enumerate(sets)]
