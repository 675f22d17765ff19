"""Tiles beside the naive greedy algorithm; leaks whole, in pieces and reordered."""

import random

import numpy as np

from textguard.llm import tiling


def naive(p, t, least):
    p, t = list(p), list(t)
    marked_p, marked_t, total = set(), set(), 0
    while True:
        best, at = 0, None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in marked_p and j + n not in marked_t:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < least:
            return total
        marked_p |= set(range(at[0], at[0] + best))
        marked_t |= set(range(at[1], at[1] + best))
        total += best


def test_tiles_cover_what_the_naive_algorithm_covers():
    rng = random.Random(2)
    for _ in range(150):
        p = np.array([rng.randrange(5) for _ in range(rng.randint(1, 25))])
        t = np.array([rng.randrange(5) for _ in range(rng.randint(1, 40))])
        found = tiling.tiles(p, t)
        assert sum(n for _, _, n in found) == naive(p, t, tiling.MIN_TILE)
        assert all((p[a : a + n] == t[b : b + n]).all() for a, b, n in found)


def test_very_long_match():
    ids = np.arange(5000)
    assert tiling.tiles(ids, np.r_[7, ids, 9]) == [(0, 1, 5000)]


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(30)] + [(90, None), (91, ""), (92, "too short"), (3, None)]
    body = dict(items[:30])

    def swapped(s):
        w = s.split()
        return " ".join(w[20:] + ["and", "then"] + w[:20])

    docs = [
        (1, f"{text(50)} {body[4]} {text(10)}", "x"), (2, f"{text(5)} {swapped(body[5])}", "x"),
        (3, " ".join(body[6].split()[:15]), "x"), (4, f"{body[7].upper()}! {body[8]}", "x"), (5, None, "x"), (6, "", "x"), (7, text(300), "x"),
        (8, ", ".join(" ".join(body[9].split()[i : i + 6]) for i in (30, 6, 24, 12, 0, 18)), "x"), (8, text(9), "x"),
        (None, body[10], "x"), (11, text(150_000) + " " + body[11], "x"), (12, " ".join([body[12].split()[0]] * 500), "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = {(1, 4), (2, 5), (4, 7), (4, 8), (8, 9), (None, 10), (11, 11)}
    for block_words in (tiling.BLOCK_WORDS, 200):
        got = tiling.contaminated(df, benchmark, block_words=block_words).collect()
        assert {(r.doc_id, r.item_id) for r in got} == wanted and len(got) == len(wanted)
        assert all(0.5 <= r.coverage <= 1 for r in got)
    clean = tiling.decontaminated(df, benchmark)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 6, 7, 8, 12]
    assert tiling.contaminated(df, benchmark.limit(0)).count() == 0
    assert tiling.contaminated(df.limit(0), benchmark).count() == 0
