"""Removal of repeated passages beside a dictionary of all windows."""

import random

import numpy as np
import pytest

from textguard.llm import substrings


def naive(rows, length=13):
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    rank = [float("inf") if d is None else d for d, *_ in rows]
    first = {}
    for w, r in zip(words, rank):
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, r), r)
    out = []
    for (d, *_), w, r in zip(rows, words, rank):
        gone = {i + k for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < r for k in range(length)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    shared = [text(rng.choice([12, 13, 14, 30, 80])) for _ in range(12)]
    rows = []
    for d in range(160):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), text(rng.randrange(20))]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p), "k"))
    rows += [(200 + i, rows[3][1], "copy") for i in range(60)]
    rows += [(3, rows[3][1], "again"), (None, rows[4][1], "no id"), (None, rows[4][1], "no id"), (300, None, "null"), (301, "", "empty"),
             (302, "x " * 13, "run"), (303, "x " * 40, "run"), (304, " ".join(text(60_000)) + " " + rows[5][1], "long")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_bytes", [substrings.SHARD_BYTES, 20_000])
def test_removal(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard_bytes)
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(4)
    out = substrings.deduplicated(df)
    assert out.columns == ["doc_id", "text", "n_words_", "kept_text", "n_words", "n_removed"]
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == naive(rows)
    assert sorted((str(r.doc_id), str(r.text), r.n_words_) for r in got) == sorted((str(d), str(t), k) for d, t, k in rows)
    assert substrings.deduplicated(df.limit(0)).count() == 0


def test_hot_prefixes_are_spread(spark, monkeypatch):
    """A phrase with ever other words around it: its windows go by all their words."""
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4_000)
    rng = random.Random(4)
    phrase = "alpha beta gamma delta epsilon zeta"
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = [(d, f"{text(12)} {phrase} {text(12)}") for d in range(150)]
    rows += [(200 + d, t) for d, t in rows[::3]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (substrings.GROUP_WINDOWS, 20):
        monkeypatch.setattr(substrings, "GROUP_WINDOWS", most)
        got = substrings.deduplicated(df).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == naive(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, n_words int, n_words_ int")
    out = substrings.deduplicated(df)
    assert out.columns == ["doc_id", "text", "n_words__", "n_words_", "kept_text", "n_words", "n_removed"]
    assert [tuple(r) for r in out.collect()] == [(1, "a b", 5, 6, "a b", 2, 0)]


def ended(runs):
    """Runs of words one after another, each with an end of its own."""
    words, at = [], []
    for i, run in enumerate(runs):
        at += range(len(words), len(words) + len(run))
        words += [*run, 1000 + i]
    return np.array(words), np.array(at)


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(60):
        words, at = ended([[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 8))])
        order, common = substrings.suffix_order(words, at)
        suffix = [words[i:].tolist() for i in at[order]]
        assert suffix == sorted(suffix) and sorted(order.tolist()) == list(range(len(at)))
        alike = [next(i for i, (x, y) in enumerate(zip(a, b)) if x != y) for a, b in zip(suffix, suffix[1:])]
        assert common.tolist() == [0, *alike]


def test_a_long_repeat_is_one_node():
    passage = list(range(60))
    words, at = ended([[70, *passage, 71], [72, 73, *passage], passage])
    order, common = substrings.suffix_order(words, at)
    node, depth = substrings.deep_nodes(common, 13)
    starts = np.isin(at[order], [1, 65, 126])
    assert len(set(node[starts])) == 1 and depth[node[starts][0]] == 60
    assert sorted(depth[depth > 0]) == list(range(13, 61))
    assert substrings.deep_nodes(np.array([0, 2, 1, 3]), 2)[0].tolist() == [0, 0, 1, 1]
