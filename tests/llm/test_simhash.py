"""SimHash links beside a comparison of all pairs."""

import numpy as np
import pytest

from textguard.llm import simhash
from textguard.llm.bktree import Forest


def naive_print(text, size=3):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(prints):
    """prints: list of (doc_id, fp)."""
    root = {p: p for _, p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    first = {}
    for doc, p in prints:
        if doc is not None:
            r = find(p)
            first[r] = min(first.get(r, doc), doc)
    return sorted(((d, f"{p:016x}", first.get(find(p))) for d, p in prints), key=str)


def test_forest_finds_what_all_pairs_find():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(9)]))
    group = (prints % np.uint64(3)).astype(np.int64)
    forest = Forest(group, prints[:, None])
    found = {(int(a), int(b)) for q, n in forest.within(group, prints[:, None], 3) for a, b in zip(q, n)}
    wanted = {
        (i, j) for i in range(len(prints)) for j in range(len(prints))
        if group[i] == group[j] and int(prints[i] ^ prints[j]).bit_count() <= 3
    }
    assert found == wanted


@pytest.mark.parametrize("tree", [5, simhash.TREE])
def test_links_keep_every_connection(spark, tree):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = lambda: np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    prints = sorted({int(b ^ flips()) for b in base for _ in range(12)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x, x) for x in signed], "node long, fp0 long")
    from textguard.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(df, tree=tree)).collect()}
    got = {}
    for x in signed:
        got.setdefault(roots.get(x, x), set()).add(x)
    wanted = {}
    for (d, _, first), x in zip(sorted(naive_components([(i, p) for i, p in enumerate(prints)]), key=lambda r: r[0]), signed):
        wanted.setdefault(first, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_query_over_documents(spark):
    from textguard.llm.queries import QUERIES

    got = QUERIES["op2_bk_simhash"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    wanted = naive_components([(r.doc_id, naive_print(r.text)) for r in docs])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == wanted


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [
        (1, None, "a"), (2, "", None), (3, "  \t\n", "c"), (4, "One two", "d"), (5, "one TWO", "e"), (5, "one TWO", "e"),
        (None, "one two", "f"), (7, long, "g"), (8, long + " end", "h"), (9, "É one two three", "i"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = simhash.near_duplicates(df).collect()
    seen = sorted(((r.doc_id, f"{r.fp0 & (2**64 - 1):016x}", r.component_id) for r in got), key=str)
    assert seen == naive_components([(d, naive_print(t)) for d, t, _ in rows])
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 7, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_copies_within_the_radius_go(spark):
    """Long texts of which one word differs: who stays is who leads a component of the fingerprints."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for d in range(40):
        words = [word() for _ in range(600)]
        rows.append((d, " ".join(words)))
        words[-1] = word()
        rows.append((1000 + d, " ".join(words)))
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d, _, first in naive_components([(d, naive_print(t)) for d, t in rows]) if d == first}
    assert kept >= set(range(40)) and len(kept) < 60
