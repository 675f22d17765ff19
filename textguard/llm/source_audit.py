"""How far the sources of a language diverge in their terms, by single-pass in-memory indexing.

A task reads its documents once and keeps a block of postings in memory: for each term and each
(lang, source) group the documents and occurrences. When the block is full it is spilled as a run,
sorted by term and cut by the hash of the term. The runs of a hash shard are merged with a heap into
frequencies; a term lies in one shard, so there its documents in the whole language are known and
rare terms end. What is kept is the terms of at least ``MIN_DOCS`` documents of a language.

Divergences stream over these frequencies. Two sources between whose profiles a term makes a
difference hold it at least once between them; for all other terms both have the share of a
term that never occurs. So a pair starts with that difference for all terms, and each shard of terms
adds corrections for the terms that one or both hold. Sources are taken in blocks of ``SOURCES``, so
a task holds the pairs of two blocks, however many sources a language has.

Shares are whole numbers of billionths and all sums are exact.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import stored

MIN_DOCS = 30
TOP = 50
#: Postings of a block in memory; bytes of text per hash shard; a slice of a long text; postings a
#: task corrects pairs by; sources in a block of pairs; cells of a block of terms by sources.
POSTINGS = 400_000
SHARD_BYTES = 1 << 25
SLICE = 1 << 20
CORRECTED = 500_000
SOURCES = 512
CELLS = 1 << 21

_UPPER = bytes(range(0x41, 0x5B))
#: Letters A-Z become small, other bytes up to 0x7F that are no letters become blanks.
_FOLD = bytes(b + 32 if b in _UPPER else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a whole text, only A-Z lower-cased, a slice at a time."""
    folded = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _run(block: dict[tuple[str, str], tuple[Counter, Counter]], shards: int) -> pa.RecordBatch:
    """A block as a run: its terms in order, cut by shard, with the postings of each."""
    groups = list(block)
    order = sorted(set().union(*(counts for counts, _ in block.values())))
    rank = {t: i for i, t in enumerate(order)}
    shard = np.fromiter((xxhash.xxh32_intdigest(t) % shards for t in order), np.int64, len(order))
    number = np.concatenate([np.fromiter(map(rank.__getitem__, c), np.int64, len(c)) for c, _ in block.values()])
    group = np.repeat(np.arange(len(groups), dtype=np.int32), [len(c) for c, _ in block.values()])
    count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c, _ in block.values()])
    docs = np.concatenate([np.fromiter(map(d.__getitem__, c), np.int64, len(c)) for c, d in block.values()])
    by = np.lexsort((group, number, shard[number]))
    number, group, count, docs = number[by], group[by], count[by], docs[by]
    cut = np.searchsorted(shard[number], np.arange(shards + 1))
    rows = []
    for s in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(cut[s], cut[s + 1])
        start = np.flatnonzero(np.diff(number[part], prepend=-1))
        sizes = np.diff(np.r_[start, cut[s + 1] - cut[s]]).astype(np.int32)
        own = b"\n".join([order[i] for i in number[part][start].tolist()])
        rows.append((s, own, sizes.tobytes(), group[part].tobytes(), count[part].tobytes(), docs[part].tobytes()))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))]
    text = pa.list_(pa.string())
    columns += [pa.array([[g[i] for g in groups]] * len(rows), text) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "terms", "sizes", "groups", "counts", "docs", "langs", "sources"])


def runs(docs: DataFrame, shards: int, postings: int = POSTINGS) -> DataFrame:
    """The term-sorted runs of all documents (lang, source, text), one row per run and shard."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts, in_docs = block.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(counts), set()
                for part in terms(text):
                    counts.update(part)
                    seen.update(part)
                in_docs.update(seen)
                held += len(counts) - before
                if held >= postings:
                    yield _run(block, shards)
                    block, held = {}, 0
        if held:
            yield _run(block, shards)

    return docs.select("lang", "source", "text").mapInArrow(
        index, "shard int, terms binary, sizes binary, groups binary, counts binary, docs binary, langs array<string>, sources array<string>"
    )


def _stream(run: int, own: bytes, sizes: np.ndarray) -> Iterator[tuple[bytes, int, int, int]]:
    at = 0
    for term, n in zip(own.split(b"\n"), sizes.tolist()):
        yield term, run, at, at + n
        at += n


def merged(table: pa.Table, least: int = MIN_DOCS) -> pa.Table:
    """(lang, term, source, n, total, opens) from the runs of a shard, merged with a heap: occurrences
    in a source and in the language of each term that is kept; ``opens`` marks one row per term."""
    number_of: dict[tuple[str, str], int] = {}
    streams, groups, counts, docs = [], [], [], []
    for i, row in enumerate(table.to_pylist()):
        known = np.array([number_of.setdefault(g, len(number_of)) for g in zip(row["langs"], row["sources"])], np.int64)
        groups.append(known[np.frombuffer(row["groups"], np.int32)])
        counts.append(np.frombuffer(row["counts"], np.int64))
        docs.append(np.frombuffer(row["docs"], np.int64))
        streams.append(_stream(i, row["terms"], np.frombuffer(row["sizes"], np.int32)))
    base = np.cumsum([0, *map(len, groups)])
    names, at, low, high = [], [], [], []
    for term, run, a, b in heapq.merge(*streams):
        if not names or names[-1] != term:
            names.append(term)
        at.append(len(names) - 1)
        low.append(base[run] + a)
        high.append(base[run] + b)
    size = np.array(high, np.int64) - np.array(low, np.int64)
    where = np.repeat(np.array(low, np.int64) - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    term = np.repeat(np.array(at, np.int64), size)
    pairs = list(number_of)
    lang_names = sorted({lang for lang, _ in pairs})
    lang_of = np.array([lang_names.index(lang) for lang, _ in pairs], np.int64)
    group, count, doc = (np.concatenate(x)[where] for x in (groups, counts, docs))
    order = np.lexsort((group, lang_of[group], term))
    term, group, count, doc = term[order], group[order], count[order], doc[order]
    lang = lang_of[group]
    start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))  # one for each source of a term
    count, doc, term, group, lang = np.add.reduceat(count, start), np.add.reduceat(doc, start), term[start], group[start], lang[start]
    start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))  # one for each language
    width = np.diff(np.r_[start, len(term)])
    in_docs, total = np.repeat(np.add.reduceat(doc, start), width), np.repeat(np.add.reduceat(count, start), width)
    opens = np.zeros(len(term), bool)
    opens[start] = True
    kept = in_docs >= least
    own = [names[i].decode() for i in term[kept].tolist()]
    langs, sources = zip(*[pairs[g] for g in group[kept].tolist()]) if kept.any() else ((), ())
    return pa.table(
        [pa.array(langs, pa.string()), pa.array(own, pa.string()), pa.array(sources, pa.string()), count[kept], total[kept], opens[kept]],
        ["lang", "term", "source", "n", "total", "opens"],
    )


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, postings: int = POSTINGS) -> DataFrame:
    """(lang, term, source, n, total, opens) of the kept terms, stored."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(32, -(-size // SHARD_BYTES))
    dealt = runs(docs, shards, postings).groupBy("shard")
    spec = "lang string, term string, source string, n bigint, total bigint, opens boolean"
    return stored(dealt.applyInArrow(lambda t: merged(t, min_docs), spec), "frequencies")


def _share(n: str, whole: str, kept: str) -> Column:
    """Billionths of the smoothed share of n in ``whole``, and one; exact for any counts."""
    return F.expr(f"1 + cast({n} + 5 as decimal(20,0)) * 1000000000 div cast({whole} + 5 * {kept} as decimal(20,0))")


def corrections(table: pa.Table, sources: int = SOURCES) -> pa.Table:
    """Corrections of the pairs of sources for the terms of a shard: (lang, a, b, value).

    Rows without a term give the share of a term that a source does not hold.
    """
    first = table.slice(0, 1).to_pylist()[0]
    idle = table.filter(pa.compute.is_null(table["term"]))
    number = np.sort(idle["number"].to_numpy())
    p0 = idle["p"].to_numpy()[np.argsort(idle["number"].to_numpy())]
    block = number // sources
    width = len(number)
    held = table.filter(pa.compute.is_valid(table["term"]))
    code = held["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    column, share = np.searchsorted(number, held["number"].to_numpy()), held["p"].to_numpy()
    order = np.argsort(code, kind="stable")
    code, column, share = code[order], column[order], share[order]
    base = np.abs(p0[:, None] - p0[None, :])
    sums = np.zeros((width, width), np.int64)
    step = max(1, CELLS // width)
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, step):  # a block of terms by all sources
        part = slice(*np.searchsorted(code, [begin, begin + step]))
        rows = code[part] - begin
        shares = np.tile(p0, (int(rows[-1]) + 1 if len(rows) else 0, 1))
        present = np.zeros(shares.shape, bool)
        shares[rows, column[part]], present[rows, column[part]] = share[part], True
        for g in range(width):
            own = np.flatnonzero(present[:, g])
            if len(own):
                change = np.abs(shares[own] - shares[own, g][:, None]) - base[g]
                change[:, :g][present[own, :g]] = 0  # counted from the other source
                sums[g] += change.sum(axis=0)
    sums += sums.T
    wanted = (block[:, None] == first["i"]) & (block[None, :] == first["j"]) | (block[:, None] == first["j"]) & (block[None, :] == first["i"])
    np.fill_diagonal(wanted, False)
    a, b = np.nonzero(wanted)
    return pa.table([pa.array([first["lang"]] * len(a), pa.string()), number[a], number[b], sums[a, b]], ["lang", "a", "b", "value"])


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, postings: int = POSTINGS, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair`` compares a source with every other of its language: the value sums the differences of
    their shares over all kept terms. Part ``term`` lists the ``top`` kept terms by which a source
    exceeds its language. Null texts, languages and sources are empty ones, and empty names are
    groups like any other; groups without terms have the shares of terms that never occur. Repeated
    rows count as often; a language of one source has no pairs; an empty table gives an empty
    result; other columns are ignored. Ties are ranked by the item. Long texts are read in slices.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = frequencies(docs, min_docs, postings)
    group_n = found.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    lang_n = found.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.when(F.col("opens"), 1)).alias("kept"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select("lang", "source").distinct().join(group_n, ["lang", "source"], "left").join(lang_n, "lang", "left")
    groups = stored(
        groups.withColumn("number", numbered.cast("bigint")).fillna(0, ["group_n", "lang_n", "kept"])
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang"))), "groups",
    )
    shares = stored(
        found.join(groups, ["lang", "source"])
        .select("lang", "source", "term", "number", "sources", _share("n", "group_n", "kept").alias("p"), _share("total", "lang_n", "kept").alias("q")), "shares",
    )

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    parts = max(8, -(-shares.count() // CORRECTED))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / sources).cast("int"))).alias("other")
    own = F.floor(F.col("number") / sources).cast("int")
    idle = groups.filter("kept > 0").withColumn("p", _share("0", "group_n", "kept"))
    idle = stored(idle.select("lang", "source", "number", "sources", "kept", "p"), "idle")
    shard = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("shard")
    rows = shares.select("lang", "number", "sources", "term", "p", shard).unionByName(
        idle.select("lang", "number", "sources", F.lit(None).cast("string").alias("term"), "p", every)
    )
    rows = rows.select("*", blocks).select("lang", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "shard", "number", "term", "p")
    changed = rows.groupBy("lang", "i", "j", "shard").applyInArrow(lambda t: corrections(t, sources), "lang string, a bigint, b bigint, value bigint")
    changed = changed.groupBy("lang", "a", "b").agg(F.sum("value").alias("change"))
    left = groups.join(idle.select("lang", "number", "p"), ["lang", "number"], "left").select("lang", "source", F.col("number").alias("a"), "kept", F.col("p").alias("p_a"))
    right = left.select("lang", F.col("source").alias("item"), F.col("a").alias("b"), F.col("p_a").alias("p_b"))
    both = left.join(right, "lang").filter("a <> b").join(changed, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("kept") * F.abs(F.col("p_a") - F.col("p_b")) + F.coalesce("change", F.lit(0)), F.lit(0))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(over)


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), w AS (
    SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL
), kept AS (
    SELECT lang, term FROM c GROUP BY ALL HAVING sum(docs) >= 30
), groups AS (
    SELECT DISTINCT lang, source FROM d
), gc AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), gp AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p
    FROM gc WINDOW g AS (PARTITION BY lang, source)
), lc AS (
    SELECT lang, term, sum(n) AS n FROM gc GROUP BY ALL
), lp AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER l + 5 * count(*) OVER l) AS q
    FROM lc WINDOW l AS (PARTITION BY lang)
), pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gp x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN gp y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source
), over_lang AS (
    SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value
    FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (SELECT * FROM pair UNION ALL SELECT * FROM over_lang)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
