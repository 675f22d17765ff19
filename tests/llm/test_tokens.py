"""Ids beside the library's own, from piece to file to window."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textguard.llm import packing, planes
from textguard.llm.tokens import Encoder
from textguard.sources.storage import new_path

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ENCODERS = {name: Encoder(public_tokenizers.path(name)) for name in FILES}
LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in FILES}  # as it comes
PIECES = st.lists(st.sampled_from([
    "word", "Word,", "it's", "I'LL", "_x_", "é", "é", "İ", "ΑΣ", "x²", "3.14", "…", "—", "日本", "''s", "<|endoftext|>",
    " ", "  ", "\n", "\n\n", "\t", "\x1c", " ", "　", ".", "!?", "a_b", "ﬁ", "‍", "🙂", "naïve",
]), max_size=14).map("".join) | st.text(max_size=12)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_pieces_encode_like_whole_texts(name, text):
    ids = LIBRARY[name].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODERS[name].encode([text])[0], "<u4").tolist() == ids


def test_strings_of_added_tokens():
    for text in ("hello <|endoftext|> world", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "x <|endoftext|>\ny", "<|end", "a <|endof text|>"):
        for name in FILES:
            ids = LIBRARY[name].encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ENCODERS[name].encode([text])[0], "<u4").tolist() == ids


def naive(name, text, end):
    return [*LIBRARY[name].encode(text or "", add_special_tokens=False).ids, end]


def some_docs(spark, n=300):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma.", "delta,", "it's", "é", "Ω", "x1"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 400]))), "e") for i in range(n)]
    rows += [(n + 3, "alpha <|endoftext|> beta", "f"), (n + 4, "<|startoftext|>gamma.", "g")]
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, " ".join(rng.choices(vocabulary, k=60_000)), "c"), (None, "no id", "d"), (5, rows[5][1], "e")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)


def test_planes_round_trip(spark):
    rows, df = some_docs(spark)
    path = new_path(spark, "planes")
    planes.write_planes(df, path, public_tokenizers.path(FILES[0]), end_id=2, block_ids=1000)
    got = planes.with_starts(planes.read_documents(spark, path), spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _, _ in rows), key=lambda d: (d is not None, d or 0))
    at, texts = 0, defaultdict(list)
    for d, t, _ in rows:
        texts[d].append(naive(FILES[0], t, 2))
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        texts[r.doc_id].remove(ids)
        at += len(ids)
    blocks = spark.read.parquet(path).collect()
    assert all(r.n_ids <= 1000 and len(r.planes) == 4 for r in blocks)
    assert spark.read.parquet(path).agg({"n_ids": "sum"}).head()[0] == at


def test_no_documents(spark):
    _, df = some_docs(spark, 9)
    path = new_path(spark, "planes")
    planes.write_planes(df.limit(0), path, public_tokenizers.path(FILES[0]), end_id=2)
    assert planes.with_starts(planes.read_documents(spark, path), spark, path).count() == 0
    assert packing.packed(df.limit(0), public_tokenizers.path(FILES[1]), end_id=1).count() == 0


def test_packing(spark):
    rows, df = some_docs(spark)
    got = packing.packed(df, public_tokenizers.path(FILES[1]), end_id=1, window=256, with_ids=True).collect()
    windows = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
    used = 0
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        used += at
    assert sorted(windows) == list(range(len(windows)))
    assert len(windows) == -(-used // 256)
    wanted = defaultdict(list)
    for d, t, _ in rows:
        wanted[d] += [naive(FILES[1], t, 1)]
    for d, held in pieces.items():
        flat = sorted((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in held)
        if len(wanted[d]) == 1:
            assert sum((ids for _, ids in flat), []) == wanted[d][0]
            assert {r.doc_tokens for r in held} == {len(wanted[d][0])}
        else:
            assert sum(len(ids) for _, ids in flat) == sum(map(len, wanted[d]))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 60), max_size=20), st.integers(0, 5))
def test_plan_places_every_tail_once(counts, first):
    histogram = np.zeros(32, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    made = packing.plan(histogram, 32, first)
    full = defaultdict(set)
    for length, n in counts.items():
        for rank in range(n):
            parts = made.place(length, rank)
            assert sum(p[1] for p in parts) == length and parts[0][0] == 0
            for _, size, sequence, offset in parts:
                cells = set(range(offset, offset + size))
                assert not cells & full[sequence] and max(cells) < 32
                full[sequence] |= cells
    total = int(np.arange(32) @ histogram)
    assert sorted(full) == list(range(first, first + -(-total // 32)))


def test_least_squares_repeats_what_fits():
    histogram = np.zeros(101, np.int64)
    histogram[[60, 40]] = 500
    rows = packing.combinations(histogram, 100)
    assert np.allclose(packing.repeats(rows, histogram) @ (rows[:, :1] == 60), 500, atol=1)


def test_batches_are_cut_by_bytes_and_memory_goes_back():
    """A run of rows is about a slice of text, longer texts stand alone, and all rows come in order."""
    import pyarrow as pa
    from textguard.llm import tokens

    texts = ["ab", None, "c" * 50, "", "dé", "e" * 9, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(tokens.slices(batch, 1, 10))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5, 6]]
    assert sum((p.column(1).to_pylist() for p in parts), []) == texts
    assert list(tokens.slices(batch.slice(3, 3), 1, 10))[0].column(0).to_pylist() == [3, 4]
    assert list(tokens.slices(batch.slice(0, 0), 1)) == []
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokens.Encoder(path)
    own.known = {f"{n:07x}"[::-1]: b"1234" for n in range(70_000)}
    before = dict(own.known)
    tokens._encoders[path], known = own, tokens._encoders.get(path)
    try:
        held = next(iter(own.known))
        tokens.forget(path)
        assert own.known == dict(list(before.items())[: tokens.KEPT])
        assert next(iter(own.known)) is not held  # a copy: the blocks of all that was known can go
    finally:
        tokens._encoders.pop(path) if known is None else tokens._encoders.update({path: known})


WORDS = st.lists(st.text("aZéßÀÿ", min_size=1, max_size=6) | st.sampled_from(["the", "Straße", "LL", "s"]), min_size=1, max_size=9)
ENDS = st.sampled_from([" ", " ", ", ", ".\n", "\n", "'' ", "'s ", "… ", "\nµ "])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=200, deadline=None)
@given(WORDS, ENDS, ENDS)
def test_plain_words_go_straight_to_the_model(name, words, end, other):
    """Words of Latin letters take no way through the library's cutting, and their ids are the library's."""
    texts = [end.join(words) + other.strip(), other.join(words), " ".join(words), None, "", words[0]]
    own = ENCODERS[name]
    own.known = {}
    for _ in range(2):  # not known, then known
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == naive(name, text, 0)[:-1]
    plain = [" ".join(words) + "!\n" + words[0]]
    known, own.known = own.encode(plain), {}
    own._learn_any = lambda pieces: pytest.fail(f"not plain: {pieces}") if pieces else None
    try:
        assert own.encode(plain) == known
    finally:
        del own._learn_any


def test_other_cutting_goes_the_whole_way(tmp_path):
    from tokenizers import normalizers

    odd = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    odd.normalizer = normalizers.Replace("e", "o")
    odd.save(str(tmp_path / "odd.json"))
    own = Encoder(str(tmp_path / "odd.json"))
    text = "three Elements,\nseen here"
    assert not own.direct and np.frombuffer(own.encode([text])[0], "<u4").tolist() == odd.encode(text).ids
