"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

The tokenizers used here cut a text before they look up ids, and never across a place where white
space follows something else. Between such places a text is made of pieces whose ids do not
depend on their surroundings; they are encoded by the library and remembered. Texts in which that
would not hold, for white space other than single blanks and line ends or for letters that change
when normalised, are encoded whole. So are texts that hold the string of an added token, such as
``<|endoftext|>``, which the library finds before it cuts.

Most pieces are a word of Latin letters, which the cutting and normalising of the files at hand leave in
one; such a word goes straight to the library's model. Pieces are told apart and their ids put behind
one another in Arrow, a slice of the texts at a time.
"""

from __future__ import annotations

import json
import pickle
import re
import string
import unicodedata
from collections.abc import Iterator
from itertools import compress, islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: White space other than blank and line end; what lower-casing or normalising may move.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　İΣ]")
REMEMBERED = 800_000
KEPT = 60_000  # short pieces, which are the frequent ones, that a worker keeps when a task ends
SHORT = 7
TOGETHER = 2_000

#: A word of Latin letters that normalising leaves alone, and punctuation behind it.
_PLAIN = r"^\n?[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]*$"
#: How files normalise and cut for which a plain word is spelled for the model as ``_spelled`` says.
_CUT_BY_BYTES = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
_CUT_BY_WORDS = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    {"type": "Sequence", "pretokenizers": [
        {
            "type": "Split", "behavior": "Removed", "invert": True,
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        },
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]},
)


def _settings(part) -> dict | None:
    """The settings of a tokenizer's normaliser or cutter, without those that only move offsets."""
    def kept(value):
        if isinstance(value, dict):
            return {k: kept(v) for k, v in value.items() if k != "trim_offsets"}
        return [kept(v) for v in value] if isinstance(value, list) else value

    return kept(json.loads(part.__getstate__())) if part is not None else None


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_letters()
_UTF_16 = np.array([ord(_BYTES[b]) if chr(b) not in " \n" else b for b in range(256)], "<u2")


def _odd(piece: str) -> bool:
    return bool(_ODD.search(piece)) or not (piece.isascii() or unicodedata.is_normalized("NFC", piece))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.marks = {"".join(takewhile(lambda c: not c.isalnum(), t)) for t in added}  # all begin with one, as "<|"
        self.known: dict[str, bytes | None] = {}
        self.model = self.tokenizer.model
        cutting = _settings(self.tokenizer.normalizer), _settings(self.tokenizer.pre_tokenizer)
        self.lower, self.blank = cutting == _CUT_BY_WORDS, _BYTES[32] if cutting == _CUT_BY_BYTES else ""
        self.direct = cutting in (_CUT_BY_WORDS, _CUT_BY_BYTES)
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spelled(self, words: list[str]) -> list[str]:
        """Plain words as the model gets them: in letters for bytes, with the blank before those that start no line."""
        if not words:
            return []
        joined = " ".join(words)
        joined = joined.lower() if self.lower else joined
        if not joined.isascii():
            joined = _UTF_16[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
        if self.blank:
            joined = (self.blank + joined.replace(" ", " " + self.blank)).replace(self.blank + "\n", "")
        else:
            joined = joined.replace("\n", "")
        return joined.split(" ")

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces, each with the blank before it unless it starts a line."""
        if not self.direct or not pieces:
            return self._learn_any(pieces)
        known, column = self.known, pa.array(pieces, pa.large_string())
        plain = pc.match_substring_regex(column, _PLAIN).to_numpy(zero_copy_only=False)
        heads = pc.utf8_rtrim(column, string.punctuation).filter(pa.array(plain)).to_numpy(zero_copy_only=False).tolist()
        fresh = [h for h in dict.fromkeys(heads) if h not in known]
        flat: list[int] = []
        ends = [0]
        model = self.model.tokenize
        for word in self._spelled(fresh):
            flat += [token.id for token in model(word)]
            ends.append(4 * len(flat))
        ids = np.array(flat, "<u4").tobytes()
        known.update(zip(fresh, map(ids.__getitem__, map(slice, ends, ends[1:]))))
        if self.line_end:
            known.update((h, self.line_end + known[h]) for h in fresh if h[0] == "\n")
        tails: dict[str, bytes] = {}
        for piece, head in zip(compress(pieces, plain), heads):
            if len(head) < len(piece):
                tail = piece[len(head) :]
                if tail not in tails:
                    tails[tail] = self._whole(tail)
                known[piece] = known[head] + tails[tail]
        self._learn_any(list(compress(pieces, ~plain)))

    def _learn_any(self, pieces: list[str]) -> None:
        """The same for pieces of all kinds, by the whole of the library. Words
        of letters go through the library many at a time, as they are words to it, too; punctuation
        behind a word is encoded apart from it."""
        known = self.known
        heads: tuple[list[str], list[str]] = ([], [])  # behind a blank, at the start of a line
        split = []
        for piece in pieces:
            if _odd(piece):
                known[piece] = None
            elif piece.isalpha():
                heads[0].append(piece)
            else:
                head = piece.rstrip(string.punctuation)
                starts_line = piece[0] == "\n"
                if not head[starts_line:].isalpha():
                    known[piece] = self._whole(piece if starts_line else " " + piece)
                elif head == piece:
                    heads[1].append(piece)
                else:
                    split.append((piece, head, piece[len(head) :]))
        behind = {head for _, head, _ in split if head not in known}
        heads[0].extend({h for h in behind if h[0] != "\n"}.difference(heads[0]))
        heads[1].extend({h for h in behind if h[0] == "\n"}.difference(heads[1]))
        self._together(heads[0], " ")
        self._together(heads[1], "")
        tails = {tail: self._whole(tail) for tail in {tail for _, _, tail in split}}
        for piece, head, tail in split:
            known[piece] = known[head] + tails[tail]

    def _together(self, heads: list[str], before: str) -> None:
        for i in range(0, len(heads), TOGETHER):
            part = heads[i : i + TOGETHER]
            done = self.tokenizer.encode("".join([before + p for p in part]), add_special_tokens=False)
            words = np.array(done.word_ids, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), len(words)]
            each = (len(cuts) - 1) // len(part)  # a line end may be a word of its own
            if each in (1, 2) and each * len(part) == len(cuts) - 1:
                cuts = cuts[::each]
                flat = np.array(done.ids, "<u4").tobytes()
                self.known.update((p, flat[4 * a : 4 * b]) for p, a, b in zip(part, cuts, cuts[1:]))
            else:
                self.known.update((p, self._whole(before + p)) for p in part)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; of null and empty texts, none."""
        firsts: list[str | None] = []  # the piece that a text begins with; null: not to be cut
        rests: list[str | None] = []
        for text in texts:
            flat = (text or "").replace("\n", " \n")
            simple = flat and flat[0] != " " and flat[-1] not in " \n" and "  " not in flat and "\n " not in flat
            if simple and any(m in flat for m in self.marks):
                simple = not self.added.search(flat)
            first, blank, rest = flat.partition(" ") if simple else (None, "", "")
            firsts.append(first)
            rests.append(rest if blank else None)
        if len(self.known) > REMEMBERED:
            self.known = {p: ids for p, ids in self.known.items() if len(p) <= SHORT}  # the frequent ones
        pieces = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = pieces.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [self.known.get(p, ...) for p in distinct]
        new = [i for i, ids in enumerate(found) if ids is ...]
        self._learn([distinct[i] for i in new])
        for i in new:
            found[i] = self.known[distinct[i]]
        bounds = pieces.offsets.to_numpy()
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        odd = np.diff(np.append(0, np.cumsum(joined.is_null().to_numpy(zero_copy_only=False)))[bounds]) > 0
        cuts = np.frombuffer(joined.buffers()[1], np.int64)[bounds].tolist()
        joined = joined.buffers()[2]
        own: dict[str, bytes | None] = {}
        out = []
        for text, first, is_odd, a, b in zip(texts, firsts, odd, cuts, cuts[1:]):
            if first is not None and first not in own:
                own[first] = None if _odd(first) else self._whole(first)
            if first is None or is_odd or own[first] is None:  # not cut, or with an odd piece
                out.append(self._whole(text) if text else b"")
            else:
                out.append(own[first] + joined.slice(a, b - a).to_pybytes() if a < b else own[first])
        return out


def slices(batch: pa.RecordBatch, column: int, slice_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows of about ``slice_bytes`` of one column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + slice_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(path: str, texts: list[str | None], slice_bytes: int = 1 << 20):
    """Yields the ids of each text, a slice of the texts at a time."""
    own = encoder(path)
    held: list[str | None] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= slice_bytes:
            yield from own.encode(held)
            held, size = [], 0
    yield from own.encode(held)


def forget(path: str) -> None:
    """Let go of what a task has remembered; its worker lives on, and later stages need the memory."""
    own = encoder(path)
    kept = pickle.dumps(dict(islice(((p, ids) for p, ids in own.known.items() if len(p) <= SHORT), KEPT)))
    own.known = {}  # first: what is kept would hold on to the blocks that it shares with the rest
    own.known = pickle.loads(kept)
    pa.default_memory_pool().release_unused()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
