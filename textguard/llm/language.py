"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean embedding of the hashed 2- to 4-byte grams of its lower-cased words; the mean
goes through a linear layer and a softmax. The model is trained by stochastic gradient descent in
numpy on a bounded sample, its temperature and the bound below which a prediction is rejected are
set on a part of the sample that training has not seen. Embedding and linear layer are multiplied
out once, so that scoring adds up one row of numbers per gram; it is a narrow pass over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: documents per language, and bytes of one document.
PER_LANGUAGE = 500
MAX_BYTES = 20_000
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 4
RATE = 0.5
SEED = 7
#: Share of correct predictions on unseen texts that rejection may cost.
REJECTED = 0.001
#: Share of labels that calibration takes for wrong, so that no score is certain.
SMOOTH = 0.01
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
PART = 1 << 20


def grams(text: str) -> np.ndarray:
    """The buckets of a text's grams. A gram may begin or end with the blank beside a word but
    does not reach over one."""
    flat = b" " + b" ".join(text.lower().encode().translate(_BLANK).split()) + b" "
    out = []
    for at in range(0, len(flat), PART):
        a = np.frombuffer(flat[at : at + PART + 3], np.uint8).astype(np.uint64)
        inner = a != 32
        run = a
        for n in (2, 3, 4):
            if len(a) < n:
                break
            run = (run[:-1] << np.uint64(8)) | a[n - 1 :]
            whole = np.ones(len(run), bool)
            for i in range(1, n - 1):
                whole &= inner[i : i + len(run)]
            if n == 2:
                whole &= inner[:-1] | inner[1:]
            key = (run[whole] + np.uint64(n << 40)) * _MIX
            out.append((key >> np.uint64(49)).astype(np.int64) % BUCKETS)
    return np.concatenate(out) if out else np.empty(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        found = grams(text)
        if not len(found):
            return self.bias
        counts = np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        return (counts[used] @ self.table[used]) / len(found) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the prediction is accepted."""
        if text is None or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def snippets(text: str, rng: np.random.Generator) -> list[str]:
    """The text and two short runs of its words: short texts are learnt, too."""
    words = text.split()
    out = [text]
    for size in (5, 20):
        if len(words) > size:
            at = int(rng.integers(len(words) - size))
            out.append(" ".join(words[at : at + size]))
    return out


def train(rows: list[tuple[str, str]], seed: int = SEED) -> Model:
    """Fit (text, language) rows. No rows give a model without languages, which knows nothing."""
    languages = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), bias)
    learn, check = [], []
    for n, i in enumerate(rng.permutation(len(rows))):
        text, lang = rows[i]
        part = check if n % 5 == 0 and len(rows) >= 50 else learn
        part += [(s, number[lang]) for s in snippets(text, rng)]
    featured = []
    for text, y in learn:
        found, counts = np.unique(grams(text), return_counts=True)
        if len(found):
            featured.append((found, counts / counts.sum(), y))
    steps, done = EPOCHS * len(featured), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(featured)):
            found, share, y = featured[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ embed[found]
            error = softmax(hidden @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error) * WIDTH
            bias -= rate * 0.01 * error
            embed[found] -= rate * WIDTH * np.outer(share, back)
    model = Model(languages, embed @ out, bias)
    if check:
        logits = np.array([model.logits(t) for t, _ in check])
        truth = np.array([y for _, y in check])

        def loss(t: float) -> float:
            logs = np.log(softmax(logits / t) + 1e-12)
            return -((1 - SMOOTH) * logs[np.arange(len(truth)), truth] + SMOOTH * logs.mean(axis=1)).mean()

        model.temperature = float(min(np.geomspace(0.05, 50, 80), key=loss))
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == truth
        if right.any():
            model.least = float(min(0.5, np.quantile(p.max(axis=1)[right], REJECTED)))
    return model


def training_rows(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES) -> list[tuple[str, str]]:
    """A bounded sample by hash of doc_id: about ``per_language`` documents of each language, none
    of more than ``max_bytes``; rows without text or language teach nothing."""
    fit = docs.filter(learn & F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes))
    counts = fit.groupBy("lang").count().collect()
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000))
    share = F.lit(0)
    for row in counts:
        share = F.when(F.col("lang") == row["lang"], int(1_000_000 * per_language / row["count"]) + 1).otherwise(share)
    rows = fit.filter(draw < share).select("text", "lang").limit(2 * per_language * max(1, len(counts))).collect()
    return sorted((r["text"], r["lang"]) for r in rows)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """Learns from the rows of ``docs`` that are not held out."""
    return train(training_rows(docs, ~held_out(F.col("doc_id"), 5, 0)))


NEW = ("lang_pred", "score", "accepted")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and accepted; input columns of these names get a trailing
    underscore. Null texts and texts without a letter are ``und`` with score 0, not accepted.
    Repeated rows come back as often; an empty table gives an empty result."""
    docs = docs.withColumnsRenamed({c: f"{c}_" for c in docs.columns if c in NEW})
    known = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = known.value.predict
        for batch in batches:
            found = [predict(t) for t in batch.column(place).to_pylist()]
            lang, score, ok = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
                [*batch.schema.names, *NEW],
            )

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(True)}).schema
    return docs.mapInArrow(run, schema)
