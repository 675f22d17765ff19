"""Quality rules beside their SQL and beside loops; the classifier on held-out labels."""

from collections import Counter

import duckdb
import numpy as np

from textguard.llm import quality_model, quality_rules
from textguard.llm.quality_rules import bucket, least_value
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ROWS = [
    (1, None, "en", "s"), (2, "", "en", None), (3, " \t\n ", None, "s"), (4, "a b c a b c a b c", "en", "s"),
    (5, "a a a a\nx\nx\n\nx \n y # $", "en", "s"), (6, LONG, "en", "s"), (7, LONG, "en", "s"), (7, LONG, "en", "s"),
    (None, "one two three four", "en", "s"), (9, "é ß\x0bü\x0cñ\r\nx y", "de", "t"), (10, "a b c x a b c", None, None),
    (11, "a b", "en", "s"), (12, "a b c", "en", "s"),
]


def counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    held = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held)


def test_counts_and_verdicts(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, lang string, source string, n_words string")
    got = quality_rules.apply_rules(df).collect()
    assert sorted(((r.doc_id, *r[1:6]) for r in got), key=str) == sorted(((d, *counts(t)) for d, t, _, _ in ROWS), key=str)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", ROWS)
    assert sorted(map(tuple, got), key=str) == sorted(db.execute(quality_rules.SQL).fetchall(), key=str)
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_sketch_buckets(spark):
    values = [*range(300), 999, 1023, 1024, 10**6, 2**40 + 12345]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", bucket(F.col("v")).alias("b"))
    for r in df.select("v", "b", least_value(F.col("b")).alias("low")).collect():
        assert r.low <= r.v and (r.v - r.low) * 32 <= r.v and (r.v >= 64 or r.low == r.v)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    plan = quality_rules.apply_rules(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_classifier_on_held_out_labels(spark):
    from textguard.llm.queries import QUERIES

    got = QUERIES["op7_rule_ensemble"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_compiled_rules_score_like_their_weights(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality_model.FEATURES)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] <= 0.7) | (x[:, 0] > 0.9)).astype(float)
    model = quality_model.train(x, y)
    names = quality_model.FEATURES
    columns = dict(zip(names, x.T))
    total = model.bias + sum(w * np.logical_and.reduce([c.holds(columns) for c in r]) for r, w in zip(model.rules, model.weights))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = np.array([r.s for r in df.select("i", model.column().alias("s")).orderBy("i").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == (y == 1)).mean() > 0.97
    assert 0 < len(model.rules) < 150


def test_classifier_on_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in ROWS], "doc_id long, text string, lang string, source string, mean_word double")
    stats = quality_model.statistics(df, ["doc_id"])
    labels = spark.createDataFrame([(1, 1, "a"), (2, None, "b")], "doc_id long, quality int, text string")
    model = quality_model.train(*quality_model.training_rows(stats, labels, F.lit(True)))
    scores = stats.select(model.column().alias("s")).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.s <= 1 for r in scores)
    none = quality_model.train(*quality_model.training_rows(stats, labels.limit(0), F.lit(True)))
    assert stats.limit(0).select(none.column().alias("s")).count() == 0


def test_few_and_equal_rows_give_the_share(spark):
    width = len(quality_model.FEATURES)
    rng = np.random.default_rng(2)
    for n in (2, 10, 39, 60):
        y = (np.arange(n) % 2).astype(float)
        for x in (rng.random((n, width)), np.ones((n, width)), np.zeros((n, width))):
            model = quality_model.train(x, y)
            df = spark.createDataFrame([tuple(map(float, x[0]))], ", ".join(f"{f} double" for f in quality_model.FEATURES))
            score = df.select(model.column().alias("s")).head().s
            assert 0 <= score <= 1 and (model.rules or abs(score - y.mean()) < 1e-9)


def test_sample_is_the_first_by_hash(spark):
    rows = [(d, *[float(d)] * len(quality_model.FEATURES)) for d in range(300)]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{f} double" for f in quality_model.FEATURES))
    labels = spark.createDataFrame([(d, d % 2) for d in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    order = [r.doc_id for r in stats.orderBy(F.xxhash64(F.lit(quality_model.SEED), "doc_id")).select("doc_id").collect()]
    for sample in (20, 150, 1000):
        x, y = quality_model.training_rows(stats, labels, F.lit(True), sample)
        assert x[:, 0].tolist() == order[:sample] and y.tolist() == [d % 2 for d in order[:sample]]
