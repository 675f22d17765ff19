"""The pipeline stage by stage on a small corpus with known cases."""

import random
from collections import defaultdict

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    english = ["the", "of", "and", "thing", "which", "water", "house", "great", "under", "never"]
    german = ["der", "und", "nicht", "wasser", "haus", "grosse", "unter", "immer", "zeit", "schule"]
    text = lambda pool, n: " ".join(rng.choice(pool) + rng.choice(["", "s", "er", "en", "ing"]) + rng.choice("abcdefghijklm") + rng.choice("nopqrstuvw") for _ in range(n))
    rows = [(d, text(english if d % 3 else german, 150), "en" if d % 3 else "de") for d in range(120)]
    body = dict((d, t) for d, t, _ in rows)
    item = text(english, 40)
    passage = text(english, 60)
    special = [
        (200, body[1], "en"), (201, body[1].replace(" ", "  ").title(), "en"), (202, None, "en"), (203, "12345 $$$", "en"),
        (204, f"{text(english, 80)} {item} {text(english, 30)}", "en"),
        (205, f"{text(english, 80)} {passage}", "en"), (206, f"{passage} {text(english, 90)}", "en"),
    ]
    rows += special
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.stored(stage(spark, df, str(tmp_path)), "stage")
        assert df.columns == docs.columns
        kept[name] = {r.doc_id: r for r in df.collect()}
    everything = {d for d, _, _ in rows}
    assert set(kept["language ID"]) == everything - {202, 203}
    assert set(kept["SimHash near-dedup"]) == everything - {200, 201, 202, 203}
    after = kept["substring dedup"]
    assert set(after) == everything - {200, 201, 202, 203}
    assert passage in after[205].text and passage not in after[206].text
    assert after[206].n_chars == len(after[206].text) and after[5].text == body[5]
    assert set(kept["benchmark decontamination"]) == everything - {200, 201, 202, 203, 204}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total, seen = {}, defaultdict(int)
    for r in pieces:
        total[r.doc_id] = r.doc_tokens
        seen[r.doc_id] += r.length
    assert total == dict(seen) and set(total) == set(kept["benchmark decontamination"])


def test_registered():
    import __spark_entry__

    assert {"pipeline", *(n for n in __spark_entry__.queries() if n.startswith("op"))} >= {"pipeline"}
    assert sorted(int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if n.startswith("op")) == list(range(1, 14))
