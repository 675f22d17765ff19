"""A corpus pipeline of five stages: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import language, packing, simhash, substrings, tiling
from textguard.llm.common import stored, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the documents not held out."""
    model = language.fitted(table(spark, sf_dir, "documents"))
    return language.identified(docs, model).filter("accepted").drop(*language.NEW)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.deduplicated(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that an earlier one has. Texts in which
    nothing repeats stay as they are; where all words go, the document goes."""
    found = substrings.deduplicated(docs)
    changed = F.col("n_removed") > 0
    return found.filter((F.col("n_removed") < F.col("n_words")) | ~changed).select(*[
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text") if c == "text"
        else F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(c)
        for c in docs.columns
    ])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to a half or more."""
    return tiling.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
