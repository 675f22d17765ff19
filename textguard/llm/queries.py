"""The registered queries of these operators, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import (
    language, ngram_join, packing, planes, prefix_trie, quality_model, quality_rules, sharding, simhash, source_audit, substrings, tiling, warc,
)
from textguard.llm.common import stored, table
from textguard.sources.storage import new_path


def op1_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "llm-archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.parsed(warc.read_archive(spark, path))


def op2_bk_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "llm-planes")
    planes.write_planes(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    found = planes.read_documents(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return planes.with_starts(found, spark, path)


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substrings.deduplicated(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fitted(docs)
    found = language.identified(docs.select("doc_id", "text"), model)
    held = language.held_out(F.col("doc_id"), 5, 0)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality_model.statistics(table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    held = language.held_out(F.col("doc_id"), 4, 2)
    model = quality_model.train(*quality_model.training_rows(stats, table(spark, sf_dir, "labels"), ~held))
    scored = stats.select("doc_id", held.alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, release=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.write_shards(table(spark, sf_dir, "documents"), new_path(spark, "llm-shards"))
    return written.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audited(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_content_archive, op2_bk_simhash, op3_byte_planes, op4_string_tiling, op5_suffix_trees,
        op6_subword_language, op7_rule_ensemble, op8_least_squares_packing, op9_quality_rules, op10_external_shuffle,
        op11_ngram_join, op12_source_audit, op13_prefix_trie,
    )
}
ORACLE = {
    "op1_content_archive": warc.SQL, "op5_suffix_trees": substrings.SQL, "op9_quality_rules": quality_rules.SQL,
    "op11_ngram_join": ngram_join.SQL, "op12_source_audit": source_audit.SQL, "op13_prefix_trie": prefix_trie.SQL,
}
