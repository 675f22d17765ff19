"""Inputs of the registered queries: the same rows, in tasks that do not grow with the tables."""

from pyspark.sql import functions as F

from textguard.plans import inputs


def test_notes_of_one_file_are_dealt_out(spark, tmp_path):
    keys = spark.range(25_000).select(F.col("id").alias("c_custkey"))
    more = spark.createDataFrame([(None,), (7,)], "c_custkey bigint")
    keys.unionByName(more).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    parts = spark.conf.get(inputs.PARTITIONS)
    spark.conf.unset(inputs.PARTITIONS)
    try:
        notes = inputs.notes(spark, str(tmp_path))
        shares = [r["count"] for r in notes.groupBy(F.spark_partition_id()).count().collect()]
        few = notes.groupBy("request_id").count().filter("count > 1").collect()
    finally:
        spark.conf.set(inputs.PARTITIONS, parts)
    assert sum(shares) == 25_002 and max(shares) <= inputs.NOTES_PER_TASK
    assert [(r["request_id"], r["count"]) for r in few] == [("note-7", 2)]
