"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Where it is unset, scratch goes below the warehouse, which every executor can reach too.
    """
    known = spark.conf.get(CHECKPOINT_CONF, None)
    if not known:
        known = f"{spark.conf.get('spark.sql.warehouse.dir')}/textguard-scratch"
        spark.conf.set(CHECKPOINT_CONF, known)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and fixes values that
    differ between evaluations, such as nonces.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_path`` named, on whatever store it is."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """The intermediate tables behind one result. Results are read lazily, so whoever has used one
    for the last time discards them; nothing else removes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As ``write_once``, remembered."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *problem: object) -> None:
        self.discard()
