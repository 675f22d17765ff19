"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.sources.storage import new_path

SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; of null, no words."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


def private(name: str) -> str:
    """A column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def moved_aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Columns with one of ``names`` get underscores behind theirs until no column has that name."""
    taken, moved = {c.lower() for c in df.columns} | set(names), {}
    for column in df.columns:
        if column.lower() in names:
            other = column + "_"
            while other.lower() in taken:
                other += "_"
            taken.add(other.lower())
            moved[column] = other
    return df.withColumnsRenamed(moved)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and no value is drawn twice."""
    path = new_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
