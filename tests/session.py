"""A local session for tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def make_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textguard-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.textguard.input.partitions", str(cores))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="textguard-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def at() -> Column:
    """2024-01-01 00:00:00 UTC."""
    return F.timestamp_seconds(F.lit(1_704_067_200))
