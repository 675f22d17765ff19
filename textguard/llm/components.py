"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import stored


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long) that is not the smallest of its
    component; root is the smallest.

    Every round is two joins of the links with one minimum per node, which is added up before
    the shuffle; the side of a node with very many links is split by adaptive execution. Each
    round is written, so a lost executor costs one round at most. The number of rounds grows
    with the logarithm of the longest chain.
    """
    star = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = stored(links.filter("a <> b").select(*star).distinct(), "links")
    known = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        nearest = _least(large)
        small = (
            large.join(nearest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(nearest.select("u", F.col("m").alias("v"))).distinct()
        )
        links = stored(small, "links")
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).head()
        if now == known:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = now
