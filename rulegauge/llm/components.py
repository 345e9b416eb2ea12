"""Connected components of an edge table, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegauge.llm.common import scalar, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the root is the smallest node of the component.

    Rounds of two steps: every node sends its larger neighbours, then its smaller ones, to the smallest it knows. They
    end with stars around the roots, after about as many rounds as the logarithm of the longest path. Smallest
    neighbours are aggregates with map-side combining and meet the edges by joins whose crowded keys Spark can split;
    no group is collected. NULL nodes and loops are ignored.
    """
    pairs = stored(_distinct(edges.select("a", "b")), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        larger = both.filter("b > a").join(stored(least, "least"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(_distinct(larger), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = stored(down.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(_distinct(small.unionByName(low.select("a", F.col("m").alias("b")))), "edges")
        same = scalar(_sums(pairs)) == scalar(_sums(after))
        pairs = after
        if same:
            break
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _sums(pairs: DataFrame) -> DataFrame:
    mixed = F.xxhash64("a", "b")
    return pairs.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(mixed.cast("decimal(20,0)")))
