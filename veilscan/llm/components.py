"""Connected components of an edge table, as joins that Spark shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``a``, ``b``); the label is the smallest node reachable.

    Alternates two contractions until nothing changes: every node's larger neighbours are tied to its smallest
    neighbour, then its smaller ones. Each round is written to the shared folder; a node's neighbours are
    never gathered, only their minimum is taken.
    """
    pairs = written(
        edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = written(large, "edges")
        # every node now has smaller neighbours on one side only
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b")
        after = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").unionByName(small.select(F.col("m").alias("a"), "b"))
        after = written(after.distinct(), "edges")
        if _same(pairs, after):
            return after.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
                after.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
            )
        pairs = after


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two sets of pairs are equal, by count and an order-free sum."""

    def facts(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    return facts(x) == facts(y)
