"""Connected components of a large graph as DataFrame rounds."""

from pyspark.sql import DataFrame, functions as F

from reviewmill.llm.common import materialise


def _edges(df: DataFrame) -> DataFrame:
    """Each edge once, from its larger node to its smaller one."""
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node reachable.

    Alternating large-star and small-star rounds: every node hands the smallest node
    of its neighbourhood to its larger neighbours, then to its smaller ones. The number
    of edges never grows, minima are combined before the shuffle, and a round is a
    written table. It ends when a round changes nothing, after about log(n) rounds.
    """
    edges = materialise(_edges(links), "components")
    before, now = None, _state(edges)
    while now[0] and now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        edges = materialise(_edges(small), "components")
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
