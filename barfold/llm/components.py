"""Connected components by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barfold.llm.common import stored


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge: the smallest node it can reach.

    Each round hangs the neighbours of a node under their smallest member, first
    the larger ones, then the smaller ones. Only minima are aggregated and joined
    back, so a node with very many edges never becomes one list. Every round is
    stored; the number of rounds grows with the logarithm of the longest chain.
    Edges with a null end and loops are ignored; no edges give no rows.
    """
    now = stored(_downward(edges.select(F.col(left).alias("a"), F.col(right).alias("b"))), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = _downward(
            both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stored(_downward(small.unionByName(lowest.select("a", F.col("low").alias("b")))), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _downward(edges: DataFrame) -> DataFrame:
    high, low = F.greatest("a", "b"), F.least("a", "b")
    kept = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return kept.select(high.alias("a"), low.alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(hash(b, a))")).first())
