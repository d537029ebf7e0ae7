"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.skew import HOT_ROWS, hot_keys, spread_join
from newsloom.session import cut_lineage_measured


def _spread_join(edges: DataFrame, right: DataFrame, key: str, how: str, rows: int, min_rows: int) -> DataFrame:
    # Fewer rows than a hot key has need no count.
    hot = hot_keys(edges, [key], min_rows) if rows >= min_rows else {}
    return spread_join(edges, right, [key], how, ["a", "b"], hot=hot)


def _least(edges: DataFrame) -> DataFrame:
    """The least node that each node has an edge to."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root): for every node that is not the least of its component, that least node.

    ``edges`` has two BIGINTs ``a`` > ``b`` per row. Each round hangs every node below the least node that its parents know of (large star),
    then all parents of a node below the least of them (small star), which keeps components together and takes about the logarithm of
    the size of the largest one in rounds. A round is two aggregates that combine on the map side and two joins of their results, spread where a node has very
    many edges: a star of any size is never gathered. It is over when a round changes nothing.
    """
    edges, before = cut_lineage_measured(edges.distinct(), F.count("*"), F.sum(F.xxhash64("a", "b") % 2**31))
    while before[0]:
        rows = before[0]
        parents = _least(edges).select(F.col("a").alias("b"), F.col("m"))
        large = _spread_join(edges, parents, "b", "left", rows, min_rows)
        large = large.select("a", F.coalesce("m", "b").alias("b"))
        least = _least(large)
        small = _spread_join(large, least, "a", "inner", rows, min_rows)
        pairs = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = small.select(F.explode(pairs).alias("e")).select("e.*").where("a <> b").distinct()
        edges, after = cut_lineage_measured(small, F.count("*"), F.sum(F.xxhash64("a", "b") % 2**31))
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
