"""Connected components of a stored edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumstead.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    # A sum of 128-bit numbers doesn't overflow and tells two edge sets apart.
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) as (b, least of a and its neighbours)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a")


def roots(edges: DataFrame) -> DataFrame:
    """``node`` and its ``root``, the least node of its component, for nodes with edges but not for roots.

    ``edges`` has columns a and b.  Neighbours are never gathered: each step is
    a minimum per node, combined before it is shuffled, joined back.  Steps are
    written tables; their number grows with the logarithm of the longest path.
    """
    edges = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        starred = _star(large)
        small = starred.select(F.col("b").alias("a"), F.col("m").alias("b")).union(starred.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.where("a <> b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
