"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.plans.storage import kept


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or the node itself). The least ones are
    written before they are joined, so that a node with very many links splits like any skewed join."""
    both = edges.select(F.col("small").alias("node"), F.col("big").alias("other")).unionByName(edges.select(F.col("big").alias("node"), F.col("small").alias("other")))
    least = kept(both.groupBy("node").agg(F.min("other").alias("least")))
    return edges.join(least, F.col("small") == F.col("node")).select("big", F.least("small", "least").alias("small"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("big").agg(F.min("small").alias("least"))
    tied = edges.join(least, "big").where(F.col("small") > F.col("least")).select(F.col("small").alias("big"), F.col("least").alias("small"))
    return tied.unionByName(least.select("big", F.col("least").alias("small")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node is tied to one smaller node, and none of those is tied itself."""
    ends = edges.select(F.col("big").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("small", F.lit(0), F.lit(1)).toDF("node", "up", "down"))
    ties = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ties.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of `edges`, but roots themselves; root is the least node that links reach.

    Edges may repeat, run either way or be loops; those with a null end are left out. Rounds, each of which ends in a
    written table, grow with the logarithm of the longest path; they end when all that is left are stars. Only whether
    they are reaches the driver.
    """
    now = edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("big") > F.col("small")))
    now = kept(now.distinct())
    while not _stars(now):
        now = kept(_small(_large(now).distinct()).distinct())
    return now.select(F.col("big").alias("node"), F.col("small").alias("root"))
