"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.runtime import materialize

#: Links that a written file holds at most, about.
FILE_LINKS = 200_000


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has that one alone, and that one has none: the components are stars. Added up before the shuffle."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] in (None, False)


def roots(links: DataFrame, a: str = "a", b: str = "b", name: str = "components", most: int = 60) -> DataFrame:
    """(node, root) of every node that has a link to another one; the root is the smallest node of its component.

    A step only ever replaces a link by one that points to a smaller node of the same component; when the components are stars, every
    node points to its root. Minima are aggregated before each shuffle, so a node with very many links costs a row from
    each task; each round is written to the shared folder, so the plan does not grow and a lost executor costs at most a round.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = materialize(edges, name, links.count(), FILE_LINKS)
    for _ in range(most):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.distinct(), name, edges.count(), FILE_LINKS)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
