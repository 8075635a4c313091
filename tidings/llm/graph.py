"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.session import pin

# Nodes to look up, of 16 bytes each, that are sent to every executor.
FEW_KNOTS = 1 << 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` that is not the root, its component's least node.

    Large-star and small-star steps (Kiveris et al.) alternate until the edges are stars, and end as
    soon as they are. A step looks up only the nodes that keep them from being stars (``_knots``):
    these are partially aggregated in one shuffle, cached for the step, and broadcast while few; many are
    written, so that both sides of the join are plain shuffles, of which adaptive execution splits a node
    with very many edges. A step makes one edge of each edge and writes them; the last ones are made
    distinct whenever the result is read. Nothing but two numbers per step reaches the driver.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = pin(now.where("u > v").distinct(), "edges")
    large, steps = False, 0
    while True:
        knots = _knots(now).persist()
        try:
            inner, torn = knots.agg(F.count_if("inner"), F.count_if("torn")).first()
            if not inner and not torn:
                stars = now.distinct() if steps else now
                return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
            large = bool(inner) and not (large and torn)
            chosen = knots.where("inner" if large else "torn").select("x", "least")
            # Read back, many are shuffled anew: only then does Spark split the other side.
            many = (inner if large else torn) > FEW_KNOTS
            chosen = pin(chosen, "knots") if many else F.broadcast(chosen)
            now = pin(_large_star(now, chosen) if large else _small_star(now, chosen), "edges")
        finally:
            knots.unpersist()
        steps += 1


def _knots(edges: DataFrame) -> DataFrame:
    """x and its ``least`` neighbour, for the nodes with lesser neighbours that have greater ones as
    well (``inner``) or several lesser ones (``torn``)."""
    below = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    above = edges.select(F.col("v").alias("x"), F.lit(None).cast(edges.schema["v"].dataType).alias("y"))
    nodes = below.unionAll(above).groupBy("x").agg(
        F.min("y").alias("least"),
        F.bool_or(F.col("y").isNull()).alias("inner"),
        (F.min("y") < F.max("y")).alias("torn"),
    )
    return nodes.where("least IS NOT NULL AND (inner OR torn)")


def _large_star(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """Tie the greater neighbours of every node to the least of it and its neighbours."""
    return edges.join(inner, F.col("v") == F.col("x"), "left").select("u", F.coalesce("least", "v").alias("v"))


def _small_star(edges: DataFrame, torn: DataFrame) -> DataFrame:
    """Tie the lesser neighbours of every node, and the node, to the least of them."""
    moved = F.col("v") > F.col("least")
    return edges.join(torn, F.col("u") == F.col("x"), "left").select(
        F.when(moved, F.col("v")).otherwise(F.col("u")).alias("u"),
        F.when(moved, F.col("least")).otherwise(F.col("v")).alias("v"),
    )
