"""Connected components of a graph given by its links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(smallest, "u").filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(smallest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(smallest.select("u", "m")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node in ``links`` (u, v), the component named by its smallest node.

    Alternating large and small stars (O(log^2) rounds, in practice three to
    five). A round shuffles links by node with combined minima, and is written
    to the shared folder, so a lost executor costs one round's partitions. A hot
    node's links can be split by the adaptive skew join. Self links are allowed,
    null ends are dropped, an empty table gives an empty result.
    """
    edges = freeze(links.select("u", "v").filter("u != v").distinct(), label)

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = None
    while (now := state(edges)) != before:
        before = now
        edges = freeze(_small_star(_large_star(edges)), label)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
