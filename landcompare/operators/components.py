"""Connected components by alternating stars, in DataFrame operations only.

Each round hangs every node's larger neighbours on its smallest one (large star),
then the smaller ones (small star); rounds grow with the logarithm of the
diameter, not with the size of a component. A star's centre may be a hot key: its
minimum is combined map-side, and the join's other side has one row per node, so
Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcompare.sources.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of ``edges`` (a, b); the component is its smallest node.

    Loops, repeated edges and edges with a null end are ignored; no edge gives no row.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = stored(links, "components"), None
    while (now := _state(links)) != before:
        before = now
        if now[0]:
            links = stored(_small_star(_large_star(links)), "components")
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
        links.select(F.col("u").alias("x"), F.col("v").alias("y"))
    )
    least = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
    return links.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
