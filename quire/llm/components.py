"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quire.session import materialize

ROUNDS = 64


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the smallest of its neighbourhood."""
    links = both_ways(edges)
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        links.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        .union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    )


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node of links(a, b) the smallest node it is linked to.

    a and b are longs; self links are ignored and no links give no rows.  Each round
    is written to the shared folder and read back, so plans stay short and a lost
    executor costs no earlier round.  Only a count and a checksum of each round come
    to the driver.  The number of rounds grows with the logarithm of the number of
    nodes; more than ROUNDS is an error, never a partial answer.
    """
    edges = materialize(
        links.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(ROUNDS):
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state[0] == 0 or state == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        seen = state
        edges = materialize(small_star(large_star(edges).distinct()).distinct(), "links")
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")
