"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``links``
    (columns a, b). Each round links every larger neighbour of a node to its
    smallest one, then every smaller neighbour; the number of rounds grows with
    the logarithm of the component size. A node with many links is handled as
    rows, never as a list, and each round is a stored table."""
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star")
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        large = materialize(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "star")
        small = (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = materialize(small, "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
