"""Connected components of an edge table, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on (u, v) edges; returns edges (u, v) with v < u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; component is its least node.

    Alternating large-star and small-star until the edges stay the same.
    Every step is a grouped minimum and an equi-join, so no neighbourhood is
    collected; each round's edges are written to the shared folder. Null ends
    and loops are ignored; repeated edges count once; no edges give an empty
    result. Raises if `rounds` don't suffice rather than returning a part.
    """
    now = written(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = tuple(state)
        now = written(_star(_star(now, large=True), large=False))
    raise RuntimeError(f"components did not settle within {rounds} rounds")
