"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.session import discard, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node it reaches) for every node of an edge.

    Each round points the larger neighbours of a node at its smallest neighbour (large star),
    then the smaller ones (small star), so paths halve and the result is one star per component.
    A node's neighbours are never gathered: their minimum is a map-side aggregate and the edges
    meet it in an equi join, whose skewed keys adaptive execution splits. Every round is a table
    in the shared folder, so a lost executor repeats one round at most. Edges with a null end and
    loops are ignored; repeated edges count once; no edges give no rows.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("two"))
        .where("u IS NOT NULL AND v IS NOT NULL AND two")
        .select("u", "v")
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = stored(large, "large")
        discard(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", "m"))
            .where("u <> v")
            .distinct(),
            "small",
        )
        discard(large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
