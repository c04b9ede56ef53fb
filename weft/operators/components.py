"""Connected components of an undirected graph, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id that each node of `edges` reaches.

    Each round joins a node to the least label among its neighbours and then jumps to that label's own label, so the
    number of rounds grows with the logarithm of the longest chain. A hub only meets partial minima, and no list of
    neighbours is ever collected. Self-loops and repeated edges are allowed; rows with a null end are ignored.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = materialize(both.union(both.select("v", "u")).distinct())
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # hooking: whatever a member of a class has seen holds for the class's root as well
        hook = step.groupBy(F.col("old").alias("u")).agg(F.min("label").alias("hooked"))
        step = step.join(hook.withColumnRenamed("u", "old"), "old", "left").select(
            "u", "old", F.least("label", F.coalesce("hooked", "label")).alias("label")
        )
        roots = step.select(F.col("u").alias("label"), F.col("label").alias("up"))
        after = materialize(
            step.join(roots, "label", "left").select("u", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        )
        moved = after.where("old <> label").limit(1).count()
        labels = after.select("u", "label")
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
