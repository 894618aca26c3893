"""Connected components of an undirected graph given by edges (a long, b long)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """v, label (smallest node of its component), for each node that has an edge.

    Each round takes the smallest label of the neighbours and then the label of the label,
    so that a chain of length n needs about log n rounds.  Rounds are written to the shared
    folder; the driver sees a count only.
    """
    both = saved(edges.where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = held = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        lower = saved(lower, "labels")
        of = lower.select(F.col("v").alias("label"), F.col("label").alias("up"))
        moved = saved(lower.join(of, "label").select("v", "old", F.col("up").alias("label")), "labels")
        changed = moved.where("label <> old").limit(1).count()
        discard(lower)
        discard(held)
        held, labels = moved, moved.select("v", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
