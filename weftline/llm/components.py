"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def components(pairs: DataFrame) -> DataFrame:
    """(fid, label) for every endpoint of pairs (a, b); label is the smallest id of its component.

    Each round takes the smallest label of a node and its neighbours and then the label's own label, so the number of
    rounds grows with the logarithm of the longest path. Every round is checkpointed in the shared folder. No pairs
    give no rows; repeated pairs and loops change nothing.
    """
    edges = pairs.select(F.col("a").alias("fid"), F.col("b").alias("to")).union(pairs.select(F.col("b").alias("fid"), F.col("a").alias("to")))
    labels = edges.groupBy("fid").agg(F.least(F.min("to"), F.col("fid")).alias("label"))
    labels = cut(labels)
    while True:
        near = edges.join(labels.select(F.col("fid").alias("to"), F.col("label").alias("l")), "to").groupBy("fid").agg(F.min("l").alias("l"))
        best = labels.join(near, "fid", "left").select("fid", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = labels.select(F.col("fid").alias("label"), F.col("label").alias("up"))
        step = cut(best.join(jump, "label", "left").select("fid", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = step.filter("label <> old").limit(1).count()
        labels = step.select("fid", "label")
        if not changed:
            return labels
