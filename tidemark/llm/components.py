"""Connected components of an edge list, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``edges`` (columns ``a, b``); the label is the component's least node.

    Each round takes the least label among a node and its neighbours and then the label of that label, so the rounds
    grow with the logarithm of a component's diameter.  A round is two joins and grouped minima (combined
    before the shuffle) and ends in a stored table, so a lost executor costs one round at most.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = stored(step.join(jump, "low").select("node", F.least("low", "next").alias("new"),
                                                   (F.least("low", "next") < F.col("label")).alias("changed")), "labels")
        labels = new.select("node", F.col("new").alias("label"))
        if new.where("changed").isEmpty():
            return labels
