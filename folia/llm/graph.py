"""Connected components by minimum labels with pointer jumping, as Spark joins; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v), long, in any order, repeats allowed: one row (node, label) per node, label its component's least node.

    Each round takes the least label among a node's neighbours and then the label of that label, so paths
    shorten by half; a round's labels are cut off through the shared folder. No edges give no rows.
    """
    both = cut(edges.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        after = cut(stepped.join(jump, "at").select("node", "before", F.least("at", "next").alias("label")))
        labels = after.drop("before")
        if after.where("label <> before").isEmpty():
            return labels
