"""Connected components of a link table by smallest label, with pointer jumping; each step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable from each node of the links. Links of a node with itself give that node.

    A node with many links and a label with many nodes are joined as heavy keys.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a)))
    edges = stage(both.distinct(), "links")
    labels = stage(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label"), F.count("*").alias("n")), "labels")
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("label").alias("near"), "n")
        seen = join_counted(edges, known, ["other"]).groupBy("node").agg(F.min("near").alias("near"))
        stepped = stage(labels.join(seen, "node").select("node", "label", "n", F.least("label", "near").alias("next")), "steps")
        # jump: a node takes the label of its label
        asked = stepped.groupBy("next").agg(F.count("*").alias("asked"))
        jumps = labels.select(F.col("node").alias("next"), F.col("label").alias("far")).join(asked, "next").select("next", "far", F.col("asked").alias("n"))
        far = F.least("next", F.coalesce("far", "next")).alias("next")
        after = stage(join_counted(stepped.withColumnRenamed("n", "links"), jumps, ["next"], "left").select("node", "label", F.col("links").alias("n"), far), "labels")
        moved = not after.where("label <> next").isEmpty()
        labels = after.select("node", F.col("next").alias("label"), "n")
        if not moved:
            return labels.select("node", "label")
