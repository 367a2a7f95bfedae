"""Connected components of a link table by labels that run to the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import discard, materialize, scratch_path


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; the root is the smallest node reachable.

    A round gives every node the smallest root among its neighbours, the root it had the smallest root that any
    of its nodes met, and then every node the root of its root. Whole groups so join at once, and a chain of
    1,000 nodes in any tested order settles in some ten rounds. Roots only fall, so the rounds end by
    themselves. Every round is written to the shared folder, so neither lineage nor executors' memory carries
    it, and the round before is deleted. No node's neighbours are ever gathered: they meet in a minimum with a
    map-side part. Empty links give no rows.
    """
    spark = links.sparkSession
    both = links.where("a != b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    path = scratch_path(spark, "labels")
    start = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = materialize(start.select("node", F.least("node", "least").alias("root")), "labels", path)
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("near_node"))
            .agg(F.min("root").alias("near_root"))
        )
        lower = labels.join(near, F.col("node") == F.col("near_node")).select(
            "node", F.col("root").alias("old"), F.least("root", "near_root").alias("new")
        )
        # One row for the node itself and one for the root it had; only the first brings the old root.
        met = lower.groupBy(F.col("old").alias("node")).agg(F.min("new").alias("new"))
        hooks = lower.unionByName(met, allowMissingColumns=True)
        hooked = hooks.groupBy("node").agg(F.max("old").alias("old"), F.min("new").alias("new"))
        above = labels.select(F.col("node").alias("above"), F.col("root").alias("above_root"))
        stepped = hooked.join(above, F.col("new") == F.col("above")).select(
            "node", F.least("new", "above_root").alias("root"), (F.col("old") != F.least("new", "above_root")).alias("moved")
        )
        next_path = scratch_path(spark, "labels")
        stepped = materialize(stepped, "labels", next_path)
        moved = stepped.where("moved").limit(1).count()
        discard(spark, path)
        labels, path = stepped.select("node", "root"), next_path
        if not moved:
            return labels
