"""Connected components of an edge table, by hooking to the least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platwork.llm.frames import written


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component, for every node on an edge.

    `edges` has the columns a and b. Every round is written to the shared folder; it ends when
    no label changes. No edges give no rows.
    """
    both = written(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(),
        "component-edges",
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        # Every label's best neighbouring label, then two steps along the labels of labels.
        seen = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        )
        own = labels.join(seen, "node").select("node", "label", F.least("label", "other").alias("best"))
        root = own.groupBy(F.col("label").alias("root")).agg(F.min("best").alias("hook"))
        hooked = own.join(root, F.col("best") == F.col("root"), "left").join(
            root.select(F.col("root").alias("own_root"), F.col("hook").alias("own_hook")), F.col("label") == F.col("own_root"), "left"
        )
        least = F.least("best", F.coalesce("hook", "best"), F.coalesce("own_hook", "best"))
        after = written(hooked.select("node", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
