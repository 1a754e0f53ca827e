"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (x, y); component: the smallest reachable node.

    Every round takes the smallest label around each node, then the label of
    the label, so long chains shrink by more than half; stops when a round changes
    nothing.  Labels are a written table each round (short lineage).
    """
    both = links.select(F.col("x").alias("a"), F.col("y").alias("b")) \
                .union(links.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
    both = C.materialize(both, "cc_links")
    labels = C.materialize(both.groupBy(F.col("a").alias("node"))
                           .agg(F.least(F.min("b"), F.col("node")).alias("component")), "cc_labels")
    while True:  # labels only ever fall, so it ends
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")) \
                     .agg(F.min("component").alias("c"))
        near = labels.join(around, F.col("node") == F.col("n")) \
                     .select("node", F.least("component", "c").alias("c1"), F.col("component").alias("was"))
        of = labels.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = C.materialize(near.join(of, F.col("c1") == F.col("n2"), "left")
                            .select("node", F.least("c1", F.coalesce("c2", "c1")).alias("component"), "was"), "cc_labels")
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            return labels
