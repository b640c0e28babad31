"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, written


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; label is the least node reachable.

    Each round takes the least label among the neighbours (an aggregate with map-side
    combine, so a hub is no hot task) and then the label of that label, which halves the
    longest path; the rounds follow the logarithm of a component's diameter. Each round's
    labels are written to the shared folder. An empty edge table gives an empty result;
    edges with a null end and self loops add nothing.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = written(
            step.join(jump, F.col("next") == F.col("at")).select("node", F.col("label").alias("old"), F.least("next", "further").alias("label")),
            "cc-labels",
        )
        release(labels)
        labels = moved.select("node", "label")
        labels._scratch_path = moved._scratch_path
        if moved.where("old <> label").isEmpty():
            release(both)
            return labels
