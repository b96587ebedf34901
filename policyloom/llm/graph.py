"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every end of an edge ``(a, b)``: label is the smallest id of its component.

    Each round gives every node the smallest label among its neighbours, then follows that label's own label, so that
    chains shrink by half.  Both are aggregates and joins on keys; a node with very many edges is combined in each
    task first.  Every round is written, which bounds the lineage.
    """
    both = materialize(
        edges.where("a != b").select("a", "b").union(edges.where("a != b").select("b", "a")).distinct()
    )
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("jump"))
        moved = materialize(
            lower.join(jump, "next", "left").select("id", F.col("label").alias("old"), F.least("next", "jump").alias("label"))
        )
        labels = moved.select("id", "label")
        if moved.where("old != label").isEmpty():
            return labels
