"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazelark.llm.tables import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id in edges (a, b); loops are fine.

    A round moves each label to the least one next to it and then to that one's own label, so
    chains shorten by half or more. Only the number of labels that moved reaches the driver.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        told = both.join(labels, both["a"] == labels["id"]).groupBy("b").agg(F.min("component").alias("near"))
        lower = labels.join(told, labels["id"] == told["b"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        own = labels.select(F.col("id").alias("of"), F.col("component").alias("further"))
        jumped = lower.join(own, lower["component"] == own["of"]).select("id", "old", F.least("component", "further").alias("component"))
        jumped = checkpointed(jumped)
        labels = jumped.select("id", "component")
        if jumped.where("component <> old").isEmpty():
            return labels
