"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.tables import stored


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of edges (a, b), of any type that has an order: label is the least id of its component.

    Each round takes the least label among a node's neighbours and then that label's own, so paths halve.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
    while True:
        labels = stored(labels, "labels")
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = stored(labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("new")), "hooked")
        up = hooked.select(F.col("id").alias("up"), F.col("new").alias("top"))
        jumped = stored(hooked.join(up, F.col("new") == F.col("up"), "left").select("id", "label", F.least("new", F.coalesce("top", "new")).alias("new")), "jumped")
        if not jumped.filter("new <> label").limit(1).count():
            return labels
        labels = jumped.select("id", F.col("new").alias("label"))
