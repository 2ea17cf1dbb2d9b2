"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id of edges (a, b): label is the least id of its component.

    A round takes the least label among a node and its neighbours and then the label's own
    label, so long chains halve; each round is a table in the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels.id == near.a).select("id", "label", F.least("label", "m").alias("new"))
        hooked = stored(hooked, "labels")
        up = hooked.select(F.col("id").alias("up"), F.col("new").alias("top"))
        jumped = stored(hooked.join(up, hooked.new == up.up, "left").select("id", "label", F.least("new", F.coalesce("top", "new")).alias("new")), "labels")
        changed = jumped.filter("new <> label").limit(1).count()
        labels = jumped.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
