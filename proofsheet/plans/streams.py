"""Queries over streams: the driver's tables, written as files and read as streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.streaming import progress as P
from proofsheet.tables import shared_dir

from .registry import query


def as_stream(rows: DataFrame, name: str, files: int) -> DataFrame:
    """rows as a stream of `files` batches."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("""SELECT pair_id, ordinal AS place, ordinal, stage, ordinal >= 7 AS finished, false AS late FROM (
  SELECT concat('u', user_id) AS pair_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ordinal, event_type AS stage FROM events)""")
def stage_stream(t):
    """Stages of each user's pair that come in any order, some twice, go out once and in order; all have come at the end, so none is given up by the clock."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.select(F.concat(F.lit("u"), "user_id").alias("pair_id"), F.row_number().over(w).alias("ordinal"), F.col("event_type").alias("stage"), F.lit("OK").alias("status"), "event_id")
    twice = rows.withColumn("copy", F.explode(F.expr("IF(stage = 'error', array(0, 1), array(0))")))
    mixed = twice.repartition(12, F.xxhash64("event_id", "copy")).drop("event_id", "copy")
    n = t.events.count()
    stream = P.stages(as_stream(mixed, "stages", 4), wait=None, blocks=max(1024, n // 4096))
    shown = P.drained(stream, f"stages_{uuid4().hex}", "append", shared_dir(t.spark, "progress"), max(t.spark.sparkContext.defaultParallelism, n // 250_000))
    return shown.select("pair_id", "place", "ordinal", "stage", "finished", "late")


@query("SELECT event_id, event_type FROM events")
def committed_stream(t):
    """A stream committed in batches, each once although all of them come twice."""
    stream = as_stream(t.events.select("event_id", "event_type").repartition(6), "events", 2)
    path = shared_dir(t.spark, "committed")
    for _ in range(2):  # the second time without the first one's progress
        q = P.committed(stream, path, shared_dir(t.spark, "progress"), "0 seconds", most_rows=100_000)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return P.committed_rows(t.spark, path)
