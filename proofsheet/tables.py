"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that were named since a scratch began, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir.

    In local mode, where driver and executors are one process, a temporary folder stands in
    for a setting that is missing; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="proofsheet-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for folders in _open[-1:]:
        folders.append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage, survives lost executors, is computed once.

    options are those of the Parquet writer.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within go at the end. Results are lazy: write what is to stay to a folder named before."""
    _open.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _open.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
