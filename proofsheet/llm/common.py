"""Helpers that several operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.tables import shared_dir, stored  # noqa: F401  for the operators

#: Key that stands for a null doc_id: it sorts before every other id.
NULL_KEY = -(2**63)
#: Bytes of text in one ordered bucket: as many as these on large input, fewer where that keeps all cores busy.
BUCKET_BYTES, LEAST_BYTES, ROUNDS = 128 << 20, 2 << 20, 6


def own(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns, whatever their names, can't clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about most_bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(batch.column(column).nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
        pa.default_memory_pool().release_unused()  # workers live on beside other jobs


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def order_key(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))


def tie_key(text_col: str = "text") -> Column:
    """Orders rows of equal ids, so that these are spread over buckets, too."""
    return F.xxhash64(text_col)


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """Number of ordered buckets for these texts; it grows with them without end."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(total / BUCKET_BYTES), min(ROUNDS * cores, math.ceil(total / LEAST_BYTES)))


class Buckets:
    """Ordered buckets of rows by (order_key, tie_key), with the highest key of each: two numbers a bucket on the driver."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        ids = docs.select(order_key(id_col).alias("k"), tie_key(text_col).alias("h")).repartitionByRange(buckets_for(docs, text_col), "k", "h")
        rows = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("k", "h")).alias("top")).collect()
        tops = sorted((r.top.k, r.top.h) for r in rows)
        self.k, self.h = np.array([t[0] for t in tops], np.int64), np.array([t[1] for t in tops], np.int64)

    def __len__(self) -> int:
        return len(self.k)

    def places(self, k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each key by binary search, and whether the key is its bucket's highest."""
        at, end = np.searchsorted(self.k, k), np.searchsorted(self.k, k, "right")
        # ids that end a bucket: their ties tell, by binary search again
        low, high = at.copy(), end.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            above = self.h[mid] < h[open_]
            low[open_], high[open_] = np.where(above, mid + 1, low[open_]), np.where(above, high[open_], mid)
        at = low
        here = np.minimum(at, len(self) - 1)
        return here, (self.k[here] == k) & (self.h[here] == h)

    def column(self, k: str = "k", h: str = "h") -> Column:
        """2 * bucket, and one more for a row with its bucket's highest key."""
        shared = self

        @F.pandas_udf("long")
        def of(k: pd.Series, h: pd.Series) -> pd.Series:
            at, top = shared.places(k.to_numpy(), h.to_numpy())
            return pd.Series(2 * at + top)

        return of(k, h)


def by_bucket(df: DataFrame, bucket: str, n: int, *order: str | Column) -> DataFrame:
    """One partition per bucket, sorted inside."""
    return df.repartitionById(max(n, 1), F.col(bucket).cast("int")).sortWithinPartitions(bucket, *order)
