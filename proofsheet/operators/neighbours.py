"""Nearest neighbours by inverted lists.

Centroids are fitted to a bounded sample; every vector lies in the list of its nearest
centroid. A query first meets the vectors of its own PROBES lists, which bounds how far its
neighbours can be; by the triangle inequality only lists whose ball comes within that bound
can hold nearer ones, and the query meets these, too. So the result is exact whatever the
sample; the index only saves work. Lists are cut into slices of about SLICE vectors, a slice
meets its queries in one task by matrix products, and each task gives its two best only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.tables import stored

#: Vectors that centroids are fitted to, centroids at most, and the rounds of fitting.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 1024, 8
#: Lists that a query meets first, and vectors in a slice of a list.
PROBES, SLICE = 3, 4096
#: Share by which distances by products may be off.
SLACK = 1e-9
FOUND = "q long, neighbour long, distance double"


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fitted(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of a sample of the vectors (vec_id, e), the first of a hash order: about the square root of their number, MOST_LISTS at most."""
    n = vectors.count()
    share = min(1.0, 2 * sample / max(n, 1))
    some = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else vectors
    x = _matrix(some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("e").toArrow()["e"]) if n else np.zeros((0, 1))
    k = min(len(x), MOST_LISTS, lists or max(1, int(n**0.5)))
    centres = x[:: max(1, len(x) // max(k, 1))][:k].copy()
    for _ in range(ROUNDS if k else 0):
        near = _squares(x, centres).argmin(1)
        sums, count = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def listed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, e, list and radius (distance to its centroid) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # MOST_LISTS vectors at most

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _squares(_matrix(batch["e"]), shared.value)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["e"], pa.array(at.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(at)), at]))], names=["vec_id", "e", "list", "radius"])

    return vectors.select("vec_id", "e").mapInArrow(put, "vec_id long, e array<double>, list int, radius double")


def met(vectors: DataFrame, slices: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest in each slice for each query (q, e, list) that asks for it (FOUND).

    vectors: listed ones; slices: list, slices. In a task a slice's vectors come first, then its queries.
    """
    dealt = F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice")
    left = vectors.join(slices, "list").select("list", dealt, F.lit(0).alias("part"), F.col("vec_id").alias("id"), "e")
    right = asked.join(slices, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("part"), F.col("q").alias("id"), "e")

    def best(queries: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        (q, a), (ids, b) = queries, held
        rows = []
        d = _squares(a, b)
        d[q[:, None] == ids[None]] = np.inf
        take = min(k, d.shape[1])
        limit = np.partition(d, take - 1, axis=1)[:, take - 1] if take else np.zeros(len(q))
        for i in range(len(q)):  # products lose digits, so distances of what may be among the best are taken anew
            at = np.flatnonzero((d[i] <= limit[i] + SLACK * (1 + a[i] @ a[i])) & np.isfinite(d[i]))
            exact = np.sqrt(((b[at] - a[i]) ** 2).sum(1))
            for j in np.lexsort((ids[at], exact))[:k]:
                rows.append((q[i], ids[at[j]], exact[j]))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["q", "neighbour", "distance"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch["list"].to_numpy(), batch["slice"].to_numpy(), batch["part"].to_numpy()], 1)
            starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(1)))
            ids, e = batch["id"].to_numpy(), _matrix(batch["e"])
            for s, t in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                if tuple(names[s, :2]) != group:
                    group, held = tuple(names[s, :2]), []
                if names[s, 2] == 0:
                    held.append((ids[s:t], e[s:t]))
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                for at in range(s, t, 256):
                    if held:
                        yield best((ids[at : min(at + 256, t)], e[at : min(at + 256, t)]), held[0])

    both = left.unionByName(right).repartition("list", "slice").sortWithinPartitions("list", "slice", "part")
    return both.mapInArrow(meet, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 2) -> DataFrame:
    """The k nearest vectors of each query, other than itself: q, near (an array of distance and neighbour, in this order).

    vectors and queries: vec_id, e; equal distances go by vec_id. Vectors with the id of the query don't count, others that are
    equal to it do; null vectors are left out.
    """
    spark: SparkSession = vectors.sparkSession
    vectors, queries = (df.select("vec_id", F.col("e").cast("array<double>").alias("e")).filter("vec_id is not null and e is not null") for df in (vectors, queries))
    centres = fitted(vectors)
    if not len(centres):
        return spark.createDataFrame([], "q long, near array<struct<distance:double,neighbour:long>>")
    index = stored(listed(vectors, centres), "index")
    stats = stored(index.groupBy("list").agg(F.count("*").alias("n"), F.max("radius").alias("reach")), "lists")
    slices = stats.select("list", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    reach = np.full(len(centres), -np.inf)
    for r in stats.select("list", "reach").collect():  # MOST_LISTS rows at most
        reach[r.list] = r.reach
    shared = spark.sparkContext.broadcast((centres, reach))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach = shared.value
        for batch in batches:
            if batch.num_rows:
                d = np.where(np.isfinite(reach), _squares(_matrix(batch["e"]), centres), np.inf)
                at = np.argsort(d, axis=1)[:, :PROBES].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["e"], pa.array(list(at), pa.list_(pa.int32()))], names=["q", "e", "probed"])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists beyond the probed ones whose ball comes nearer than the bound."""
        centres, reach = shared.value
        for batch in batches:
            if batch.num_rows:
                e = _matrix(batch["e"])
                bound = batch["bound"].to_numpy(zero_copy_only=False)
                d = np.sqrt(np.where(np.isfinite(reach), _squares(e, centres), np.inf))
                loose = np.sqrt(SLACK) * (1 + np.sqrt((e * e).sum(1)))  # near zero, products lose half of their digits in a root
                open_ = (d - reach <= (np.where(np.isnan(bound), np.inf, bound) + loose)[:, None]) & np.isfinite(reach)
                np.put_along_axis(open_, _matrix(batch["probed"]).astype(np.int64), False, axis=1)
                for at in range(0, len(bound), 64):
                    rows, lists = np.nonzero(open_[at : at + 64])
                    yield pa.RecordBatch.from_arrays([batch["q"].take(pa.array(rows + at)), batch["e"].take(pa.array(rows + at)), pa.array(lists.astype(np.int32))], names=["q", "e", "list"])

    def top(found: DataFrame) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("distance", "neighbour")))  # k rows a slice
        return found.groupBy("q").agg(F.slice(rows, 1, k).alias("near"))

    probing = stored(queries.mapInArrow(first, "q long, e array<double>, probed array<int>"), "queries")
    near = stored(met(index, slices, probing.select("q", "e", F.explode("probed").alias("list")), k), "near")
    bound = top(near).select("q", F.get("near", F.lit(k - 1))["distance"].alias("bound"))
    rest = probing.join(bound, "q", "left").select("q", "e", "probed", "bound").mapInArrow(further, "q long, e array<double>, list int")
    return top(near.unionByName(met(index, slices, rest, k)))


def nearest_two(vectors: DataFrame, queries: DataFrame, ratio: float) -> DataFrame:
    """q, neighbour, distance, distinct_ of each query: whether its nearest vector is nearer than `ratio` times the second."""
    a, b = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    return nearest(vectors, queries).select("q", a["neighbour"].alias("neighbour"), a["distance"].alias("distance"), (a["distance"] < ratio * b["distance"]).alias("distinct_"))
