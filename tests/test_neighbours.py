import numpy as np
import pytest

from proofsheet.operators import neighbours as N

SCHEMA = "vec_id long, e array<double>"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(3)


def brute(ids, x, qids, q, k):
    out = {}
    for i, v in zip(qids, q, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), round(float(d[j]), 9)) for j in order]
    return out


def got(rows):
    return {r.q: [(n.neighbour, round(n.distance, 9)) for n in r.near] for r in rows.collect()}


@pytest.mark.parametrize(("slice_", "k"), [(4096, 2), (30, 3)])
def test_nearest_is_exact(spark, monkeypatch, slice_, k):
    monkeypatch.setattr(N, "SLICE", slice_)
    r = np.random.default_rng(1)
    # clusters, a third of all rows equal, and far points
    x = np.concatenate([c + r.normal(scale=0.05, size=(60, 8)) for c in r.normal(size=(5, 8))] + [np.ones((150, 8)), r.normal(size=(20, 8)) * 100])
    ids = r.permutation(10 * len(x))[: len(x)]
    q = np.concatenate([x[::7], r.normal(size=(10, 8)), np.zeros((1, 8))])
    qids = np.concatenate([ids[::7], 100_000 + np.arange(11)])
    assert got(N.nearest(frame(spark, ids, x), frame(spark, qids, q), k)) == brute(ids, x, qids, q, k)


def test_few_vectors(spark):
    x = np.array([[0.0, 0.0], [3.0, 4.0]])
    two = frame(spark, [1, 2], x)
    assert got(N.nearest(two, two)) == {1: [(2, 5.0)], 2: [(1, 5.0)]}
    (row,) = N.nearest_two(two, two.filter("vec_id = 1"), 0.8).collect()
    assert (row.neighbour, row.distance, row.distinct_) == (2, 5.0, None)
    assert N.nearest(two.filter("false"), two).count() == 0 and N.nearest(two, two.filter("false")).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 1.0]), (5, None), (6, [0.0, 1.0])], SCHEMA)
    assert got(N.nearest(two.unionByName(nulls), nulls)) == {6: [(1, 1.0), (2, round(18**0.5, 9))]}


def test_no_nested_loop(spark):
    plan = N.nearest_two(frame(spark, range(60), np.random.default_rng(2).normal(size=(60, 4))), frame(spark, [1], np.zeros((1, 4))), 0.8)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
