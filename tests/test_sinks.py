"""Sinks, headers, streams, engines and pictures."""

import json
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofsheet.kernels import geometry as G
from proofsheet.kernels import pictures as P
from proofsheet.operators import images as I
from proofsheet.operators import reading as D
from proofsheet.operators import review as R
from proofsheet.sources import corpus as C
from proofsheet.sources import images as S
from proofsheet.streaming import progress


def test_sizes_from_headers(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + bytes(9) + b"\xff\xdb\x00\x05" + b"\1\2\3" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 600, 800) + bytes(10)
    rows = [("png", P.png(np.zeros((30, 50, 3), np.uint8)), (50, 30)), ("gif", b"GIF89a" + struct.pack("<HH", 320, 200) + bytes(9), (320, 200)), ("bmp", b"BM" + bytes(16) + struct.pack("<ii", 64, 48) + bytes(9), (64, 48)), ("jpeg", jpeg, (800, 600)), ("none", b"text", None), ("empty", b"", None)]
    got = {r.n: r.s for r in spark.createDataFrame([(n, b) for n, b, _ in rows], "n string, b binary").select("n", S.image_size(F.col("b")).alias("s")).collect()}
    assert {n: s and tuple(s) for n, s in got.items()} == {n: s for n, _, s in rows}


def test_tables_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, v string")
    S.save_table(rows, f"{tmp_path}/t", "run_id")
    S.save_table(rows.filter("run_id = 2").withColumn("v", F.lit("c")), f"{tmp_path}/t", "run_id")
    assert {(r.run_id, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "a"), (2, "c")}
    S.save_report(rows, f"{tmp_path}/r")
    (file,) = Path(f"{tmp_path}/r").glob("*.json")
    assert [json.loads(x) for x in file.read_text().splitlines()] == [{"run_id": 1, "v": "a"}, {"run_id": 2, "v": "b"}]


def test_one_run_at_a_time(spark):
    runs = spark.createDataFrame([(1, "COMPLETE"), (2, "FAILED")], "run_id long, status string")
    new = R.started(runs, 3)
    assert {(r.run_id, r.status) for r in new.collect()} == {(1, "COMPLETE"), (2, "FAILED"), (3, "RUNNING")}
    with pytest.raises(RuntimeError):
        R.started(new, 4)
    assert {r.status for r in R.reaped(new).collect()} == {"COMPLETE", "FAILED"}
    with pytest.raises(ValueError):
        R.queue_filter(runs, verdicts=["NO_SUCH"])


def test_labels_by_hand(spark):
    rows = spark.createDataFrame([(1,), (2,)], "product_id int")
    assert [r.label for r in R.labelled(rows, {2: "two"}).orderBy("product_id").collect()] == [None, "two"]
    assert [r.label for r in R.labelled(rows, {}).collect()] == [None, None]


def test_stages_as_a_stream(spark, tmp_path):
    schema = "pair_id string, ordinal int, stage string, status string"
    for i, rows in enumerate([[("a", 1, "hash", "OK"), ("a", 2, "registration", "OK")], [("a", 2, "registration", "OK"), ("b", 1, "hash", "DECIDED"), ("a", 3, "verdict", "OK")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = progress.drained(progress.stages(stream, 3), "stages_shown", "append", f"{tmp_path}/c").collect()
    assert sorted((r.pair_id, r.ordinal, r.finished) for r in got) == [("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 1, False)]


def test_running_counts_and_commits(spark, tmp_path):
    schema = "run_id long, verdict string"
    spark.createDataFrame([(1, "PASS"), (1, "PASS"), (1, "ERROR")], schema).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = progress.drained(progress.counts(stream), "verdict_counts", "complete", f"{tmp_path}/c").collect()
    assert {(r.run_id, r.verdict, r.n) for r in got} == {(1, "PASS", 2), (1, "ERROR", 1)}
    seen = []

    def listener(batch, number):
        seen.append(batch.count())
        raise ValueError("a listener's error is dropped")

    q = progress.committed(stream, f"{tmp_path}/out", f"{tmp_path}/d", "100 milliseconds", listener=listener)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [3] and progress.committed_rows(spark, f"{tmp_path}/out").count() == 3


def test_engines():
    assert D.engine() is D.NULL and D.engine("none") is D.NULL
    D.register("rapid", lambda: D.Engine("rapid", lambda image: [], available=False))
    assert D.engine() is D.NULL
    D.register("paddle", lambda: D.Engine("paddle", lambda image: []))
    assert D.engine().name == "paddle"
    with pytest.raises(KeyError):
        D.engine("missing")
    D._engines.clear()


def test_crops_are_enlarged_with_a_margin():
    crop = np.full((30, 100, 3), 200, np.uint8)
    assert D.prepared(crop, D.Reading()).shape == (90 + 48, 300 + 48, 3) and D.prepared(crop, D.Reading())[0, 0, 0] == 255
    assert D.prepared(np.zeros((10, 3000, 3), np.uint8), D.Reading()).shape[1] == 2400 + 48


def test_one_decoding_node_a_plan(spark):
    """Listings are decoded by one node, and what it gives is stored before anything decides."""
    products = spark.createDataFrame([("p", 1)], "product_id string, seed long")
    versions = I.measured(C.artwork(products, 2, 120), "v")
    regions = I.reference_regions(versions)
    probes = versions.select(F.col("version_id").alias("probe_id"), "product_id", F.lit("x").alias("sha"), "image")
    plan = I.compared(probes, versions, regions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2  # the listings' node, and the regions' below it
    plan = I.identify(probes, versions, regions)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


def test_pictures_of_a_comparison():
    a, b = P.pack(1, 120), P.pack(2, 120)
    board = P.checkerboard(a, b)
    assert (board[:15, :15] == a[:15, :15]).all() and (board[:15, 16:30] == b[:15, 16:30]).all()
    assert (P.heatmap(np.zeros((120, 120)), a) == a).all() and P.heatmap(np.full((120, 120), 9.0), a)[..., 0].mean() > a[..., 0].mean()
    lines = P.match_lines(a, b, np.array([[5, 5]]), np.array([[7, 9]]), np.array([True]))
    assert lines.shape == (120, 240, 3) and (lines[5, 5] == (20, 160, 60)).all() and (lines[9, 127] == (20, 160, 60)).all()
    assert (P.stripped_overlay(a, (10, 10, 50, 50))[10:60, 10:60] == a[10:60, 10:60]).all()
    assert P.magnified(a[:20, :40]).shape == (120, 240, 3)


def test_homography_survives_half_of_outliers():
    r = np.random.default_rng(8)
    true = np.array([[0.9, 0.2, 12], [-0.1, 1.1, -5], [1e-4, -5e-5, 1]])
    src = r.random((120, 2)) * 300
    dst = G.project(true, src)
    dst[:60] = r.random((60, 2)) * 300
    h, inside = G.ransac(src, dst)
    assert inside[60:].all() and G.corner_error(h, true, 300, 300) < 0.01


@pytest.mark.parametrize("angle,scale", [(0, 1), (25, 1), (-60, 0.8), (10, 0.6), (180, 1)])
def test_registration_of_turned_and_scaled_images(angle, scale):
    from proofsheet.config import Pairwise
    from proofsheet.operators.pairs import register

    r = np.random.default_rng(2)
    ref = np.kron(r.integers(40, 220, (40, 40, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    t = np.radians(angle)
    c, s = np.cos(t) * scale, np.sin(t) * scale
    true = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
    true[:2, 2] = 200 - true[:2, :2] @ [160, 160]
    mkt, _ = G.warp(ref, true, 400, 400)
    got, h = register(ref, mkt, Pairwise(), 1)
    assert got["inliers"] >= 15 and G.corner_error(h, true, 320, 320) < 3
    assert abs(got["scale"] - scale) < 0.03 and abs((got["rotation"] - angle + 180) % 360 - 180) < 1.5


def test_exact_percentiles(spark):
    from proofsheet.operators import evaluate as E

    r = np.random.default_rng(0)
    groups = {"a": r.normal(size=3000), "b": np.repeat(r.integers(0, 5, 40), 50).astype(float), "c": np.array([2.5]), None: np.concatenate([np.zeros(500), [1e9]])}
    rows = [(k, float(v), -2 * float(v)) for k, values in groups.items() for v in values] + [("a", None, float("nan")), ("d", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(3)
    shares = [0.0, 0.5, 0.95, 0.999, 1.0]
    wanted = {f"{c}{i}": (c, q) for c in "vw" for i, q in enumerate(shares)}
    got = {row.k: row for row in E.percentiles(df, ["v", "w"], wanted, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert np.allclose([got[k][f"v{i}"] for i in range(5)], np.quantile(values, shares)) and np.allclose([got[k][f"w{i}"] for i in range(5)], np.quantile(-2 * values, shares))
    (whole,) = E.percentiles(df, ["v"], {"p": ("v", 0.3)}).collect()
    assert np.isclose(whole.p, np.quantile(np.concatenate([*groups.values()]), 0.3))
    assert [tuple(row) for row in E.percentiles(df.filter("false"), ["v"], {"p": ("v", 0.5)}).collect()] == [(None,)]
