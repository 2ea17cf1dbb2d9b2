"""Registration and identification of rendered packs, with accuracy against exact labels."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from proofsheet.config import Identify
from proofsheet.kernels import pictures as P
from proofsheet.operators import evaluate as E
from proofsheet.operators import images as I
from proofsheet.operators import stages

IMAGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("height", "width", "nChannels")] + [T.StructField("data", T.BinaryType())])


def row(img):
    return (img.shape[0], img.shape[1], 3, np.ascontiguousarray(img[:, :, ::-1]).tobytes())


def sha(img):
    return hashlib.sha256(img.tobytes()).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark):
    versions, edits, probes, truth, vid, pid = [], [], [], {}, 0, 0
    for p in range(4):
        img = P.pack(p)
        line = []
        for v in range(3):
            if v:
                img = img.copy()
                b = P.field(img, (p + v) % 6, 1000 * p + v)
                edits.append((f"SKU{p}", vid - 1, vid, 0, *b, f"field_{(p + v) % 6}", "a", "b", "NUMERIC_DRIFT", "MATERIAL"))
            versions.append((f"SKU{p}", vid, sha(img), row(img)))
            line.append((vid, img))
            vid += 1
        for v, ref in line:
            for kind in ("copy", "noise", "padded", "small"):
                from proofsheet.kernels.geometry import resize_area

                x = {"copy": ref, "noise": P.noisy(ref, pid), "padded": P.padded(P.noisy(ref, pid)), "small": resize_area(P.noisy(ref, pid), 200, 200)}[kind]
                probes.append((pid, f"SKU{p}", sha(x), row(x)))
                truth[pid] = v
                pid += 1
    probes.append((pid, "SKU0", "broken", (10, 10, 3, b"short")))
    probes.append((pid + 1, "SKU1", "stranger", row(P.pack(99))))
    v = spark.createDataFrame(versions, T.StructType([T.StructField("product_id", T.StringType()), T.StructField("version_id", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("image", IMAGE)]))
    q = spark.createDataFrame(probes, T.StructType([T.StructField("probe_id", T.LongType()), T.StructField("product_id", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("image", IMAGE)]))
    e = spark.createDataFrame(edits, "product_id string, from_id long, to_id long, edit_pos int, x int, y int, w int, h int, field_key string, old_value string, new_value string, edit_type string, severity string")
    return v, q, e, truth


def test_reference_regions(corpus):
    v, _, e, _ = corpus
    found = I.with_edits(I.reference_regions(v), e).collect()
    assert {(r.product_id, r.from_id, r.to_id) for r in found} == {(r.product_id, r.from_id, r.to_id) for r in e.collect()}
    assert all(r.field_key and r.edit_type == "NUMERIC_DRIFT" for r in found)


def test_identify(corpus):
    v, q, e, truth = corpus
    got = {r.probe_id: r for r in I.identify(q, v, I.reference_regions(v), Identify(clean_fraction=0.002)).collect()}
    assert len(got) == len(truth) + 2
    right = sum(got[p].matched_id == t for p, t in truth.items())
    wrong = sum(got[p].matched_id not in (t, None) for p, t in truth.items())
    assert wrong == 0 and right / len(truth) >= 0.9
    assert got[max(truth) + 1].method == "ERROR" and got[max(truth) + 2].matched_id is None
    assert {got[p].method for p in truth} >= {"HASH_EXACT"}


def test_calibration(spark, corpus):
    ref, r = P.pack(3), []
    edited = ref.copy()
    b = P.field(edited, 2, 77)
    r = [(0, row(P.noisy(edited, 1)), row(ref), [list(b)]), (1, row(P.noisy(ref, 2)), row(ref), None)]
    pairs = spark.createDataFrame(r, T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("probe", IMAGE), T.StructField("reference", IMAGE), T.StructField("boxes", T.ArrayType(T.ArrayType(T.IntegerType())))]))
    (t,) = E.noise_thresholds(I.noise_samples(pairs), "luma", "changed").collect()
    assert 0 < t.threshold < 40 and t.margin > 50


def test_pictures(spark, tmp_path):
    img = P.pack(1)
    path = tmp_path / "a.png"
    path.write_bytes(P.png(img))
    from proofsheet.kernels.geometry import to_rgb
    from proofsheet.sources.images import pixels

    (r,) = pixels(spark, str(path)).collect()
    assert (to_rgb(r.image.height, r.image.width, r.image.nChannels, bytes(r.image.data)) == img).all()
    path = tmp_path / "b.jpg"
    path.write_bytes(P.overlay(img, [{"x": 10, "y": 20, "w": 30, "h": 40, "colour": "red"}]))
    (r,) = pixels(spark, str(path)).collect()
    assert np.abs(to_rgb(r.image.height, r.image.width, r.image.nChannels, bytes(r.image.data))[20, 10].astype(int) - P.COLOURS["red"]).max() < 60
    assert P.thumbnail(np.zeros((640, 320, 3), np.uint8))[:2] == b"\xff\xd8"


def test_registry(spark):
    probes = spark.range(3).withColumnRenamed("id", "probe_id")
    out = stages.cascade(probes, ["photograph_fallback"]).collect()
    assert {r.method for r in out} == {"NONE"} and len(out) == 3
    with pytest.raises(ValueError):
        stages.register("photograph_fallback")(lambda: None)
    with pytest.raises(KeyError):
        stages.build("no such stage")


def test_artefacts_of_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    from proofsheet.sources import corpus as C
    from proofsheet.sources.images import image_size
    from proofsheet.sources.versioned import Store

    products = spark.createDataFrame([("p", 1), ("q", 2)], "product_id string, seed long")
    drawn = I.thumbnails(C.artwork(products, 2, 120), 60)
    store = Store(spark, f"{tmp_path}/store", parts=4)
    I.save_artefacts(store, drawn, 1)
    I.save_artefacts(store, drawn.filter("path like 'thumbs/p/%'"), 2)
    rows = store.read("artefacts").select("run_id", "path", image_size(F.col("picture")).alias("s")).collect()
    assert sorted(r.run_id for r in rows) == [1] * 4 + [2] * 2 and all(r.path.startswith("thumbs/") and (r.s.width, r.s.height) == (60, 60) for r in rows)
