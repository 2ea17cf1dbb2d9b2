import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofsheet import config
from proofsheet.functions import text as X
from proofsheet.kernels import compare as K
from proofsheet.kernels import geometry as G
from proofsheet.kernels import regions as R


NORMAL = [("450 mg", "450mg"), ("450mg", "450mg"), ("450 MG", "450mg"), ("450 gm", "450g"), ("450 grams", "450g"), ("12 Kcal", "12kcal"), ("12 calories", "12kcal"), ("450.0", "450"), (".5", "0.5"), ("0,5", "0.5"), ("1,250", "1250"), ("４５０ｍｇ", "450mg"), ("", ""), (None, ""), ("5 µg", "5ug")]
NORMAL += [("(net) 12.50 g.", "net 12.5g"), ("5 g g", "5g g"), ("mg 5", "mg 5"), ("-3 ,", "-3 ,"), ("a–b  c\u00a0d", "a-b c d"), ("1234567.5 0.00001234 123456.7", "1.23457e+06 1.234e-05 123457"), ("l", "l"), ("litre", "l"), ("+,5%", "0.5%"), ("STRASSE straße", "strasse strasse")]


def columns(spark, rows, schema, **exprs):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).withColumns(exprs).orderBy("i").collect()


def test_numbers_are_rounded_as_binary(spark):
    r = np.random.default_rng(0)
    values = [round(float(x), d) for x, d in zip(10 ** r.uniform(-4, 6, 3000), r.integers(1, 9, 3000), strict=True)]
    values = [v for v in values if v >= 1e-4 and v != int(v)] + [58706.35, 95640.25, 999999.5, 0.1234565, 2.000005, 123456.5]
    got = columns(spark, [(np.format_float_positional(v),) for v in values], "t string", n=X.normalized(F.col("t")))
    assert [r.n for r in got] == [f"{v:g}" for v in values]


def test_normalize(spark):
    got = columns(spark, [(r,) for r, _ in NORMAL], "t string", n=F.coalesce(X.normalized(F.col("t")), F.lit("")))
    assert [(r.t, r.n) for r in got] == NORMAL


CONFUSED = [("450", "45O", True), ("1l", "11", True), ("5S", "55", True), ("rnodern", "modern", True), ("450", "480", False), ("380", "480", False), ("a", "a", False), ("O0", "0O", False), ("", "a", False)]
STUTTERED = [("cocoa", "cocooa", True), ("aab", "aaab", True), ("ab", "abb", True), ("ab", "aab", True), ("ab", "abc", False), ("ab", "ab", False), ("", "a", False), ("abc", "axbc", False), ("abab", "abaab", True)]


def test_misread_phrases(spark):
    got = columns(spark, CONFUSED + STUTTERED, "a string, b string, want boolean", c=X.confusable(F.col("a"), F.col("b")), s=X.stuttered(F.col("a"), F.col("b")), t=X.stuttered(F.col("b"), F.col("a")))
    assert [r.c for r in got[: len(CONFUSED)]] == [x[2] for x in CONFUSED]
    assert [bool(r.s) for r in got[len(CONFUSED) :]] == [bool(r.t) for r in got[len(CONFUSED) :]] == [x[2] for x in STUTTERED]


COMPARED = [
    ("sodium 450 mg", "sodium 480 mg", "NUMBER_CHANGED", "MATERIAL"),
    ("sodium 450 mg", "sodium 450.0 mg", "NO_DIFFERENCE", "NONE"),
    ("protein 12 g", "protein 12 gm", "NO_DIFFERENCE", "NONE"),
    ("sodium 450 mg", "sodium 450 g", "NUMBER_AND_UNIT_CHANGED", "MATERIAL"),
    ("sodium 450 mg", "sodium 480 g", "NUMBER_AND_UNIT_CHANGED", "MATERIAL"),
    ("sodium 450 mg", "sodium 45O mg", "CONFUSABLE_CHARACTERS", "UNCERTAIN"),
    ("no added sugar", "no sugar", "TEXT_REMOVED", "MATERIAL"),
    ("no sugar", "no added sugar", "TEXT_ADDED", "MATERIAL"),
    ("added sugar", "added suga r", "NO_DIFFERENCE", "NONE"),
    ("coffee cocoa", "coffee cocooa", "CONFUSABLE_CHARACTERS", "UNCERTAIN"),
    ("high protein , vegan", "high protein ; vegan", "PUNCTUATION_ONLY", "COSMETIC"),
    ("high protein , vegan", "high protein vegan", "PUNCTUATION_ONLY", "COSMETIC"),
    ("red wine", "blue wine", "TEXT_CHANGED", "MATERIAL"),
    ("a , b c", "a ; b d", "TEXT_CHANGED", "MATERIAL"),
    ("", "", "NO_DIFFERENCE", "NONE"),
    (None, "new", "TEXT_ADDED", "MATERIAL"),
]


def test_compare(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(COMPARED)], "i int, a string, b string, kind string, severity string")
    got = X.with_comparison(df, "a", "b").orderBy("i").collect()
    assert [(r.comparison.kind, r.comparison.severity) for r in got] == [r[2:] for r in COMPARED]
    assert [(d.kind, d.old, d.new) for d in got[13].comparison.differences] == [("PUNCTUATION_ONLY", ",", ";"), ("TEXT_CHANGED", "c", "d")]


def test_quantities(spark):
    got = columns(spark, [("480mg",), ("480",), ("protein",), ("1,5 GRAMS",), ("1,250 µg".replace("µ", "μ"),), ("",), (None,)], "t string", q=X.quantity(F.col("t")))
    assert [r.q and tuple(r.q) for r in got] == [(480, "mg"), (480, ""), None, (1.5, "g"), (1250, "ug"), None, None]


def plain_word_diff(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(("equal", x[i]))
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or best[i + 1][j] >= best[i][j + 1]):
            out.append(("delete", x[i]))
            i += 1
        else:
            out.append(("insert", y[j]))
            j += 1
    return out


def test_word_diff(monkeypatch):
    assert X.word_diff("a b c", "a x c d") == [{"tag": "equal", "words": "a"}, {"tag": "delete", "words": "b"}, {"tag": "insert", "words": "x"}, {"tag": "equal", "words": "c"}, {"tag": "insert", "words": "d"}]
    r = np.random.default_rng(0)
    for rows in (1, 3, 7, 1024):
        monkeypatch.setattr(X, "KEPT_ROWS", rows)
        for _ in range(40):
            x, y = (["abcd"[k] for k in r.integers(0, 4, r.integers(0, 25))] for _ in range(2))
            got = [(run["tag"], w) for run in X.word_diff(" ".join(x), " ".join(y)) for w in run["words"].split()]
            assert got == plain_word_diff(x, y)


def test_word_diff_of_long_texts():
    words = [f"w{i}" for i in np.random.default_rng(1).integers(0, 500, 12_000)]
    edited = words[:4000] + ["x"] + words[4001:]
    got = X.word_diff(" ".join(words), " ".join(edited))
    assert [(r["tag"], len(r["words"].split())) for r in got] == [("equal", 4000), ("delete", 1), ("insert", 1), ("equal", 7999)]


def test_natural_key(spark):
    names = ["v2", "v10", "v010a", "a", "v99999999999999", "v100000000000000", "V1b", "v1"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "v1", "V1b", "v2", "v10", "v010a", "v99999999999999", "v100000000000000"]


def test_components_equal_flood_fill():
    r = np.random.default_rng(0)
    for _ in range(30):
        m = (r.random((r.integers(1, 14), r.integers(1, 14))) < 0.4).astype(np.uint8)
        got, seen = R.components(m), {}
        for y, x in zip(*np.nonzero(m), strict=True):
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p, q = y + dy, x + dx
                    if 0 <= p < m.shape[0] and 0 <= q < m.shape[1] and m[p, q]:
                        assert got[y, x] == got[p, q]
            seen.setdefault(got[y, x], []).append((y, x))
        for places in seen.values():  # each label is connected
            todo, left = [places[0]], set(places[1:])
            while todo:
                y, x = todo.pop()
                near = {p for p in left if abs(p[0] - y) <= 1 and abs(p[1] - x) <= 1}
                left -= near
                todo += near
            assert not left


def grid(seed=0, n=240):
    img = np.full((n, n, 3), 200, np.uint8)
    img[::4], img[:, ::9] = 60, 90
    img[60:100, 60:100] = np.random.default_rng(seed).integers(0, 255, (40, 40, 3))
    return img


def test_border_and_resize():
    img = np.full((300, 320, 3), 255, np.uint8)
    img[30:270, 40:280] = np.random.default_rng(1).integers(0, 255, (240, 240, 3))
    x, y, w, h = G.content_rect(img)
    assert abs(x - 40) < 1 and abs(y - 30) < 1 and abs(w - 240) < 1.5 and abs(h - 240) < 1.5
    small = G.resize_area(img, 160, 150)
    assert small.shape == (150, 160, 3) and np.allclose(small[100, 10], 255)
    assert (G.resize_area(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), 2, 2).ravel() == np.rint([2.5, 4.5, 10.5, 12.5])).all()


def test_translation_and_shift():
    g = np.random.default_rng(2).random((120, 140)).astype(np.float32)
    moved = G.shift(g[..., None], 5, -3)[..., 0]
    assert G.translation(g, moved) == (5, -3)


def test_score_and_signal():
    a, b = grid(), grid()
    assert K.score(a, b, 32, 14).max() == 0
    b[20:40, 150:190] = 0
    s = K.score(a, b, 32, 14)
    mask = K.changed(s)
    (x, y, w, h, _), *rest = R.boxes(R.closed(mask, (25, 25)), 100)
    assert not rest and abs(x - 150) <= 3 and abs(y - 20) <= 3 and K.signal(s, (150, 20, 40, 20)) == pytest.approx(3)
    assert K.signal(s, (0, 0, 0, 0)) == 0 and K.dissimilarity(a[..., 0], a[..., 0]).max() < 1e-9


def test_homography():
    h = np.array([[1.02, 0.05, 4], [-0.04, 0.98, 7], [1e-5, 2e-5, 1]])
    r = np.random.default_rng(4)
    src = r.random((80, 2)) * 200
    dst = G.project(h, src)
    dst[:20] += r.random((20, 2)) * 90 + 20
    got, inside = G.ransac(src, dst)
    assert inside[20:].all() and np.allclose(got, h, atol=1e-6)


def image_row(img):
    return {"height": img.shape[0], "width": img.shape[1], "nChannels": 3, "data": img[:, :, ::-1].tobytes()}


def textured(seed=0, n=320):
    r = np.random.default_rng(seed)
    img = np.kron(r.integers(40, 220, (n // 8, n // 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    return np.clip(img + r.integers(-6, 6, img.shape), 0, 255).astype(np.uint8)


def test_pairs(spark):
    from pyspark.sql import types as T

    from proofsheet.operators import pairs as P

    ref = textured()
    edited = ref.copy()
    edited[120:160, 96:216] = 255 - edited[120:160, 96:216]
    noisy = np.clip(ref.astype(int) + np.random.default_rng(1).integers(-3, 4, ref.shape), 0, 255).astype(np.uint8)
    img = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("nChannels", T.IntegerType()), T.StructField("data", T.BinaryType())])
    schema = T.StructType([T.StructField("pair_id", T.StringType()), T.StructField("ref", img), T.StructField("mkt", img), T.StructField("ref_sha", T.StringType()), T.StructField("mkt_sha", T.StringType())])
    rows = [("same", ref, ref, "a", "a"), ("noisy", ref, noisy, "a", "b"), ("edited", ref, edited, "a", "c"), ("other", ref, textured(9), "a", "d")]
    df = spark.createDataFrame([(p, image_row(a), image_row(b), s, t) for p, a, b, s, t in rows], schema)
    verdicts, regions = P.compared(df)
    got = {r.pair_id: r for r in verdicts.collect()}
    assert {k: v.verdict for k, v in got.items()} == {"same": "IDENTICAL", "noisy": "MATCH", "edited": "NEEDS_REVIEW", "other": "CANNOT_COMPARE"}
    (box,) = [r for r in regions.collect() if r.pair_id == "edited"]
    assert abs(box.x - 96) < 16 and abs(box.y - 120) < 16 and abs(box.w - 120) < 32
    read = spark.createDataFrame([("edited", 1, "sodium 450 mg", "sodium 480 mg", True)], "pair_id string, ordinal int, ref_text string, mkt_text string, reliable boolean")
    again = {r.pair_id: r.verdict for r in P.compared(df, read)[0].collect()}
    assert again["edited"] == "DIFFERENT"
    # contents and keypoints are kept: a second run adds nothing and says the same
    from proofsheet.sources.versioned import Store
    from proofsheet.tables import shared_dir

    store = Store(spark, shared_dir(spark, "images"), parts=4)
    for _ in range(2):
        found = {r.pair_id: r.verdict for r in P.compared(df.filter("pair_id <> 'other'"), store=store)[0].collect()}
        assert found == {"same": "IDENTICAL", "noisy": "MATCH", "edited": "NEEDS_REVIEW"} and store.head()[0] == 2
    from proofsheet.operators.pairs import STAGES

    status = {k: [(t.stage, t.status) for t in v.trace] for k, v in got.items()}
    assert all([s for s, _ in x] == STAGES for x in status.values())
    assert [s for _, s in status["other"]] == ["OK", "OK", "HALTED", "SKIPPED", "SKIPPED", "SKIPPED", "OK"]
    assert [s for _, s in status["same"]] == ["SKIPPED", "DECIDED", "SKIPPED", "SKIPPED", "SKIPPED", "SKIPPED", "OK"]
    assert [s for _, s in status["edited"]] == ["OK", "OK", "OK", "OK", "DEGRADED", "OK", "OK"] and got["edited"].trace[2].metrics["inliers"] >= 15
    assert got["noisy"].trace[3].note == "no region differs"


def test_config():
    flat = config.to_flat(config.Identify()) | {"unknown": 3, "luma_threshold": 89.0}
    assert config.to_flat(config.from_flat(config.Identify, flat)) == flat
    with pytest.raises(TypeError):
        config.from_flat(config.Identify, {"luma_threshold": True})
    with pytest.raises(ValueError):
        config.from_flat(config.Pairwise, {"ssim_threshold": 0})
    assert config.frozen(config.Identify()) == config.frozen(config.from_flat(config.Identify, {}))


def test_margin(spark):
    from pyspark.sql import functions as F

    from proofsheet.functions import verdict as V

    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.05), (1.0, 2.0), (2.0, 0.0)], "best double, runner double")
    got = rows.select(V.margin_gate("best", "runner", 1.12).alias("g"), F.round(V.margin_confidence("best", "runner"), 6).alias("c")).collect()
    assert [r.g for r in got] == [False, True, False, True, False]  # a tie at zero is refused
    assert [r.c for r in got] == [1.0, 1.0, 0.047619, 0.5, 0.5]


def test_sources(spark, tmp_path):
    import json

    from proofsheet.sources import images as S

    def bmp(path, img):
        h, w = img.shape[:2]
        rows = b"".join(img[y, :, ::-1].tobytes() + b"\0" * (-w * 3 % 4) for y in reversed(range(h)))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24) + rows)

    for label in ("v1", "v2", "v10"):
        bmp(tmp_path / "ref/SKU1" / f"{label}.bmp", textured(len(label), 24))
    listed = S.files(spark, str(tmp_path / "ref"))
    got = {r.version_label: (r.position, r.is_current) for r in S.artwork_versions(listed).collect()}
    assert got == {"v1": (1, False), "v2": (2, False), "v10": (3, True)}
    (row,) = S.pixels(spark, str(tmp_path / "ref/SKU1/v1.bmp")).collect()
    i = row.image
    assert (G.to_rgb(i.height, i.width, i.nChannels, bytes(i.data)) == textured(2, 24)).all()
    bmp(tmp_path / "scraped/SKU1__a.bmp", textured(0, 24))
    bmp(tmp_path / "scraped/b.bmp", textured(0, 24))
    manifest = spark.createDataFrame([("b.bmp", "SKU9")], S.MANIFEST)
    assert {r.name: r.product_id for r in S.run_inputs(S.files(spark, str(tmp_path / "scraped")), manifest).collect()} == {"SKU1__a.bmp": "SKU1", "b.bmp": "SKU9"}
    (tmp_path / "t.json").write_text(json.dumps({"SKU1": {"versions": ["v1", "v2"], "current": "v2", "files": {"v1": "a"}, "transitions": {"v1->v2": [{"type": "CLAIM_REMOVED", "box": [1, 2, 3, 4], "severity": "MATERIAL"}]}}}))
    (truth,) = S.ground_truth(spark, str(tmp_path / "t.json")).collect()
    assert truth.current == "v2" and truth.transitions["v1->v2"][0].box == [1, 2, 3, 4]
    from pyspark.sql import functions as F

    urls = spark.createDataFrame([("/data/a/b.png",), ("/other/x",)], "p string").select(S.served_url(F.col("p"), {"/data": "/files"}).alias("u")).collect()
    assert [r.u for r in urls] == ["/files/a/b.png", None]
    f = spark.createDataFrame([(1, 10), (2, 20)], "run_id int, finding_id int")
    S.save_findings(f, str(tmp_path / "out"))
    S.save_findings(f.filter("run_id = 2").withColumn("finding_id", F.lit(21)), str(tmp_path / "out"))
    assert {(r.run_id, r.finding_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 10), (2, 21)}


def test_streams(spark, tmp_path):
    from proofsheet.streaming import progress as S

    for i, rows in enumerate([[("a", "x", 1), ("b", "x", 1)], [("a", "x", 1), ("b", "y", 1), ("c", "z", 2)], [("a", "x", 2)]]):
        spark.createDataFrame(rows, "path string, sha string, version long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, sha string, version long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = S.drained(S.changes(stream), "changes", "append", str(tmp_path / "cp")).collect()
    assert sorted((r.path, r.status) for r in got) == [("a", "CACHED"), ("a", "CHANGED"), ("a", "NEW"), ("b", "CHANGED"), ("b", "NEW"), ("c", "NEW")]


def test_small_kernels():
    a = grid()
    b = a.copy()
    b[30:40, 50:70] = 0
    assert R.truth_box(a, b) == (50, 30, 20, 10) and R.truth_box(a, a) is None
    assert G.reading_crop(a, (100, 100, 40, 20)).shape == (20 + 2 * 7, 40 + 2 * 30, 3)
    assert G.reading_scale(np.zeros((50, 100, 3))) == 3.0 and G.reading_scale(np.zeros((400, 10, 3))) == 1.0
    assert G.stripped_share((100, 100), (90, 100)) == pytest.approx(0.1)
    s = K.score(b, a, 32, 14)
    assert K.region_changed(s, (50, 30, 20, 10)) > 0.3 and K.region_changed(s, (0, 0, 0, 0)) == 0


def test_settings_files(tmp_path):
    p = tmp_path / "c.json"
    assert config.load(str(p), config.Identify) == config.Identify()
    p.write_text('{"morph_open": 5, "x": 1}')
    s = config.load(str(p), config.Identify)
    assert s.morph_open == 5 and s.extra == {"x": 1}
    assert config.to_flat(config.edited(s, {"morph_open": 7}))["calibrated"] is False
    with pytest.raises(KeyError):
        config.edited(s, {"no_such": 1})


def test_acknowledgement_cycle(spark):
    from pyspark.sql import functions as F

    from proofsheet.operators import review as W

    regions = spark.createDataFrame([(1, 7, 1, 11, 20, 30, 40, "a"), (1, 7, 1, 200, 20, 30, 40, None), (2, 7, 1, 14, 22, 31, 41, "a"), (4, 7, 2, 11, 20, 30, 40, "a")], "finding_id long, product_id long, version_id long, x long, y long, w long, h long, field_key string")
    findings = spark.createDataFrame([(1,), (2,), (3,), (4,)], "finding_id long")
    none = spark.createDataFrame([], "product_id long, signature string, version_id long, decision string, note string, created_by string")
    pick = lambda *i: findings.filter(F.col("finding_id").isin(*i))
    acks = W.acknowledged(none, regions, pick(1, 3))
    assert acks.count() == 2

    def state(acks):
        marked = W.signed(regions).join(acks.filter("decision = 'ACKNOWLEDGED'").withColumn("ok", F.lit(True)), ["product_id", "signature", "version_id"], "left")
        return {r.finding_id: r.s for r in marked.groupBy("finding_id").agg(F.every(F.coalesce("ok", F.lit(False))).alias("s")).collect()}

    assert state(acks) == {1: True, 2: True, 4: False}  # a few pixels of jitter keep the sign-off, a new version ends it
    assert state(W.acknowledged(acks, regions, pick(2), "ESCALATED")) == {1: False, 2: False, 4: False}
    assert state(W.unacknowledged(acks, regions, pick(1)))[1] is False
    with pytest.raises(ValueError):
        W.acknowledged(acks, regions, findings, "MAYBE")
    runs = spark.createDataFrame([(1, "RUNNING"), (2, "RUNNING"), (3, "COMPLETE")], "run_id int, status string")
    assert [r.status for r in W.reaped(runs, [2]).orderBy("run_id").collect()] == ["FAILED", "RUNNING", "COMPLETE"]
    up = spark.createDataFrame([("a.png", 5), ("b.txt", 5), ("c.JPG", 0), ("d.png", 1 << 30)], "name string, length long")
    assert [r.refused for r in W.upload_checks(up).collect()] == [None, "suffix", "empty", "too large"]
    pre = spark.createDataFrame([(1, 100, 100, 0, 0, 100, 100), (1, 100, 100, 0, 0, 100, 80), (1, 90, 90, 0, 0, 90, 90)], "product_id int, width int, height int, x int, y int, w int, h int")
    assert sorted((round(r.cropped, 2), r.much_border, r.mixed_sizes) for r in W.preflight(pre).collect()) == [(0.0, False, True), (0.0, False, True), (0.2, True, True)]


def test_overrides(spark):
    import datetime

    from proofsheet.sources import images as S

    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    v = spark.createDataFrame([("A", "v1", 1, False, at), ("A", "v2", 2, True, at), ("B", "x", 1, True, at)], "product_id string, version_label string, position int, is_current boolean, modified timestamp")
    t = {r.product_id: r for r in S.versions_template(v).collect()}
    assert t["A"].versions == ["v1", "v2"] and t["A"].current == "v2" and t["A"].approved_at["v1"] == "2024-01-02T03:04:05"
    o = spark.createDataFrame([("A", ["v2", "v1"], "v1")], "product_id string, versions array<string>, current string")
    got = {(r.product_id, r.version_label): (r.position, r.is_current) for r in S.overridden(v, o).collect()}
    assert got == {("A", "v2"): (1, False), ("A", "v1"): (2, True), ("B", "x"): (1, True)}


def test_boxes_as_large_at_one_place_are_kept_alike(spark):
    from proofsheet.config import Pairwise
    from proofsheet.operators import pairs as PA

    rows = [(1, 5, 5, w, 60 // w, 60 / 100.0) for w in (30, 2, 20, 6, 3, 10)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "pair_id int, x int, y int, w int, h int, area_fraction double").coalesce(1)
        assert sorted(r.w for r in PA.largest(df, "pair_id", Pairwise(max_regions=2)).collect()) == [2, 3]


def test_pairs_that_come_often_are_compared_once(spark):
    rows = [(i, *COMPARED[i % len(COMPARED)][:2]) for i in range(300)] + [(300, None, None), (301, "a", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(3)
    seen = []

    def compare(d, a, b):
        seen.append(d.count())
        return X.with_comparison(d, a, b, "c").withColumn("runs", X.diff_words(a, b))

    got = X.once(df, "a", "b", compare).orderBy("i").collect()
    want = X.with_comparison(df, "a", "b", "c").withColumn("runs", X.diff_words("a", "b")).orderBy("i").collect()
    assert got == want and len(got) == 302 and seen == [len({(a or "", b or "") for _, a, b in rows})]


def test_a_batch_is_taken_out_a_few_rows_at_a_time(monkeypatch):
    import pyarrow as pa

    held = []
    monkeypatch.setattr(X, "AT_ONCE", 3)
    column = pa.array([None if i == 4 else f"w{i}" for i in range(8)])
    got = X._each(lambda t: held.append(t) or t, pa.string(), column)
    assert got == column and len(held) == 8 and X._each(str, pa.string(), column.slice(0, 0)).to_pylist() == []


def test_nearest_by_blocks_is_what_the_pairs_say(spark, monkeypatch):
    from proofsheet.operators import identify as D

    r = random.Random(8)
    vec = lambda: [round(r.random(), 1) for _ in range(6)]
    probes = spark.createDataFrame([(i, r.randrange(3), vec()) for i in range(90)] + [(90, 7, vec())], "probe_id long, product_id int, vec array<double>")
    some = [(i, r.randrange(3), str(i % 35), vec()) for i in range(40)] + [(50, 7, "x", vec())]
    candidates = spark.createDataFrame(some, "candidate_id long, product_id int, sha string, ref array<double>")
    compared = D.fractions(probes, candidates, 0.15)
    monkeypatch.setattr(D, "BLOCK", 5)
    near = D.nearest(probes, candidates, 0.15, 0.4)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(D.clean_one(near)) == rows(D.whole_image(compared, 0.4)) and D.clean_one(near).count() > 5
    assert rows(D.leading(near, 1.02)) == rows(D.ranked(compared.withColumnRenamed("fraction", "total"), 1.02)) and D.leading(near, 1.02).count() > 5
    both = probes.select("product_id", "probe_id", "vec")  # both sides of one table
    assert D.nearest(both, both.select("product_id", F.col("probe_id").alias("candidate_id"), F.col("probe_id").cast("string").alias("sha"), F.col("vec").alias("ref")), 0.15, 0.4).filter("best = 0").count() == 91
    assert near.count() == 91 and D.nearest(probes, candidates.filter("false"), 0.15, 0.4).count() == 0
