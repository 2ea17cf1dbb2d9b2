"""Pairwise comparison of images: hash, registration, differences, reading, verdict.

Stages are tables: contents and keypoints of each distinct image, matches, transforms, the
gates, then warped references, masks in tiles, regions and their crops of the pairs that
passed. Every pair keeps a trace of all stages. Numpy kernels see one image or pair at a time
inside Arrow batches; reprojection, gates, palette test, caps, routes and verdicts are Column
expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.config import Pairwise, frozen
from proofsheet.functions import boxes as B
from proofsheet.functions import text as X
from proofsheet.functions import verdict as V
from proofsheet.kernels import compare as K
from proofsheet.kernels import geometry as G
from proofsheet.kernels import regions as R
from proofsheet.sources.versioned import Store
from proofsheet.tables import stored

from . import images as I
from . import reading as D
from . import tiles as T
from .kept import kept

IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"
CONTENTS = f"sha string, error string, stripped double, image {IMAGE}"
FEATURES = "sha string, width int, height int, n int, places binary, descriptors binary"
MATCHES = "pair_id string, sx double, sy double, dx double, dy double"
TRANSFORMS = "pair_id string, h array<double>, condition double, overlap double"
WARPED = f"pair_id string, num long, area long, inside binary, warped {IMAGE}, mkt {IMAGE}"
MASKS = "num long, kind int, ty int, tx int, width int, mask array<boolean>, area long, marked long, coloured long, x0 int, y0 int, x1 int, y1 int"
#: Side of a tile of a pair's masks, and the kinds of masks: both differences, and light alone for packs that were recoloured.
TILE, BOTH, LIGHT = 512, 0, 1


def _image(rgb: np.ndarray) -> dict:
    """An image as a struct of Spark's image source."""
    return {"height": rgb.shape[0], "width": rgb.shape[1], "nChannels": 3, "data": np.ascontiguousarray(rgb[:, :, ::-1]).tobytes()}


def _rgb(image: dict) -> np.ndarray:
    return G.to_rgb(image["height"], image["width"], image["nChannels"], image["data"])


def _mapped(df: DataFrame, one, schema: str, catch: bool = False) -> DataFrame:
    """The rows (dicts) that `one` gives for each row; with catch, an error is a row with `error`, not the end of the run."""
    names = [c.split()[0] for c in schema.replace(f" {IMAGE}", " image").replace("array<", "").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                try:
                    found = list(one(row))
                except Exception as e:
                    if not catch:
                        raise
                    found = [{"sha": row.sha, "error": f"{type(e).__name__}: {e}"}]
                if found:
                    yield pd.DataFrame([{n: r.get(n) for n in names} for r in found], columns=names)

    return df.mapInPandas(run, schema)


def sides_of(pairs: DataFrame) -> DataFrame:
    """sha and image of each distinct image of the pairs."""
    sides = [pairs.select(F.col(f"{x}_sha").alias("sha"), F.col(x).alias("image")) for x in ("ref", "mkt")]
    return sides[0].union(sides[1]).dropDuplicates(["sha"])


def contents(images: DataFrame, s: Pairwise) -> DataFrame:
    """CONTENTS: each distinct image (sha, image) without its border, decoded once however many pairs it is in."""

    def one(row) -> Iterator[dict]:
        rgb = _rgb(row.image)
        inner = G.extract(rgb, G.content_rect(rgb, s.border_uniform_tolerance, s.max_border_crop_fraction))
        yield {"sha": row.sha, "stripped": G.stripped_share(rgb.shape[:2], inner.shape[:2]), "image": _image(inner)}

    return _mapped(images.select("sha", "image"), one, CONTENTS, catch=True)


def features(found: DataFrame, s: Pairwise) -> DataFrame:
    """FEATURES: the keypoints of each content, places (x, y) as doubles and descriptors as floats."""

    def one(row) -> Iterator[dict]:
        p, d = G.keypoints(G.ycrcb(_rgb(row.image))[..., 0], s.registration_max_features)
        yield {"sha": row.sha, "width": row.image["width"], "height": row.image["height"], "n": len(p), "places": p.astype("<f8").tobytes(), "descriptors": d.astype("<f4").tobytes()}

    return _mapped(found.filter("error is null").select("sha", "image"), one, FEATURES)


def matched(pairs: DataFrame, known: DataFrame, s: Pairwise) -> DataFrame:
    """MATCHES: keypoints of the reference whose nearest one in the listing passes the ratio test."""
    sides = [known.select(*[F.col(c).alias(f"{x}_{c}") for c in ("sha", "n", "places", "descriptors")]) for x in ("ref", "mkt")]
    rows = pairs.select("pair_id", "ref_sha", "mkt_sha").join(sides[0], "ref_sha").join(sides[1], "mkt_sha").filter("ref_n > 0 and mkt_n > 0")

    def one(row) -> Iterator[dict]:
        p, q = (np.frombuffer(v, "<f8").reshape(-1, 2) for v in (row.ref_places, row.mkt_places))
        d, e = (np.frombuffer(v, "<f4").reshape(n, -1) for v, n in ((row.ref_descriptors, row.ref_n), (row.mkt_descriptors, row.mkt_n)))
        for i, j in G.matches(d, e, s.registration_lowe_ratio):
            yield {"pair_id": row.pair_id, "sx": p[i, 0], "sy": p[i, 1], "dx": q[j, 0], "dy": q[j, 1]}

    return _mapped(rows, one, MATCHES)


def transforms(matches: DataFrame, pairs: DataFrame, known: DataFrame, s: Pairwise) -> DataFrame:
    """TRANSFORMS: the homography of each pair's matches, and the share of the listing's canvas that it covers; no pixel is read."""
    sizes = [known.select(F.col("sha").alias(f"{x}_sha"), F.col("width").alias(f"{x}_w"), F.col("height").alias(f"{x}_h")) for x in ("ref", "mkt")]
    seed = F.conv(F.substring(F.sha2(F.concat("ref_sha", "mkt_sha"), 256), 1, 8), 16, 10).cast("long").alias("seed")
    rows = pairs.select("pair_id", "ref_sha", "mkt_sha", seed).join(sizes[0], "ref_sha").join(sizes[1], "mkt_sha").join(matches, "pair_id")

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["sx", "sy", "dx", "dy"])
        one, h = f.iloc[0], None
        with suppress(np.linalg.LinAlgError):  # degenerate matches fit nothing
            h, _ = G.ransac(f[["sx", "sy"]].to_numpy(), f[["dx", "dy"]].to_numpy(), s.registration_ransac_reproj_px, seed=int(one.seed))
        if h is None:
            return pd.DataFrame({"pair_id": [], "h": [], "condition": [], "overlap": []})
        covered = G.covered(h, int(one.ref_w), int(one.ref_h), int(one.mkt_w), int(one.mkt_h))
        return pd.DataFrame({"pair_id": [one.pair_id], "h": [h.ravel().tolist()], "condition": [float(np.linalg.cond(h))], "overlap": [float(covered.mean())]})

    return rows.groupBy("pair_id").applyInPandas(fit, TRANSFORMS)


def registered(matches: DataFrame, found: DataFrame, s: Pairwise) -> DataFrame:
    """found (TRANSFORMS) with inliers, their mean reprojection error, scale and rotation: matches as rows under the pair's homography."""
    h = [F.get("h", F.lit(i)) for i in range(9)]
    z = h[6] * F.col("sx") + h[7] * F.col("sy") + h[8]
    off = F.hypot((h[0] * F.col("sx") + h[1] * F.col("sy") + h[2]) / z - F.col("dx"), (h[3] * F.col("sx") + h[4] * F.col("sy") + h[5]) / z - F.col("dy"))
    inside = F.col("off") < s.registration_ransac_reproj_px
    per = matches.join(found.select("pair_id", "h"), "pair_id").withColumn("off", off).groupBy("pair_id").agg(F.count_if(inside).cast("int").alias("inliers"), F.avg(F.when(inside, F.col("off"))).alias("reprojection"))
    return found.join(per, "pair_id").withColumns({"scale": B.implied_scale(h[0], h[1], h[3], h[4]), "rotation": B.implied_rotation(h[0], h[3])})


def warped(accepted: DataFrame, pairs: DataFrame, found: DataFrame, s: Pairwise) -> DataFrame:
    """WARPED: the reference of each accepted pair on the listing's canvas, and where both can be compared (bits, by rows)."""
    side = [found.select(F.col("sha").alias(f"{x}_sha"), F.col("image").alias(x)) for x in ("ref", "mkt")]
    rows = accepted.select("pair_id", "num", "h").join(pairs.select("pair_id", "ref_sha", "mkt_sha"), "pair_id").join(side[0], "ref_sha").join(side[1], "mkt_sha")
    n = 2 * s.overlap_erode_px + 1

    def one(row) -> Iterator[dict]:
        img, valid = G.warp(_rgb(row.ref), np.array(row.h, float).reshape(3, 3), row.mkt["width"], row.mkt["height"])
        inside = R.erode(valid.astype(np.uint8), (n, n), border=0)
        yield {"pair_id": row.pair_id, "num": row.num, "area": int(inside.sum()), "inside": np.packbits(inside).tobytes(), "warped": _image(img), "mkt": row.mkt}

    return _mapped(rows.select("pair_id", "num", "h", "ref", "mkt"), one, WARPED)


def masks(both: DataFrame, s: Pairwise) -> DataFrame:
    """MASKS: where a pair's images differ in structure or colour, in tiles, each with the numbers that the palette test sums."""

    def one(row) -> Iterator[dict]:
        a, b = _rgb(row.warped), _rgb(row.mkt)
        inside = np.unpackbits(np.frombuffer(row.inside, np.uint8), count=a.shape[0] * a.shape[1]).reshape(a.shape[:2]).astype(bool)
        light = K.dissimilarity(G.ycrcb(a)[..., 0], G.ycrcb(b)[..., 0], s.ssim_window) / s.ssim_threshold
        colour = K.colour_shift(a, b, s.ssim_window) / s.chroma_threshold
        for kind, score in ((BOTH, np.maximum(light, colour)), (LIGHT, light)):
            mask = R.closed(R.opened(((score > 1) & inside).astype(np.uint8), s.morph_open), (s.morph_close_y, s.morph_close_x)).astype(bool)
            for ty in range(0, mask.shape[0], TILE):
                for tx in range(0, mask.shape[1], TILE):
                    part = mask[ty : ty + TILE, tx : tx + TILE]
                    y, x = np.nonzero(part)
                    if len(y):
                        ends = {"x0": tx + int(x.min()), "y0": ty + int(y.min()), "x1": tx + int(x.max()), "y1": ty + int(y.max())}
                        dominated = int((colour > light)[ty : ty + TILE, tx : tx + TILE][part].sum())
                        yield {"num": row.num, "kind": kind, "ty": ty // TILE, "tx": tx // TILE, "width": part.shape[1], "mask": part.ravel().tolist(), "area": row.area, "marked": len(y), "coloured": dominated} | ends

    return _mapped(both.select("num", "area", "inside", "warped", "mkt"), one, MASKS)


def differing(found: DataFrame, s: Pairwise) -> tuple[DataFrame, DataFrame]:
    """(regions, recoloured): num, box and area_fraction of each region that is large enough, and num of packs that were recoloured as a whole.

    found: MASKS. A pack counts as recoloured if many regions spread over much of it and colour outweighs structure; its regions
    are those of structure alone.
    """
    image = F.col("num") * 2 + F.col("kind")
    areas = found.groupBy("num").agg(F.greatest(F.max("area"), F.lit(1)).alias("area"))
    boxes = T.regions(found.select(image.alias("image"), "ty", "tx", "width", "mask"), TILE)
    boxes = boxes.select(F.floor(F.col("image") / 2).alias("num"), (F.col("image") % 2).alias("kind"), *[F.col(c).cast("int").alias(c) for c in "xywh"]).join(areas, "num")
    boxes = boxes.withColumn("area_fraction", F.col("w") * F.col("h") / F.col("area")).filter(F.col("area_fraction") >= s.min_region_area_fraction)
    boxes = stored(boxes.drop("area"), "boxes")
    spread = (F.max("x1") + 1 - F.min("x0")) * (F.max("y1") + 1 - F.min("y0")) / F.max("area")
    sums = found.filter(F.col("kind") == BOTH).groupBy("num").agg(spread.alias("spread"), (F.sum("marked") / F.max("area")).alias("marked"), (F.sum("coloured") / F.sum("marked")).alias("dominance"))
    many = boxes.filter(F.col("kind") == BOTH).groupBy("num").agg(F.count("*").alias("n")).filter(F.col("n") >= s.global_change_min_regions)
    gate = (F.col("spread") >= s.global_change_area_fraction) & (F.col("marked") >= s.global_change_min_area_fraction) & (F.col("dominance") >= s.chroma_dominance_fraction)
    recoloured = stored(sums.join(many, "num").filter(gate).select("num", F.lit(True).alias("palette")), "recoloured")
    chosen = boxes.join(recoloured, "num", "left").filter(F.col("kind") == F.when(F.col("palette"), LIGHT).otherwise(BOTH))
    return chosen.select("num", *"xywh", "area_fraction"), recoloured


def inked(boxes: DataFrame, both: DataFrame, crops: bool) -> DataFrame:
    """boxes (num, box, area_fraction) with the ratio of ink and, if wanted, crops for reading: regions of a pair meet its images in one row."""
    schema = f"pair_id string, x int, y int, w int, h int, area_fraction double, ink double, ref {IMAGE}, mkt {IMAGE}"
    per = boxes.groupBy("num").agg(F.collect_list(F.struct(*"xywh", "area_fraction")).alias("boxes"))  # max_regions at most

    def one(row) -> Iterator[dict]:
        a, b = _rgb(row.warped), _rgb(row.mkt)
        for r in row.boxes:
            x, y, w, h = (int(r[c]) for c in "xywh")
            out = {"pair_id": row.pair_id, "x": x, "y": y, "w": w, "h": h, "area_fraction": r["area_fraction"], "ink": K.ink(a[y : y + h, x : x + w], b[y : y + h, x : x + w])}
            yield out | ({"ref": _image(G.reading_crop(a, (x, y, w, h))), "mkt": _image(G.reading_crop(b, (x, y, w, h)))} if crops else {})

    return _mapped(both.join(per, "num").select("pair_id", "warped", "mkt", "boxes"), one, schema)


def largest(boxes: DataFrame, key: str, s: Pairwise) -> DataFrame:
    """The max_regions largest boxes of each key; of boxes as large at one place, those less wide, so that reruns agree."""
    w = Window.partitionBy(key).orderBy(F.desc("area_fraction"), "y", "x", "w", "h")
    return boxes.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= s.max_regions).drop("n")


def measured(pairs: DataFrame, s: Pairwise, crops: bool, store: Store | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs with their registration, palette and counts; their largest regions). Every stage is a table, and only pairs that pass the gates are warped.

    With a store, contents and keypoints of images are kept from run to run, by content and settings.
    """
    pairs = pairs.select("pair_id", "ref_sha", "mkt_sha", "ref", "mkt")
    by = hashlib.sha256(frozen(s).encode()).hexdigest()[:12]
    found = kept(store, f"contents_{by}", sides_of(pairs), lambda rows: contents(rows, s))
    known = kept(store, f"features_{by}", found, lambda rows: features(rows, s))
    named = stored(pairs.select("pair_id", "ref_sha", "mkt_sha"), "named")
    matches = stored(matched(named, known, s), "matches")
    fitted = registered(matches, stored(transforms(matches, named, known, s), "transforms"), s)
    side = [found.select(F.col("sha").alias(f"{x}_sha"), F.col("error").alias(f"{x}_error"), F.col("stripped").alias(f"{x}_stripped")) for x in ("ref", "mkt")]
    rows = named.join(side[0], "ref_sha", "left").join(side[1], "mkt_sha", "left").join(fitted, "pair_id", "left")
    rows = rows.withColumns({"error": F.coalesce("ref_error", "mkt_error"), "stripped": F.greatest("ref_stripped", "mkt_stripped"), "inliers": F.coalesce("inliers", F.lit(0)), "num": F.monotonically_increasing_id()})
    seen = stored(gated(rows, s).select("pair_id", "num", "h", "error", "inliers", "reprojection", "condition", "scale", "rotation", "overlap", "stripped", "registration", "registration_confidence"), "registered")
    accepted = seen.filter(F.col("registration").isin("OK", "DEGRADED"))
    both = I.measured(warped(accepted, named, found, s), "warped")
    boxes, recoloured = differing(I.measured(masks(both, s), "masks"), s)
    regions = I.measured(inked(largest(boxes, "num", s), both, crops), "regions")
    return seen.join(recoloured, "num", "left").withColumn("palette", F.coalesce("palette", F.lit(False))).drop("num", "h"), regions


def gated(measured: DataFrame, s: Pairwise) -> DataFrame:
    """measured with registration's status: OK, DEGRADED or HALTED, and its confidence."""
    enough = (F.col("inliers") >= s.registration_inliers_required) & (F.col("condition") <= s.registration_max_condition_number) & F.col("scale").between(s.registration_min_scale, s.registration_max_scale) & (F.col("overlap") >= s.registration_min_overlap_fraction)
    status = F.when(F.col("error").isNotNull(), "FAILED").when(~F.coalesce(enough, F.lit(False)), "HALTED").when(F.col("inliers") < s.registration_inliers_ok, "DEGRADED").otherwise("OK")
    conf = V.registration_confidence("inliers", s.registration_inliers_ok, "reprojection", s.registration_ransac_reproj_px, "overlap")
    return measured.withColumn("registration", status).withColumn("registration_confidence", F.coalesce(conf, F.lit(0.0)))


def ordered(top: DataFrame, recoloured: DataFrame) -> DataFrame:
    """Regions of pairs in reading order, a recoloured pack before them: pair_id, ordinal, kind, box, ink."""
    top = top.withColumn("kind", F.lit("REGION"))
    known = {"x": 0, "y": 0, "w": 0, "h": 0, "area_fraction": 1.0, "kind": "PALETTE"}
    whole = recoloured.select("pair_id", *[F.lit(known.get(c)).cast(t).alias(c) for c, t in top.dtypes if c != "pair_id"])
    order = Window.partitionBy("pair_id").orderBy(F.col("kind") != "PALETTE", "y", "x", "w", "h")
    return top.unionByName(whole).withColumn("ordinal", F.row_number().over(order))


def regions_of(measured: DataFrame, s: Pairwise) -> DataFrame:
    """The largest regions of each pair (pair_id, registration, palette, regions) in reading order."""
    rows = measured.filter(F.col("registration").isin("OK", "DEGRADED")).select("pair_id", F.explode("regions").alias("r")).select("pair_id", "r.*")
    return ordered(largest(rows, "pair_id", s), measured.filter("palette"))


def compared(pairs: DataFrame, readings: DataFrame | None = None, settings: Pairwise | None = None, reader: D.Engine = D.NULL, store: Store | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, regions). verdicts: pair_id, verdict, confidence, trace (STAGES in order, each with status, metrics and note).

    Regions are read by the reader, unless readings (pair_id, ordinal, ref_text, mkt_text, reliable) are given. Images are decoded,
    registered and differenced once: what is measured is a table in the shared folder.
    """
    s = settings or Pairwise()
    same = F.col("ref_sha") == F.col("mkt_sha")
    reads = readings is None and reader.available
    seen, top = measured(pairs.filter(~same), s, reads, store)
    regions = ordered(top, seen.filter("palette"))
    if reads:
        regions = stored(regions, "regions")
        readings = D.readings(regions.filter("kind <> 'PALETTE'"), reader)
    if readings is None:
        readings = regions.select("pair_id", "ordinal").limit(0).selectExpr("*", "'' as ref_text", "'' as mkt_text", "false as reliable")
    read = regions.drop("ref", "mkt").join(readings.select("pair_id", "ordinal", "ref_text", "mkt_text", "reliable"), ["pair_id", "ordinal"], "left").fillna({"ref_text": "", "mkt_text": "", "reliable": False})
    read = X.with_comparison(read, "ref_text", "mkt_text", "c")
    gone = F.exists("c.differences", lambda d: d["kind"].isin("TEXT_REMOVED", "TEXT_ADDED"))
    one_side = (F.length("ref_text") > 0) != (F.length("mkt_text") > 0)
    intact = one_side & (F.coalesce("ink", F.lit(0.0)) >= 0.55)
    severity = X.region_route(F.col("kind") == "PALETTE", (F.length("ref_text") > 0) | (F.length("mkt_text") > 0), F.col("c.severity"), intact, F.col("reliable"), F.col("c.alike"), gone, s.unreliable_similarity)
    judged = read.withColumn("severity", severity)
    count = lambda x: F.count_if(F.col("severity") == x).alias(x.lower())
    per = judged.groupBy("pair_id").agg(count("MATERIAL"), count("UNCERTAIN"), count("COSMETIC"), F.count("*").alias("n"), F.count_if(F.col("reliable")).alias("read"), F.collect_list("severity").alias("severities"))
    out = pairs.select("pair_id", same.alias("same")).join(seen, "pair_id", "left").join(per, "pair_id", "left").fillna(0, ["material", "uncertain", "cosmetic", "n", "read"])
    halt = F.when(F.col("same"), "IDENTICAL").when(F.col("registration").isin("HALTED", "FAILED"), "CANNOT_COMPARE")
    text_conf = X.stage_confidence(F.coalesce("severities", F.array().cast("array<string>")))
    conf = F.when(F.col("same"), 1.0).otherwise(F.bround(F.least("registration_confidence", text_conf), 4))
    out = out.withColumns({"verdict": V.pair_verdict(halt, "material", "uncertain", "cosmetic"), "confidence": conf, "text_confidence": text_conf})
    return out.select("pair_id", "verdict", "confidence", trace(reader).alias("trace")), judged.drop("c")


STAGES = ["load_normalize", "hash", "registration", "structural_diff", "region_ocr", "text_compare", "verdict"]


def trace(reader: D.Engine) -> Column:
    """A row for each stage of a pair, also for those that failed or were skipped: stage, status, metrics, note."""
    failed, alike = F.col("registration") == "FAILED", F.col("same")
    halted = F.col("registration") == "HALTED"
    none = F.col("n") == 0
    m = lambda **x: F.map_from_arrays(F.array(*map(F.lit, x)), F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in x.values()]))
    empty = F.create_map().cast("map<string,double>")
    after = F.coalesce(alike | failed | halted, F.lit(False))
    skip = F.when(after, "SKIPPED")
    rows = [
        (F.when(alike, "SKIPPED").when(failed, "FAILED").otherwise("OK"), F.when(alike, empty).otherwise(m(stripped="stripped")), F.col("error")),
        (F.when(alike, "DECIDED").otherwise("OK"), empty, F.when(alike, "the files are the same")),
        (F.when(alike | failed, "SKIPPED").otherwise(F.col("registration")), F.when(alike | failed, empty).otherwise(m(inliers="inliers", reprojection="reprojection", condition="condition", scale="scale", rotation="rotation", overlap="overlap")), F.when(halted, "the images can't be laid over each other")),
        (F.coalesce(skip, F.lit("OK")), F.when(after, empty).otherwise(m(regions="n")), F.when(~after & none, "no region differs")),
        (F.when(after | none, "SKIPPED").when(F.lit(not reader.available) | (F.col("read") < F.col("n")), "DEGRADED").otherwise("OK"), F.when(after | none, empty).otherwise(m(reliable="read")), F.lit(None if reader.available else "no engine")),
        (F.when(after | none, "SKIPPED").otherwise("OK"), F.when(after | none, empty).otherwise(m(material="material", uncertain="uncertain", cosmetic="cosmetic", confidence="text_confidence")), F.lit(None).cast("string")),
        (F.lit("OK"), m(confidence="confidence"), F.col("verdict")),
    ]
    return F.array(*[F.struct(F.lit(name).alias("stage"), status.alias("status"), metrics.alias("metrics"), note.cast("string").alias("note")) for name, (status, metrics, note) in zip(STAGES, rows, strict=True)])
