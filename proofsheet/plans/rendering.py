"""Queries over images that are rendered from the nations' keys, with exact labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from proofsheet.config import Identify, Pairwise
from proofsheet.kernels import compare as K
from proofsheet.kernels import geometry as G
from proofsheet.kernels import pictures as P
from proofsheet.kernels import regions as R
from proofsheet.operators import images as I
from proofsheet.operators import pairs as PA
from proofsheet.operators import reading as D
from proofsheet.sources import corpus as C
from proofsheet.sources import images as S
from proofsheet.tables import stored

from .registry import query

#: Edits that the region search sees as one box each.
KINDS = ["NUMERIC_DRIFT", "CLAIM_REMOVED", "CLAIM_ADDED", "CERT_REMOVED"]
SETTINGS = Identify(clean_fraction=0.002)
TRUTH = """p AS (SELECT n_nationkey AS n, 'N' || n_nationkey AS product_id FROM nation), e AS (SELECT *, ['NUMERIC_DRIFT', 'CLAIM_REMOVED', 'CLAIM_ADDED', 'CERT_REMOVED'][1 + (n + v) % 4] AS edit_type, 'field_' || (n + v) % 6 AS field_key FROM p, (VALUES (1), (2)) k(v))"""


def products(t):
    return t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("product_id"), F.col("n_nationkey").cast("long").alias("seed"))


def corpus(t):
    versions = I.measured(C.artwork(products(t), 3, 240, KINDS).repartition("product_id"), "artwork")
    regions = I.with_edits(I.measured(I.reference_regions(versions, SETTINGS), "regions"), C.edits_of(versions))
    return versions, stored(regions, "mapped")


def probes(t, versions):
    grid = [(0, 100, 1.0, "none"), (1, 90, 1.0, "none"), (2, 80, 1.0, "white"), (3, 90, 0.85, "none")]
    return I.measured(C.listings(versions, t.spark.createDataFrame(grid, "variant_id int, quality int, size double, padding string")), "listings")


@query(f"WITH {TRUTH} SELECT product_id, n * 3 + v - 1 AS from_id, n * 3 + v AS to_id, field_key, edit_type, CASE WHEN edit_type = 'PALETTE_SHIFT' THEN 'COSMETIC' ELSE 'MATERIAL' END AS severity FROM e")
def image_regions(t):
    """Regions of consecutive versions and the edits they belong to."""
    _, regions = corpus(t)
    return regions.select("product_id", "from_id", "to_id", "field_key", "edit_type", "severity").distinct()


@query(f"WITH {TRUTH} SELECT product_id, (n * 3 + v) * 1000 + k AS probe_id, n * 3 + v AS matched_id, CASE WHEN k = 0 THEN 'HASH_EXACT' END AS exact FROM p, (VALUES (0), (1), (2)) x(v), (VALUES (0), (1), (2), (3)) y(k)")
def image_identify(t):
    """Listings found by hash, pixels and regions."""
    versions, regions = corpus(t)
    q = probes(t, versions)
    found = I.identify(q.select("probe_id", "product_id", "sha", "image"), versions, regions, SETTINGS)
    return found.join(q.select("probe_id", "product_id"), "probe_id").select("product_id", "probe_id", "matched_id", F.when(F.col("method") == "HASH_EXACT", F.col("method")).alias("exact"))


@query(f"""WITH {TRUTH}, l AS (SELECT p.*, x.v, (n * 3 + x.v) * 1000 + y.k AS probe_id FROM p, (VALUES (0), (1), (2)) x(v), (VALUES (0), (1), (2), (3)) y(k))
SELECT probe_id, CASE WHEN l.v = 2 THEN 'PASS' ELSE 'STALE_VERSION' END AS verdict, CASE WHEN l.v = 2 THEN 'NONE' ELSE 'MATERIAL' END AS severity, (SELECT string_agg(edit_type, ',' ORDER BY e.v) FROM e WHERE e.n = l.n AND e.v > l.v) AS edits FROM l""")
def image_findings(t):
    """Verdicts of listings with the deltas on their way to the current version."""
    versions, regions = corpus(t)
    q = probes(t, versions)
    placed = q.select("probe_id", "product_id", F.lit(0).alias("cx"), F.lit(0).alias("cy"), F.col("image.width").alias("cw"), F.col("image.height").alias("ch"), F.lit(240.0).alias("rw"), F.lit(240.0).alias("rh"))
    found = I.listing_findings(I.identify(q.select("probe_id", "product_id", "sha", "image"), versions, regions, SETTINGS), placed, versions, regions)
    kinds = F.array_join(F.array_distinct(F.transform("deltas", lambda d: F.concat(d["to_id"].cast("string"), F.lit(":"), d["edit_type"]))), ",")
    return found.select("probe_id", "verdict", "severity", F.nullif(F.regexp_replace(kinds, "[0-9]+:", ""), F.lit("")).alias("edits"))


CLASSED = """c AS (SELECT n_nationkey AS n, 'P' || n_nationkey || '_' || k AS pair_id, ['identical', 'recompressed', 'resized', 'shifted', 'number_edit', 'element_removed', 'different_product'][1 + k] AS class FROM nation, range(0, 7) r(k))"""


def classed(t):
    kinds = ["identical", "recompressed", "resized", "shifted", "number_edit", "element_removed", "different_product"]
    plan = t.nation.select("n_nationkey", F.posexplode(F.array(*map(F.lit, kinds))).alias("k", "class"))
    plan = plan.select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("pair_id"), "class", F.col("n_nationkey").cast("long").alias("seed"))
    return I.measured(C.pairs(plan.repartition(8, "pair_id"), 240), "pairs")


@query(f"WITH {CLASSED} SELECT pair_id, class, CASE class WHEN 'identical' THEN 'IDENTICAL' WHEN 'different_product' THEN 'CANNOT_COMPARE' WHEN 'number_edit' THEN 'NEEDS_REVIEW' WHEN 'element_removed' THEN 'NEEDS_REVIEW' ELSE 'MATCH' END AS verdict FROM c")
def image_pairs(t):
    """Verdicts of pairs without an engine."""
    rows = classed(t)
    return PA.compared(rows)[0].join(rows.select("pair_id", "class"), "pair_id").select("pair_id", "class", "verdict")


@query(f"""WITH {CLASSED} SELECT class, s.stage AS stage, count(*)::BIGINT AS pairs, CASE WHEN class = 'identical' THEN CASE s.stage WHEN 'hash' THEN 'DECIDED' WHEN 'verdict' THEN 'OK' ELSE 'SKIPPED' END
  WHEN class = 'different_product' THEN CASE WHEN s.stage IN ('load_normalize', 'hash', 'verdict') THEN 'OK' WHEN s.stage = 'registration' THEN 'HALTED' ELSE 'SKIPPED' END
  WHEN class IN ('number_edit', 'element_removed') THEN 'OK' WHEN s.stage IN ('region_ocr', 'text_compare') THEN 'SKIPPED' ELSE 'OK' END AS status
FROM c, (SELECT unnest(['load_normalize', 'hash', 'registration', 'structural_diff', 'region_ocr', 'text_compare', 'verdict']) AS stage) s GROUP BY ALL""")
def image_trace(t):
    """Every stage of every pair, with an engine that counts bars."""
    rows = classed(t)
    verdicts, _ = PA.compared(rows, settings=Pairwise(registration_inliers_ok=15), reader=D.Engine("bars", bars))
    stages = verdicts.join(rows.select("pair_id", "class"), "pair_id").select("class", F.explode("trace").alias("s"))
    return stages.groupBy("class", "s.stage", "s.status").agg(F.count("*").alias("pairs"))


def bars(image: np.ndarray) -> list:
    """An engine for rendered fields: it counts the bars in the middle of a crop; a plain field has no text."""
    inner = image[24:-24, 24:-24] if min(image.shape[:2]) > 60 else image
    line = inner[inner.shape[0] // 2, :, 0] < 100
    n = int((line[1:] & ~line[:-1]).sum())
    h, w = image.shape[:2]
    return [(f"{n} mg", 0.9, [(0, 0), (w, 0), (w, h), (0, h)])] if n > 1 else []


@query("""SELECT n_nationkey AS n, side, (n_nationkey % 3 = 0)::BOOLEAN AS reliable, CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE (4 + n_nationkey % 5) || ' mg' END AS mkt_text, (n_nationkey % 3 = 2) AS ink_intact
FROM nation, (SELECT 'ref' AS side) s""")
def image_reading(t):
    """Crops read at two scales; low confidence and text lost beside its ink are unreliable."""

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for n in f["n_nationkey"]:
                def picture(count: int, dark: int) -> np.ndarray:
                    img = np.full((60, 200, 3), 235, np.uint8)
                    for i in range(count):
                        img[15:45, 20 + 16 * i : 27 + 16 * i] = dark
                    return G.reading_crop(img, (10, 12, 180, 36))

                count = 4 + n % 5
                ref, mkt = picture(count + (n % 3 == 1), 30), picture(count, 120 if n % 3 == 2 else 30)
                rows.append({"pair_id": str(n), "ordinal": 1, "ref": C.as_row(ref), "mkt": C.as_row(mkt), "ink": K.ink(ref, mkt)})
            yield pd.DataFrame(rows)

    crops = t.nation.select("n_nationkey").mapInPandas(render, f"pair_id string, ordinal int, ref {C.IMAGE}, mkt {C.IMAGE}, ink double")

    def shaky(image: np.ndarray) -> list:
        # every second reading, at the other scale, differs
        found = bars(image)
        return found if image.shape[1] > 300 else [(a + " x", c, q) for a, c, q in found]

    out = D.readings(stored(crops, "crops"), D.Engine("bars", shaky))
    n = F.col("pair_id").cast("int")
    return out.select(n.alias("n"), F.lit("ref").alias("side"), "reliable", "mkt_text", "ink_intact")


@query("SELECT n_nationkey AS n, (8 + n_nationkey % 5)::DOUBLE AS x, (6 + n_nationkey % 7)::DOUBLE AS y, 120::DOUBLE AS w, 100::DOUBLE AS h, 3 - n_nationkey % 5 AS dx, n_nationkey % 4 - 2 AS dy, true AS same_after, true AS resized FROM nation")
def image_geometry(t):
    """Borders, content, shifts and area resizing, against how the images were made."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for n in f["n_nationkey"]:
                inner = P.pack(int(n), 160)[:100, :120]
                x, y = 8 + n % 5, 6 + n % 7
                img = np.full((y + 100 + 9, x + 120 + 11, 3), 255 if n % 2 else 240, np.uint8)
                img[y : y + 100, x : x + 120] = inner
                rx, ry, rw, rh = G.content_rect(img)  # edges lie between two lines
                left, top = np.floor(rx + 0.5), np.floor(ry + 0.5)
                rect = (left, top, np.floor(rx + rw) - left, np.floor(ry + rh) - top)
                g = np.random.default_rng(int(n)).random((96, 112, 1)).astype(np.float32)
                dx, dy = int(3 - n % 5), int(n % 4 - 2)
                found = G.translation(g[..., 0], G.shift(g, dx, dy)[..., 0])
                coarse = np.random.default_rng(int(n)).integers(0, 256, (12, 15, 3)).astype(np.uint8)
                rows.append((n, *rect, *found, bool((G.extract(img, rect) == inner).all()), bool((G.resize_area(np.kron(coarse, np.ones((4, 4, 1), np.uint8)), 15, 12) == coarse).all())))
            yield pd.DataFrame(rows, columns=["n", "x", "y", "w", "h", "dx", "dy", "same_after", "resized"])

    return t.nation.select("n_nationkey").mapInPandas(run, "n long, x double, y double, w double, h double, dx int, dy int, same_after boolean, resized boolean")


@query("SELECT n_nationkey AS n, true AS found, true AS near, true AS outliers, true AS inverse FROM nation")
def image_homography(t):
    """Homographies recovered from points with a third of outliers; corner errors under half a pixel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for n in f["n_nationkey"]:
                r = np.random.default_rng(int(n))
                true = np.array([[1 + 0.02 * (n % 7), 0.03, 5 + n % 9], [-0.02, 0.96, 3], [1e-5, -2e-5, 1]])
                src = r.random((90, 2)) * 200
                dst = G.project(true, src) + r.normal(0, 0.1, (90, 2))
                dst[:30] += 20 + r.random((30, 2)) * 60
                h, inside = G.ransac(src, dst, 3.0, seed=int(n))
                img = P.pack(int(n), 120)
                there, valid = G.warp(img, true, 140, 140)
                back, seen = G.warp(there, np.linalg.inv(true), 120, 120)
                both = R.erode(seen.astype(np.uint8), (9, 9), border=0).astype(bool)
                rows.append((n, h is not None, G.corner_error(h, true, 200, 200) < 0.5, bool(inside[30:].all() and not inside[:30].any()), bool(np.abs(back[both].astype(float) - img[both]).mean() < 25)))
            yield pd.DataFrame(rows, columns=["n", "found", "near", "outliers", "inverse"])

    return t.nation.select("n_nationkey").mapInPandas(run, "n long, found boolean, near boolean, outliers boolean, inverse boolean")


@query("SELECT n_nationkey AS n, 0::DOUBLE AS same_score, 0::DOUBLE AS same_ssim, 3::DOUBLE AS signal, 1::DOUBLE AS inside, 0::DOUBLE AS outside, true AS coloured FROM nation")
def image_differences(t):
    """Scores of equal images, of an inverted field and of a tint."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for n in f["n_nationkey"]:
                a = P.pack(int(n), 160)
                x, y = 20 + n % 9, 30 + n % 11
                b = a.copy()
                b[y : y + 24, x : x + 40] = np.where(a[y : y + 24, x : x + 40] > 128, 0, 255)
                s = K.score(a, b, 32.0, 14.0, 0)
                tint = np.clip(a.astype(np.int16) + np.array([60, 0, -60]), 0, 255).astype(np.uint8)
                light, colour = K.dissimilarity(G.ycrcb(a)[..., 0], G.ycrcb(tint)[..., 0]).mean(), K.colour_shift(a, tint).mean()
                rows.append((n, float(K.score(a, a, 32.0, 14.0, 1).max()), round(float(K.dissimilarity(G.ycrcb(a)[..., 0], G.ycrcb(a)[..., 0]).max()), 9) + 0.0, round(K.signal(s, (x + 2, y + 2, 36, 20)), 6), K.region_changed(s, (x + 2, y + 2, 36, 20)), K.region_changed(s, (x, y + 40, 40, 24)), bool(colour > 12 and light < 0.1)))
            yield pd.DataFrame(rows, columns=["n", "same_score", "same_ssim", "signal", "inside", "outside", "coloured"])

    return t.nation.select("n_nationkey").mapInPandas(run, "n long, same_score double, same_ssim double, signal double, inside double, outside double, coloured boolean")


@query("""SELECT q AS quality, s AS size, 75::BIGINT AS images, true AS apart FROM (VALUES (100, 1.0::DOUBLE), (90, 1.0), (80, 1.0), (90, 0.85)) v(q, s) UNION ALL SELECT NULL, NULL, 300, true""")
def image_fractions(t):
    """Fractions against the true version lie under those against the others, by quality and size."""
    versions, regions = corpus(t)
    q = probes(t, versions)
    seen = I.measured(I.compared(q.select("probe_id", "product_id", "sha", "image"), versions, regions, SETTINGS), "compared")
    out = I.fraction_report(seen, q.select("probe_id", "true_id", "quality", "size"))
    return out.select("quality", "size", "images", (F.col("own_most") < 0.002).alias("apart"))


@query(f"""WITH {TRUTH}, l AS (SELECT p.*, x.v, (n * 3 + x.v) * 1000 + y.k AS probe_id FROM p, (VALUES (0), (1)) x(v), (VALUES (0), (1), (2), (3)) y(k)) SELECT probe_id, 'overlays/' || probe_id || '.jpg' AS path, true AS jpeg, CASE probe_id % 1000 WHEN 2 THEN 280 WHEN 3 THEN 204 ELSE 240 END::INTEGER AS width FROM l""")
def image_overlays(t):
    """Overlays of stale listings as JPEG files, their sizes read from the header."""
    versions, regions = corpus(t)
    q = probes(t, versions)
    placed = q.select("probe_id", "product_id", F.lit(0).alias("cx"), F.lit(0).alias("cy"), F.col("image.width").alias("cw"), F.col("image.height").alias("ch"), F.lit(240.0).alias("rw"), F.lit(240.0).alias("rh"))
    found = stored(I.listing_findings(I.identify(q.select("probe_id", "product_id", "sha", "image"), versions, regions, SETTINGS), placed, versions, regions), "findings")
    drawn = I.overlays(found, q)
    return drawn.select("probe_id", "path", (F.hex(F.substring("picture", 1, 2)) == "FFD8").alias("jpeg"), S.image_size(F.col("picture"))["width"].alias("width"))
