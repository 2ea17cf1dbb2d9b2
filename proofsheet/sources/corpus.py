"""Rendered corpora with exact labels: artwork versions, listings of them, and pairs of nine classes.

Everything follows from seeds, and rendering runs in Spark's tasks, so a corpus may be of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.kernels import geometry as G
from proofsheet.kernels import jpeg as J
from proofsheet.kernels import pictures as P
from proofsheet.kernels.regions import truth_box
from proofsheet.operators.evaluate import ACCEPTED

IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"
EDITS = "edit_pos int, x int, y int, w int, h int, field_key string, old_value string, new_value string, edit_type string, severity string"
VERSIONS = f"product_id string, version_id long, version_label string, pos long, is_current boolean, sha string, image {IMAGE}"
#: The ways in which one version becomes the next.
EDIT_TYPES = ["NUMERIC_DRIFT", "WEIGHT_CHANGE", "CLAIM_REMOVED", "CLAIM_ADDED", "PALETTE_SHIFT", "LOGO_NUDGE", "CERT_REMOVED", "NO_CHANGE"]
FIELDS = 6


def as_row(rgb: np.ndarray) -> dict:
    """An image as a struct of Spark's image source."""
    return {"height": rgb.shape[0], "width": rgb.shape[1], "nChannels": 3, "data": np.ascontiguousarray(rgb[:, :, ::-1]).tobytes()}


def sha(rgb: np.ndarray) -> str:
    return hashlib.sha256(repr(rgb.shape).encode() + rgb.tobytes()).hexdigest()


def edited(img: np.ndarray, kind: str, k: int, seed: int) -> tuple[np.ndarray, tuple[int, int, int, int] | None]:
    """The image after an edit of field k, and the box that it changed."""
    out = img.copy()
    side = img.shape[0]
    x, y, w, h = P.field(img.copy(), k, 0)
    if kind in ("NUMERIC_DRIFT", "WEIGHT_CHANGE"):
        P.field(out, k, seed)
    elif kind == "CLAIM_REMOVED":
        out[y : y + h, x : x + w] = 235
    elif kind == "CLAIM_ADDED":
        n = side // 10
        out[side // 24 : side // 24 + n, side - 2 * n : side - n] = (30, 90, 200)
    elif kind == "PALETTE_SHIFT":
        out[y : y + h, x : x + w] = np.where(out[y : y + h, x : x + w] > 128, (250, 210, 60), out[y : y + h, x : x + w])
    elif kind == "LOGO_NUDGE":
        out[y : y + h, x : x + w] = np.roll(out[y : y + h, x : x + w], w // 5, axis=1)
    elif kind == "CERT_REMOVED":
        yy, xx = np.mgrid[:side, :side]
        out[(yy - side // 8) ** 2 + (xx - side // 2) ** 2 < (side // 14) ** 2] = (180, 40, 60)
    return out, truth_box(img, out)


def line_of(seed: int, versions: int, side: int, kinds: list[str]) -> tuple[list[np.ndarray], list[tuple]]:
    """A product's versions, and between each two the edits (EDITS)."""
    images, edits = [P.pack(seed, side)], []
    for v in range(1, versions):
        kind, k = kinds[(seed + v) % len(kinds)], (seed + v) % FIELDS
        img, box = edited(images[-1], kind, k, 1000 * seed + v)
        images.append(img)
        edits.append([] if box is None else [(0, *box, f"field_{k}", f"{seed + v} mg", f"{seed + v + 30} mg", kind, "COSMETIC" if kind == "PALETTE_SHIFT" else "MATERIAL")])
    return images, edits


def artwork(products: DataFrame, versions: int = 3, side: int = 240, kinds: list[str] | None = None) -> DataFrame:
    """VERSIONS, and `edits` from the version before, of products (product_id, seed); the last one is current."""
    some = kinds or EDIT_TYPES

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EDITS.split(", ")]
        for f in frames:
            for r in f.itertuples():
                images, edits = line_of(int(r.seed), versions, side, some)
                rows = [{"product_id": r.product_id, "version_id": int(r.seed) * versions + v, "version_label": f"v{v + 1}", "pos": v + 1, "is_current": v == versions - 1, "sha": sha(img), "image": as_row(img), "edits": [dict(zip(names, e, strict=True)) for e in ([[], *edits][v])]} for v, img in enumerate(images)]
                yield pd.DataFrame(rows)

    struct = "array<struct<" + ",".join(c.replace(" ", ":") for c in EDITS.split(", ")) + ">>"
    return products.select("product_id", "seed").mapInPandas(render, f"{VERSIONS}, edits {struct}")


def edits_of(versions: DataFrame) -> DataFrame:
    """product_id, from_id, to_id and EDITS of versions as `artwork` gives them."""
    return versions.select("product_id", (F.col("version_id") - 1).alias("from_id"), F.col("version_id").alias("to_id"), F.explode("edits").alias("e")).select("product_id", "from_id", "to_id", "e.*")


def transformed(img: np.ndarray, quality: int, size: float, padding: str, seed: int, warp: float = 0.0) -> np.ndarray:
    """A listing of the artwork: photographed at an angle, resized, with a little noise, padded, and as a JPEG file of a quality shows it (100: as it is)."""
    if warp:
        h, w = img.shape[:2]
        m = np.array([[1 - warp, warp / 3, w * warp / 2], [-warp / 3, 1 - warp, h * warp / 2], [0, warp / w / 3, 1]])
        img = G.warp(img, m, w, h)[0]
    if size != 1:
        img = G.resize_area(img, round(img.shape[1] * size), round(img.shape[0] * size))
    if padding != "none":
        img = P.padded(img, 1 / 12, 255 if padding == "white" else 240)
    return J.lossy(P.noisy(img, seed, 1.0), quality) if quality < 100 else img


def listings(versions: DataFrame, variants: DataFrame) -> DataFrame:
    """probe_id, product_id, true_id, quality, size, padding, sha, image: each version by each variant (variant_id, quality, size, padding)."""
    every = versions.join(F.broadcast(variants)).select("product_id", "version_id", "image", "variant_id", "quality", "size", "padding")  # the variants are a fixed grid

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                img = G.to_rgb(r.image["height"], r.image["width"], 3, r.image["data"])
                out = transformed(img, int(r.quality), float(r.size), r.padding, int(r.version_id) * 1000 + int(r.variant_id))
                rows.append({"probe_id": int(r.version_id) * 1000 + int(r.variant_id), "product_id": r.product_id, "true_id": r.version_id, "quality": r.quality, "size": r.size, "padding": r.padding, "sha": sha(out), "image": as_row(out)})
            yield pd.DataFrame(rows)

    return every.mapInPandas(render, f"probe_id long, product_id string, true_id long, quality int, size double, padding string, sha string, image {IMAGE}")


#: The classes of pairs, each with the verdicts it accepts.
CLASSES = list(ACCEPTED)


def pair_of(kind: str, seed: int, side: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int] | None]:
    """Reference, listing and the box of the edit of a pair of this class."""
    ref = P.pack(seed, side)
    k, box = seed % FIELDS, None
    if kind == "identical":
        return ref, ref, None
    mkt = ref
    if kind == "recompressed":
        mkt = J.lossy(ref, 80)
    elif kind == "resized":
        mkt = G.resize_area(ref, side * 9 // 10, side * 9 // 10)
    elif kind == "shifted":
        mkt = P.padded(ref, 1 / 16)
    elif kind == "recoloured":
        mkt = np.clip(ref.astype(np.int16) + np.array([40, -30, 10]), 0, 255).astype(np.uint8)
    elif kind in ("text_edit", "number_edit"):
        mkt, box = edited(ref, "NUMERIC_DRIFT", k, seed + 77)
    elif kind == "element_removed":
        mkt, box = edited(ref, "CLAIM_REMOVED", k, seed)
    elif kind == "different_product":
        mkt = P.pack(seed + 100_003, side)
    return ref, mkt, box


def pairs(plan: DataFrame, side: int = 240) -> DataFrame:
    """pair_id, class, ref, mkt, ref_sha, mkt_sha, edit_box of a plan (pair_id, class, seed)."""

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                ref, mkt, box = pair_of(r[2], int(r.seed), side)
                rows.append({"pair_id": r.pair_id, "class": r[2], "ref": as_row(ref), "mkt": as_row(mkt), "ref_sha": sha(ref), "mkt_sha": sha(mkt), "edit_box": None if box is None else dict(zip("xywh", box, strict=True))})
            yield pd.DataFrame(rows)

    return plan.select("pair_id", "class", "seed").mapInPandas(render, f"pair_id string, class string, ref {IMAGE}, mkt {IMAGE}, ref_sha string, mkt_sha string, edit_box struct<x:int,y:int,w:int,h:int>")
