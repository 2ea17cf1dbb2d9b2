"""Regions of masks that are too large for one task.

A mask comes as tiles. Each tile is labelled by itself; pixels on its border that touch one of
another tile are an edge table, whose connected components say which labels are one region;
boxes and sizes are an aggregate. No task holds more than a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.kernels import regions as R
from proofsheet.tables import stored

from .graph import connected

#: Labels of a tile, with the border pixels (y << 32 | x) of each.
PARTS = "image long, node long, x0 long, y0 long, x1 long, y1 long, pixels long, border array<long>"
_KINDS = [pa.int64()] * 7 + [pa.list_(pa.int64())]


def labelled(tiles: DataFrame, size: int) -> DataFrame:
    """PARTS of every tile (image, ty, tx, width, mask): mask has the tile's rows one after another, `size` rows and columns but at the image's edge."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            masks = batch["mask"]
            for i, (image, ty, tx, width) in enumerate(zip(*(batch[c].to_pylist() for c in ("image", "ty", "tx", "width")), strict=True)):
                mask = masks[i].values.to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, width)
                marks = R.components(mask)
                y, x = np.nonzero(marks)
                if not len(y):
                    continue
                k = marks[y, x] - 1
                n = int(k.max()) + 1
                ends = np.zeros((4, n), np.int64)
                for j, (v, f) in enumerate(((x, np.minimum), (y, np.minimum), (x, np.maximum), (y, np.maximum))):
                    ends[j] = np.iinfo(np.int64).max if f is np.minimum else -1
                    f.at(ends[j], k, v)
                ends += np.array([[tx], [ty], [tx], [ty]]) * size
                edge = (y == 0) | (x == 0) | (y == mask.shape[0] - 1) | (x == width - 1)
                order = np.argsort(k[edge], kind="stable")
                places = ((y[edge] + ty * size).astype(np.int64) << 32 | (x[edge] + tx * size))[order]
                border = np.split(places, np.cumsum(np.bincount(k[edge], minlength=n))[:-1])
                base = (ty << 42) + (tx << 22)
                rows += [(image, base + j, *ends[:, j].tolist(), int(c), border[j].tolist()) for j, c in enumerate(np.bincount(k, minlength=n).tolist())]
            columns = zip(*rows, strict=True) if rows else [[] for _ in _KINDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])

    return tiles.select("image", "ty", "tx", "width", "mask").mapInArrow(label, PARTS)


def touching(parts: DataFrame, size: int) -> DataFrame:
    """(a, b): parts of different tiles with pixels side by side or corner to corner; ids are (image, node)."""
    ident = F.struct("image", "node")
    pixels = parts.select(ident.alias("id"), "image", F.explode("border").alias("at"))
    pixels = pixels.select("id", "image", F.shiftright("at", 32).alias("y"), F.col("at").bitwiseAND(F.lit(2**32 - 1)).alias("x"))
    # a pixel asks to the right and below only, so that each pair is met once
    near = F.array(*[F.struct((F.col("y") + dy).alias("ny"), (F.col("x") + dx).alias("nx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    asked = pixels.select("id", "image", "y", "x", F.explode(near).alias("n")).select("id", "image", (F.floor(F.col("y") / size) * 2**21 + F.floor(F.col("x") / size)).alias("tile"), "n.*")
    other = F.floor(F.col("ny") / size) * 2**21 + F.floor(F.col("nx") / size)
    asked = asked.filter((other != F.col("tile")) & (F.col("nx") >= 0)).select(F.col("id").alias("a"), "image", F.col("ny").alias("y"), F.col("nx").alias("x"))
    return asked.join(pixels.withColumnRenamed("id", "b"), ["image", "y", "x"]).select("a", "b").distinct()


def regions(tiles: DataFrame, size: int, least_box: int = 0) -> DataFrame:
    """Regions (8-connected) of each image whose box has least_box pixels or more: image, x, y, w, h, pixels."""
    parts = stored(labelled(tiles, size), "parts")
    labels = connected(touching(parts, size)).withColumnRenamed("label", "region")
    named = parts.withColumn("id", F.struct("image", "node")).join(labels, "id", "left").withColumn("region", F.coalesce("region", "id"))
    whole = named.groupBy("region").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") + 1 - F.min("x0")).alias("w"), (F.max("y1") + 1 - F.min("y0")).alias("h"), F.sum("pixels").alias("pixels"))
    return whole.filter(F.col("w") * F.col("h") >= least_box).select("region.image", "x", "y", "w", "h", "pixels")


def tiles_of(pixels: DataFrame, size: int) -> DataFrame:
    """Tiles of masks that are given by their set pixels (image, y, x); tiles without one are left out."""
    at = F.col("y") % size * size + F.col("x") % size
    found = pixels.groupBy("image", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx")).agg(F.collect_set(at).alias("set"))  # a tile's pixels
    mask = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.array_contains("set", i.cast("long")))
    return found.select("image", F.col("ty").cast("int").alias("ty"), F.col("tx").cast("int").alias("tx"), F.lit(size).alias("width"), mask.alias("mask"))
