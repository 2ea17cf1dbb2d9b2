"""Image operators on a table of pixels (image, y, x, v): all windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 8


def pixels(vectors: DataFrame, width: int = SIDE) -> DataFrame:
    """Vectors (vec_id, embedding) as images of one channel."""
    rows = vectors.select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select("image", F.floor(F.col("pos") / width).cast("long").alias("y"), (F.col("pos") % width).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def separable(rows: DataFrame, f, column: str, out: str, radius: int) -> DataFrame:
    """f over a square window, rows first and columns then; what lies outside the image is ignored."""
    along = Window.partitionBy("image", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("image", "x").orderBy("y").rowsBetween(-radius, radius)
    return rows.withColumn("f_", f(column).over(along)).withColumn(out, f("f_").over(down)).drop("f_")


def dilate(rows: DataFrame, column: str, out: str, radius: int = 1) -> DataFrame:
    return separable(rows, F.max, column, out, radius)


def erode(rows: DataFrame, column: str, out: str, radius: int = 1) -> DataFrame:
    return separable(rows, F.min, column, out, radius)


def opened(rows: DataFrame, mask: str, out: str, radius: int = 1) -> DataFrame:
    return dilate(erode(rows, mask, "e_", radius), "e_", out, radius).drop("e_")


def band_difference(probe: DataFrame, reference: DataFrame, radius: int = 1) -> DataFrame:
    """How far a pixel lies outside the range of the reference's neighbourhood."""
    band = erode(dilate(reference, "v", "hi", radius), "v", "lo", radius).select("image", "y", "x", "hi", "lo")
    d = F.greatest(F.col("v") - F.col("hi"), F.col("lo") - F.col("v"), F.lit(0.0))
    return probe.join(band, ["image", "y", "x"]).withColumn("d", d)


def top_mean(values: Column, fraction: float, cap: float) -> Column:
    """Mean of the highest share (one value at least) of an array clipped to 0..cap; an empty one gives 0."""
    clipped = F.reverse(F.array_sort(F.transform(values, lambda v: F.greatest(F.lit(0.0), F.least(v.cast("double"), F.lit(float(cap)))))))
    k = F.greatest(F.lit(1), F.floor(F.size(values) * fraction).cast("int"))
    total = F.aggregate(F.slice(clipped, 1, k), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) == 0, 0.0).otherwise(total / k)


def border_crop(rows: DataFrame, tolerance: float, most: float, side: int = SIDE) -> DataFrame:
    """Content box (x, y, w, h) of each image: uniform lines are cut from each edge, up to a share of the side.

    A line is uniform if its mean distance from its own median is within the tolerance.
    """
    limit = int(side * most)

    def edges(line: str, across: str, names: tuple[str, str]) -> DataFrame:
        middle = rows.withColumn("m", F.median("v").over(Window.partitionBy("image", line)))
        dev = middle.groupBy("image", line).agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("dev")).withColumn("stop", (F.col("dev") > tolerance).cast("int"))
        first, last = F.min(F.when(F.col("stop") == 1, F.col(line))), F.max(F.when(F.col("stop") == 1, F.col(line)))
        return dev.groupBy("image").agg(F.least(F.coalesce(first, F.lit(side)), F.lit(limit)).cast("long").alias(names[0]), F.greatest(F.coalesce(last, F.lit(-1)), F.lit(side - 1 - limit)).cast("long").alias(names[1]))

    both = edges("y", "x", ("top", "bottom")).join(edges("x", "y", ("left_", "right_")), "image")
    bad = (F.col("right_") <= F.col("left_")) | (F.col("bottom") <= F.col("top"))
    out = lambda c, full: F.when(bad, full).otherwise(c).cast("long")
    return both.select("image", out(F.col("left_"), 0).alias("x"), out(F.col("top"), 0).alias("y"), out(F.col("right_") - F.col("left_") + 1, side).alias("w"), out(F.col("bottom") - F.col("top") + 1, side).alias("h"))
