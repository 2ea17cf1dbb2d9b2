"""Approved artwork: hash groups, version chains, deltas, current versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import boxes
from proofsheet.tables import stored

#: A detected region belongs to a known edit if their overlap score is above this.
LEAST_OVERLAP = 0.3


def hash_exact(probes: DataFrame, versions: DataFrame) -> DataFrame:
    """probes (probe_id, product_id, sha) with the first version (by id) of the product that has the same bytes."""
    first = versions.groupBy("product_id", "sha").agg(F.min("version_id").alias("matched_id"))
    return probes.join(first, ["product_id", "sha"], "left").withColumn("confidence", F.when(F.col("matched_id").isNotNull(), 1.0))


def representatives(versions: DataFrame) -> DataFrame:
    """One version for each distinct content of a product, with the size of its group."""
    return versions.groupBy("product_id", "sha").agg(F.min("version_id").alias("version_id"), F.count("*").alias("group_size"))


def resolve_in_group(versions: DataFrame) -> DataFrame:
    """For each content of a product: the approved label if it is in the group, else the first."""
    lead = F.struct((~F.col("is_current")).alias("later"), F.col("version_id"))
    return versions.groupBy("product_id", "sha").agg(F.min_by("version_id", lead).alias("resolved_id"))


def current_versions(versions: DataFrame, flag: str = "flagged") -> DataFrame:
    """The current version of each product: the first one flagged, else the last of all."""
    lead = F.struct(F.when(F.col(flag), 0).otherwise(1).alias("a"), F.when(F.col(flag), F.col("version_id")).otherwise(-F.col("version_id")).alias("b"))
    return versions.groupBy("product_id").agg(F.min_by("version_id", lead).alias("current_id"))


def positioned(versions: DataFrame) -> DataFrame:
    """Versions with their place (from 1) in the product's chain."""
    return versions.withColumn("pos", F.row_number().over(Window.partitionBy("product_id").orderBy("version_id")).cast("long"))


def consecutive(versions: DataFrame, *carry: str) -> DataFrame:
    """Pairs of consecutive versions: product_id, from_id, to_id and the carried columns of both."""
    w = Window.partitionBy("product_id").orderBy("version_id")
    rows = versions.select("product_id", F.col("version_id").alias("from_id"), F.lead("version_id").over(w).alias("to_id"), *[F.col(c).alias(f"from_{c}") for c in carry], *[F.lead(c).over(w).alias(f"to_{c}") for c in carry])
    return rows.filter("to_id is not null")


def path_regions(regions: DataFrame, findings: DataFrame) -> DataFrame:
    """Regions on the chain from the matched to the current place of each finding.

    regions: product_id, from_pos, to_pos, ...; findings: finding_id, product_id, i, j. None if i >= j. A finding asks for
    each hop of its path, so that it meets these only and not all regions of its product.
    """
    hops = regions.filter(F.col("to_pos") == F.col("from_pos") + 1)
    asked = findings.filter("i < j").withColumn("from_pos", F.explode(F.sequence(F.col("i").cast("long"), F.col("j").cast("long") - 1)))
    return asked.join(hops.withColumn("from_pos", F.col("from_pos").cast("long")), ["product_id", "from_pos"])


def chain_labels(versions: DataFrame, i: Column, j: Column) -> DataFrame:
    """The labels of a product's chain from place i to j, both included; empty if i > j."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("version_id"))), lambda v: v["version_id"].cast("string"))
    return versions.groupBy("product_id").agg(line.alias("chain")).withColumn("labels", F.when(i <= j, F.slice("chain", i, j - i + 1)).otherwise(F.array().cast("array<string>"))).drop("chain")


#: Pairs of boxes under one key from which they are met by cells of a grid, and the levels of cells (sides of 2**level).
MANY_PAIRS, LEVELS = 1_000_000, range(3, 16)


def _level(box: str) -> Column:
    """The level whose cells are as large as the box, so that it touches four of them at most."""
    side = F.greatest(F.col(f"{box}.w"), F.col(f"{box}.h"), F.lit(1)).cast("double")
    return F.least(F.lit(LEVELS[-1]), F.greatest(F.lit(LEVELS[0]), F.ceil(F.log2(side)).cast("int")))


def _in_cells(rows: DataFrame, box: str) -> DataFrame:
    """rows once for each cell of level_ that the box touches."""
    cell = F.pow(F.lit(2.0), F.col("level_"))

    def along(low: Column, size: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / cell), F.floor((low + F.greatest(size, F.lit(1)) - 1) / cell)))

    x, y, w, h = (F.col(f"{box}.{c}").cast("long") for c in "xywh")
    return rows.withColumn("cx_", along(x, w)).withColumn("cy_", along(y, h))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], box_a: str, box_b: str) -> DataFrame:
    """Pairs of rows with equal keys whose boxes overlap.

    Boxes lie in the cells of grids of several levels. A pair meets at the level of its larger box, in the cells that both
    touch, and belongs to the cell of the overlap's first corner. So a key with many boxes is dealt out by place, and small boxes
    never meet in a large cell.
    """
    p, q = ({c: F.col(f"{x}.{c}").cast("long") for c in "xywh"} for x in (box_a, box_b))
    x0, y0 = F.greatest(p["x"], q["x"]), F.greatest(p["y"], q["y"])
    inside = (x0 < F.least(p["x"] + p["w"], q["x"] + q["w"])) & (y0 < F.least(p["y"] + p["h"], q["y"] + q["h"]))
    cell = F.pow(F.lit(2.0), F.col("level_"))
    owner = (F.floor(x0 / cell) == F.col("cx_")) & (F.floor(y0 / cell) == F.col("cy_"))

    def met(large: DataFrame, box: str, small: DataFrame, other: str, strictly: bool) -> DataFrame:
        large = large.withColumn("level_", _level(box))
        there = [r[0] for r in large.select("level_").distinct().collect()]  # of LEVELS
        own = _level(other)
        above = F.filter(F.array(*map(F.lit, there)), lambda x: (x > own) if strictly else (x >= own))
        small = small.withColumn("level_", F.explode(above if there else F.array().cast("array<int>")))
        return _in_cells(large, box).join(_in_cells(small, other), [*keys, "level_", "cx_", "cy_"]).filter(inside & owner).drop("level_", "cx_", "cy_")

    return met(a, box_a, b, box_b, False).unionByName(met(b, box_b, a, box_a, True))


#: Side of the tiles in which many boxes are counted, boxes of one key that a task counts, and tiles a box up to which a key is counted so.
TILE, COUNTED, MOST_TILES = 128, 1_000_000, 16
#: What a pixel is part of: itself, a pair with the next one in its row or its column, a square of four.
PARTS = [(0, 0), (1, 0), (0, 1), (1, 1)]
SUMS = "key_ long, tx int, ty int, side int, sums binary"


def _tiles(box: str) -> list[tuple[Column, Column]]:
    """First and last tile of a box in each direction."""
    x, y, w, h = (F.col(f"{box}.{c}").cast("long") for c in "xywh")
    return [(F.floor(low / TILE), F.floor((low + size - 1) / TILE)) for low, size in ((x, w), (y, h))]


def _corner_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of boxes in tiles, sorted by group: for each of PARTS the differences whose running sums say how many boxes hold it."""
    n, held, sums = TILE + 1, None, np.zeros(0, np.int32)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**dict(zip(("key_", "tx", "ty", "side"), held[:4], strict=True)), "sums": sums.tobytes()}], pa.schema([("key_", pa.int64()), ("tx", pa.int32()), ("ty", pa.int32()), ("side", pa.int32()), ("sums", pa.binary())]))

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("key_", "tx", "ty", "side", "salt")], 1)
        x0, x1, y0, y1 = (batch[c].to_numpy().astype(np.int64) for c in ("x0", "x1", "y0", "y1"))
        starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1)))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
            if (now := tuple(group[s].tolist())) != held:
                if held is not None:
                    yield row()
                held, sums = now, np.zeros(len(PARTS) * n * n, np.int32)
            for i, (dx, dy) in enumerate(PARTS):
                left, right, top, end = x0[s:e], np.minimum(x1[s:e] - dx, TILE), y0[s:e], np.minimum(y1[s:e] - dy, TILE)
                for at, by in ((top * n + left, 1), (end * n + right, 1), (top * n + right, -1), (end * n + left, -1)):
                    np.add.at(sums, at + i * n * n, np.int32(by))
    if held is not None:
        yield row()


def _met(f: pd.DataFrame) -> pd.DataFrame:
    """Pairs and common pixels of one tile's boxes of both sides."""
    held = []
    for side in (0, 1):
        sums = np.zeros((len(PARTS), TILE + 1, TILE + 1), np.int64)
        for one in f.loc[f["side"] == side, "sums"]:
            sums += np.frombuffer(one, np.int32).reshape(sums.shape)
        held.append(sums.cumsum(1).cumsum(2))
    pixels, rows, columns, squares = (held[0] * held[1]).sum((1, 2)).tolist()
    return pd.DataFrame({"key_": f["key_"].iloc[:1], "pairs": [pixels - rows - columns + squares], "area": [pixels]})


def overlap_totals(a: DataFrame, b: DataFrame, keys: list[str], box_a: str, box_b: str) -> DataFrame:
    """keys, pairs, area: how many pairs of boxes overlap under each key, and the sum of their common areas.

    Keys with more than MANY_PAIRS pairs are summed without making a pair. The common pixels of two boxes form a box, which has one pixel
    more than it has neighbours in a row and in a column less squares of four; so the pairs are the sums, over all pixels, of how many boxes of
    either side hold each of PARTS, multiplied. The work follows the boxes and the tiles that they touch; keys of very large boxes are met in pairs.
    """
    def side(rows: DataFrame, box: str, count: str) -> DataFrame:
        (l, r), (t, e) = _tiles(box)
        return rows.groupBy(*keys).agg(F.count("*").alias(count), F.sum((r - l + 1) * (e - t + 1)).alias(f"{count}_tiles"))

    per = side(a, box_a, "n").join(side(b, box_b, "m"), keys).filter(F.col("n") * F.col("m") > MANY_PAIRS).filter(F.col("n_tiles") + F.col("m_tiles") <= MOST_TILES * (F.col("n") + F.col("m")))
    dense = stored(per.select(*keys, F.ceil((F.col("n") + F.col("m")) / COUNTED).cast("int").alias("salts")).withColumn("key_", F.monotonically_increasing_id()), "dense")

    def rest(rows: DataFrame) -> DataFrame:
        return rows.join(dense, keys, "left_anti")

    def dealt(rows: DataFrame, box: str, number: int) -> DataFrame:
        (l, r), (t, e) = _tiles(box)
        x, y, w, h = (F.col(f"{box}.{c}").cast("long") for c in "xywh")
        rows = rows.join(dense, keys).filter((w > 0) & (h > 0)).withColumns({"salt": F.pmod(F.xxhash64(x, y, w, h), F.col("salts")).cast("int"), "side": F.lit(number)})
        rows = rows.withColumn("tx", F.explode(F.sequence(l, r))).withColumn("ty", F.explode(F.sequence(t, e)))
        within = {f"{c}{i}": v.cast("short") for c, o, z in (("x", x - F.col("tx") * TILE, w), ("y", y - F.col("ty") * TILE, h)) for i, v in enumerate((F.greatest(o, F.lit(0)), F.least(o + z, F.lit(TILE + 1))))}
        return rows.select("key_", F.col("tx").cast("int"), F.col("ty").cast("int"), "side", "salt", *[v.alias(c) for c, v in within.items()])

    p, q = F.col(box_a), F.col(box_b)
    total = lambda rows: rows.agg(F.sum("pairs").alias("pairs"), F.sum("area").alias("area"))
    met = overlapping(rest(a), rest(b), keys, box_a, box_b).groupBy(*keys).agg(F.count("*").alias("pairs"), F.sum(boxes.overlap(p, q)).cast("long").alias("area"))
    if not dense.limit(1).count():
        return met
    group = ["key_", "tx", "ty", "side", "salt"]
    sums = dealt(a, box_a, 0).unionByName(dealt(b, box_b, 1)).repartition(*group).sortWithinPartitions(*group).mapInArrow(_corner_sums, SUMS)
    counted = total(sums.groupBy("key_", "tx", "ty").applyInPandas(_met, "key_ long, pairs long, area long").groupBy("key_")).filter("pairs > 0")
    return met.unionByName(counted.join(dense, "key_").select(*keys, "pairs", "area"))


def match_edits(regions: DataFrame, edits: DataFrame, keys: list[str], least: float = LEAST_OVERLAP) -> DataFrame:
    """Each region with its best edit by overlap score, above `least`; the first of equals.

    regions: keys, region_id, box; edits: keys, edit_pos, edit_box. Keys with more than MANY_PAIRS pairs are met by place.
    """
    score = boxes.overlap_score(F.col("box"), F.col("edit_box"))
    n = regions.groupBy(*keys).agg(F.count("*").alias("n")).join(edits.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    many = stored(n.filter(F.col("n") * F.col("m") > MANY_PAIRS).select(*keys), "many")
    if many.limit(1).count():
        few = regions.join(many, keys, "left_anti").join(edits, keys)
        dense = overlapping(regions.join(many, keys, "left_semi"), edits.join(many, keys, "left_semi"), keys, "box", "edit_box")
        pairs = few.unionByName(dense)
    else:
        pairs = regions.join(edits, keys)
    pairs = pairs.withColumn("score", score).filter(F.col("score") > least)
    return pairs.groupBy("region_id").agg(F.max_by(F.struct("edit_pos", "score"), F.struct("score", -F.col("edit_pos"))).alias("m")).select("region_id", "m.edit_pos", "m.score")


def collapse_global(regions: DataFrame, width: int, height: int, min_regions: int, area_fraction: float) -> DataFrame:
    """Regions by image; many that span a large part of it become one."""
    x1, y1 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    all_ = regions.groupBy("image").agg(F.count("*").alias("n"), F.min("x").alias("ux"), F.min("y").alias("uy"), (x1 - F.min("x")).alias("uw"), (y1 - F.min("y")).alias("uh"))
    wide = all_.filter((F.col("n") >= min_regions) & (F.col("uw") * F.col("uh") / float(width * height) >= area_fraction))
    one = wide.select("image", F.col("ux").alias("x"), F.col("uy").alias("y"), F.col("uw").alias("w"), F.col("uh").alias("h"))
    return regions.join(wide.select("image"), "image", "left_anti").select("image", "x", "y", "w", "h").unionByName(one)
