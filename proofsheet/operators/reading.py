"""Reading of regions: crops go to an engine, differing readings are read again, reliability is a column.

An engine is a name, whether it can be used here, and a function from an image to its tokens (text, confidence,
corners). Engines are registered; without one nothing is read and every region is unreliable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import text as X
from proofsheet.kernels import geometry as G
from proofsheet.tables import stored

Token = tuple[str, float, list[tuple[float, float]]]


@dataclass(frozen=True)
class Engine:
    """read: tokens of an RGB image; it runs in Spark's Python workers."""

    name: str
    read: Callable[[np.ndarray], list[Token]]
    available: bool = True


NULL = Engine("none", lambda image: [], available=False)
#: Engines that `auto` tries, in this order.
AUTO = ["paddle", "rapid"]
_engines: dict[str, Callable[[], Engine]] = {}


def register(name: str, factory: Callable[[], Engine]) -> None:
    _engines[name] = factory


def engine(name: str = "auto") -> Engine:
    """The engine of that name, an error if there is none; `auto` takes the first that is available, else none."""
    if name == "none":
        return NULL
    if name == "auto":
        return next((e for n in AUTO if n in _engines and (e := _engines[n]()).available), NULL)
    if name not in _engines:
        raise KeyError(f"no engine {name}; there are {', '.join(_engines) or 'none'}")
    return _engines[name]()


@dataclass(frozen=True)
class Reading:
    """Settings: least long side and greatest scale of a crop, longest side read, white margin, scale of the second reading, gates."""

    least_edge: int = 300
    most_scale: float = 3.0
    most_edge: int = 2400
    quiet_px: int = 24
    consistency_scale: float = 0.8
    least_confidence: float = 0.55
    ink_kept: float = 0.55


CORNERS = "array<struct<x:double,y:double>>"
TOKENS = f"array<struct<text:string,confidence:double,corners:{CORNERS}>>"


def prepared(crop: np.ndarray, s: Reading, factor: float = 1.0) -> np.ndarray:
    """A crop enlarged for reading, with a white margin."""
    scale = G.reading_scale(crop, s.least_edge, s.most_scale) * factor
    scale = min(scale, s.most_edge / max(crop.shape[:2]))
    h, w = (max(1, round(n * scale)) for n in crop.shape[:2])
    gy, gx = np.meshgrid((np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5, indexing="ij")
    big = np.rint(G.sample(crop, gx, gy)).astype(np.uint8) if scale != 1 else crop
    return np.pad(big, ((s.quiet_px,) * 2, (s.quiet_px,) * 2, (0, 0)), constant_values=255)


def read(crops: DataFrame, reader: Engine, s: Reading, factor: float = 1.0) -> DataFrame:
    """crops (pair_id, ordinal, ref, mkt as image structs) to pair_id, ordinal, ref_tokens, mkt_tokens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tokens(image) -> list[dict]:
            if image is None:
                return []
            rgb = G.to_rgb(image["height"], image["width"], image["nChannels"], image["data"])
            return [{"text": t, "confidence": float(c), "corners": [{"x": float(x), "y": float(y)} for x, y in q]} for t, c, q in reader.read(prepared(rgb, s, factor))]

        for f in frames:
            yield pd.DataFrame({"pair_id": f["pair_id"], "ordinal": f["ordinal"], "ref_tokens": [tokens(x) for x in f["ref"]], "mkt_tokens": [tokens(x) for x in f["mkt"]]})

    return crops.select("pair_id", "ordinal", "ref", "mkt").mapInPandas(run, f"pair_id string, ordinal int, ref_tokens {TOKENS}, mkt_tokens {TOKENS}")


def quad_box(corners: Column) -> Column:
    """The box around a quadrilateral (an array of x, y)."""
    x, y = F.transform(corners, lambda c: c["x"]), F.transform(corners, lambda c: c["y"])
    return F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("w"), (F.array_max(y) - F.array_min(y)).alias("h"))


def line_text(tokens: Column, band: float = 0.6) -> Column:
    """Readable tokens in lines of about their median height, from left to right, joined by spaces."""
    kept = F.transform(F.filter(tokens, lambda t: t["text"].rlike("[A-Za-z0-9]")), lambda t: F.struct(t["text"].alias("text"), quad_box(t["corners"]).alias("b")))

    def joined(rows: Column) -> Column:
        heights = F.array_sort(F.transform(rows, lambda r: r["b"]["h"]))
        n = F.size(rows)
        median = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
        height = F.greatest(F.lit(1.0), band * F.coalesce(median, F.lit(0.0)))
        line = F.array_sort(F.transform(rows, lambda r, i: F.struct(F.bround(r["b"]["y"] / height, 0).alias("line"), r["b"]["x"].alias("x"), i.alias("i"), r["text"].alias("text"))))
        return F.array_join(F.transform(line, lambda r: r["text"]), " ")

    return X.let(kept, joined)


def readings(crops: DataFrame, reader: Engine = NULL, settings: Reading | None = None) -> DataFrame:
    """pair_id, ordinal, ref_text, mkt_text, ink_intact, reliable of regions that are to be read.

    crops: pair_id, ordinal, ref, mkt (image structs), ink (ratio of the region's ink, null if there is little). Only
    regions whose readings differ are read again, at another scale. A reading is unreliable if the second differs from
    the first, if a token's confidence is low, if one side was not read though its ink is there, or without an engine.
    """
    s = settings or Reading()
    least = lambda c: F.coalesce(F.array_min(F.transform(c, lambda t: t["confidence"])), F.lit(1.0))
    first = read(crops, reader, s).withColumns({"ref_text": line_text(F.col("ref_tokens")), "mkt_text": line_text(F.col("mkt_tokens"))})
    first = X.with_comparison(first, "ref_text", "mkt_text", "c").select("pair_id", "ordinal", "ref_text", "mkt_text", F.least(least("ref_tokens"), least("mkt_tokens")).alias("confidence"), (F.col("c.kind") != "NO_DIFFERENCE").alias("differs"))
    first = stored(first, "readings")
    again = read(crops.join(first.filter("differs").select("pair_id", "ordinal"), ["pair_id", "ordinal"], "left_semi"), reader, s, s.consistency_scale)
    again = again.select("pair_id", "ordinal", line_text(F.col("ref_tokens")).alias("ref_again"), line_text(F.col("mkt_tokens")).alias("mkt_again"))
    rows = first.join(again, ["pair_id", "ordinal"], "left").join(crops.select("pair_id", "ordinal", "ink"), ["pair_id", "ordinal"], "left")
    for c in ("ref", "mkt"):
        rows = rows.withColumns({f"{c}_n": X.normalized(F.col(f"{c}_text")), f"{c}_m": X.normalized(F.coalesce(f"{c}_again", f"{c}_text"))})
    stable = (F.col("ref_n") == F.col("ref_m")) & (F.col("mkt_n") == F.col("mkt_m"))
    intact = ((F.col("ref_n") != "") != (F.col("mkt_n") != "")) & (F.coalesce("ink", F.lit(0.0)) >= s.ink_kept)
    reliable = F.lit(reader.available) & stable & (F.col("confidence") >= s.least_confidence) & ~intact
    return rows.select("pair_id", "ordinal", "ref_text", "mkt_text", intact.alias("ink_intact"), reliable.alias("reliable"))
