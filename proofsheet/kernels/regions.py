"""Masks and their connected regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def slid(a: np.ndarray, size: tuple[int, int], f, fill) -> np.ndarray:
    """f (np.maximum or np.minimum) over a window of (rows, columns); `fill` stands for what lies outside."""
    for axis, n in enumerate(size):
        before = n // 2
        pad = [(0, 0)] * a.ndim
        pad[axis] = (before, n - 1 - before)
        wide = np.pad(a, pad, constant_values=fill)
        views = [wide[(slice(None),) * axis + (slice(i, i + a.shape[axis]),)] for i in range(n)]
        if n < 8:
            a = views[0].copy() if n == 1 else f(views[0], views[1])
            for v in views[2:]:
                f(a, v, out=a)
            continue
        # long windows from windows of twice the length each
        line, have = wide, 1
        while have < n:
            step = min(have, n - have)
            size = line.shape[axis] - step
            line = f(line[(slice(None),) * axis + (slice(0, size),)], line[(slice(None),) * axis + (slice(step, step + size),)])
            have += step
        a = line
    return a


def dilate(a: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    return slid(a, size, np.maximum, a.min() if a.size else 0)


def erode(a: np.ndarray, size: tuple[int, int], border: int | None = None) -> np.ndarray:
    """border: the value outside; None ignores what lies outside."""
    return slid(a, size, np.minimum, (a.max() if a.size else 0) if border is None else border)


def opened(mask: np.ndarray, n: int) -> np.ndarray:
    return dilate(erode(mask, (n, n)), (n, n)) if n > 1 else mask


def closed(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    return erode(dilate(mask, size), size) if max(size) > 1 else mask


def components(mask: np.ndarray) -> np.ndarray:
    """Labels (from 1) of 8-connected components: runs of each row, joined to touching runs of the row above."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    root = np.arange(len(row))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:  # ends are exclusive, so this touches diagonally too
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    _, label = np.unique([find(i) for i in range(len(row))], return_inverse=True) if len(row) else (0, np.zeros(0, int))
    out = np.zeros((h, w), np.int32)
    for y, s, e, n in zip(row, start, end, label, strict=True):
        out[y, s:e] = n + 1
    return out


def boxes(mask: np.ndarray, least_box: float = 0) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, pixels) of the components whose box has at least `least_box` pixels, by y, x, w, h."""
    label = components(mask)
    y, x = np.nonzero(label)
    k = label[y, x] - 1
    n = int(k.max()) + 1 if len(k) else 0
    low, high = np.full((2, n), max(mask.shape)), np.zeros((2, n), int)
    for i, v in enumerate((x, y)):
        np.minimum.at(low[i], k, v)
        np.maximum.at(high[i], k, v)
    size = np.bincount(k, minlength=n)
    found = [(int(low[0, i]), int(low[1, i]), int(high[0, i] - low[0, i] + 1), int(high[1, i] - low[1, i] + 1), int(size[i])) for i in range(n)]
    return sorted((b for b in found if b[2] * b[3] >= least_box), key=lambda b: (b[1], b[0], b[2], b[3]))


def mask_regions(vectors: DataFrame, threshold: float, least_box: int, width: int = 8, close: tuple[int, int] = (1, 1)) -> DataFrame:
    """Regions of v > threshold in each image (vec_id, embedding): image, x, y, w, h, pixels."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *b) for i, e in zip(f["vec_id"], f["embedding"], strict=True) for b in boxes(closed((np.asarray(e, np.float64).reshape(-1, width) > threshold).astype(np.uint8), close), least_box)]
            yield pd.DataFrame(rows, columns=["image", "x", "y", "w", "h", "pixels"], dtype="int64")

    return vectors.select("vec_id", "embedding").mapInPandas(find, "image long, x long, y long, w long, h long, pixels long")


def truth_box(a: np.ndarray, b: np.ndarray, least: int = 8) -> tuple[int, int, int, int] | None:
    """Bounding box of pixels that differ by more than `least` in some channel."""
    y, x = np.nonzero(np.abs(a.astype(np.int16) - b).max(-1) > least)
    return (int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1) if len(x) else None
