import numpy as np
import pytest

from proofsheet.kernels import regions as R
from proofsheet.operators import graph
from proofsheet.operators import tiles as L


def cut(spark, masks, size):
    rows = []
    for image, m in masks.items():
        for ty in range(-(-m.shape[0] // size)):
            for tx in range(-(-m.shape[1] // size)):
                part = m[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size]
                rows.append((image, ty, tx, part.shape[1], part.astype(bool).ravel().tolist()))
    return spark.createDataFrame(rows, "image long, ty int, tx int, width int, mask array<boolean>").repartition(6)


def spiral(n):
    """A path of one pixel that winds to the middle: one region in all tiles."""
    m = np.zeros((n, n), np.uint8)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = 1
    turned = 0
    while turned < 2:
        ny, nx, fy, fx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if not (0 <= ny < n and 0 <= nx < n) or m[ny, nx] or (0 <= fy < n and 0 <= fx < n and m[fy, fx]):
            dy, dx, turned = dx, -dy, turned + 1
            continue
        y, x, turned = ny, nx, 0
        m[y, x] = 1
    return m


@pytest.mark.parametrize("size", [16, 64])
def test_tiles_give_the_regions_of_the_whole(spark, size):
    r = np.random.default_rng(size)
    masks = {1: (r.random((150, 130)) < 0.35).astype(np.uint8), 2: spiral(90), 3: np.zeros((40, 70), np.uint8), 4: np.ones((70, 33), np.uint8), 5: (r.random((64, 64)) < 0.5).astype(np.uint8)}
    want = sorted((i, x, y, w, h, n) for i, m in masks.items() for x, y, w, h, n in R.boxes(m, 4))
    got = sorted(map(tuple, L.regions(cut(spark, masks, size), size, 4).collect()))
    assert got == want


def test_pixels_as_tiles(spark):
    m = (np.random.default_rng(3).random((50, 45)) < 0.4).astype(np.uint8)
    pixels = spark.createDataFrame([(7, int(y), int(x)) for y, x in np.argwhere(m)], "image long, y long, x long")
    assert sorted(map(tuple, L.regions(L.tiles_of(pixels, 8), 8).collect())) == sorted((7, *b) for b in R.boxes(m))
    assert L.regions(L.tiles_of(pixels.filter("false"), 8), 8).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999), (5000, 5000)], "a long, b long")
    got = {r.id: r.label for r in graph.connected(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {999: 999, 1000: 999, 5000: 5000}
