import numpy as np
import pytest

from proofsheet.kernels import jpeg as J
from proofsheet.kernels.geometry import to_rgb
from proofsheet.sources.images import pixels


def smooth(h, w, seed=0):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    img = np.stack([128 + 100 * np.sin(x / 17 + k) * np.cos(y / (11 + k)) for k in range(3)], 2)
    img[h // 4 : h // 2, w // 4 : w // 2] = [200, 30, 30]
    return np.clip(img + r.normal(0, 2, img.shape), 0, 255).astype(np.uint8)


IMAGES = {"smooth": smooth(61, 90), "noise": np.random.default_rng(1).integers(0, 256, (40, 33, 3), np.uint8), "plain": np.full((16, 16, 3), 77, np.uint8), "dot": np.zeros((1, 1, 3), np.uint8), "wide": smooth(9, 400, 3)}


def test_files_are_read_by_others(spark, tmp_path):
    for quality in (30, 85, 100):
        for name, img in IMAGES.items():
            (tmp_path / f"{name}-{quality}.jpg").write_bytes(J.jpeg(img, quality))
    rows = {r.path.rpartition("/")[2]: r.image for r in pixels(spark, str(tmp_path)).collect()}
    assert len(rows) == 15
    for quality in (30, 85, 100):
        for name, img in IMAGES.items():
            i = rows[f"{name}-{quality}.jpg"]
            got = to_rgb(i.height, i.width, i.nChannels, bytes(i.data)).astype(int)
            assert got.shape == img.shape
            assert np.abs(got - J.lossy(img, quality)).max() <= 3  # the other decoder rounds in its own way
            if quality == 100:
                assert np.abs(got - img).mean() < 1.5


def test_better_quality_is_nearer_and_longer():
    img = IMAGES["smooth"]
    errors = [np.abs(J.lossy(img, q).astype(int) - img).mean() for q in (10, 50, 95)]
    sizes = [len(J.jpeg(img, q)) for q in (10, 50, 95)]
    assert errors == sorted(errors, reverse=True) and sizes == sorted(sizes)


@pytest.mark.parametrize("counts", [[1], [5, 0, 3], [2**k for k in range(30)], [1] * 256])
def test_code_words_fit(counts):
    full = np.zeros(256, np.int64)
    full[: len(counts)] = counts
    lengths = J.code_lengths(full)
    assert set(lengths) == set(np.flatnonzero(full)) and max(lengths.values()) <= 16
    assert sum(2.0**-n for n in lengths.values()) < 1  # the word of ones is free
