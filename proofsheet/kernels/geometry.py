"""Geometry of images (H x W x 3 uint8 arrays): crops, resizing, alignment, homographies."""

from __future__ import annotations

import numpy as np


def to_rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB of a row of Spark's image source (BGR, BGRA or grey); alpha goes over white."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, 2)
    rgb = a[:, :, 2::-1]
    if channels == 3:
        return np.ascontiguousarray(rgb)
    alpha = a[:, :, 3:].astype(np.float32) / 255
    return np.rint(rgb * alpha + 255 * (1 - alpha)).astype(np.uint8)


def ycrcb(rgb: np.ndarray) -> np.ndarray:
    """Luma and the two colour differences (ITU-R BT.601), as float."""
    r, g, b = (rgb[..., i].astype(np.float32) for i in range(3))
    y = np.float32(0.299) * r + np.float32(0.587) * g + np.float32(0.114) * b
    out = np.empty((*y.shape, 3), np.float32)
    out[..., 0], out[..., 1], out[..., 2] = y, (r - y) * np.float32(0.713) + 128, (b - y) * np.float32(0.564) + 128
    return out


def deviations(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean distance of each row and of each column from its own median."""
    f = img.astype(np.float32)
    return tuple(np.abs(f - np.median(f, axis=k, keepdims=True)).mean(axis=(k, 2)) for k in (1, 0))


def uniform_run(dev: np.ndarray, tolerance: float, most: int) -> tuple[int, int]:
    """How many lines at either end are uniform, `most` at most."""
    flat = np.concatenate([dev <= tolerance, [False]])
    back = np.concatenate([dev[::-1] <= tolerance, [False]])
    return min(int(flat.argmin()), most), min(int(back.argmin()), most)


def edge_place(dev: np.ndarray, at: int, step: int) -> float:
    """Where the profile crosses the middle between outside and inside near line `at`, to parts of a pixel."""
    n = len(dev)
    outer = [dev[i] for i in range(at - 4 * step, at, step) if 0 <= i < n]
    inner = [dev[i] for i in range(at, at + 4 * step, step) if 0 <= i < n]
    if not outer or not inner:
        return float(at)
    low, high, prev = np.median(outer), np.median(inner), at - step
    if high <= low or not 0 <= prev < n or dev[at] == dev[prev]:
        return float(at)
    share = np.clip(((low + high) / 2 - dev[prev]) / (dev[at] - dev[prev]), 0, 1)
    return at - step * float(1 - share)


def content_rect(img: np.ndarray, tolerance: float = 10.0, most: float = 0.3) -> tuple[float, float, float, float]:
    """(x, y, w, h) of the content; uniform borders go whatever their colour. A degenerate crop keeps all."""
    h, w = img.shape[:2]
    rows, cols = deviations(img)
    (top, bottom), (left, right) = uniform_run(rows, tolerance, int(h * most)), uniform_run(cols, tolerance, int(w * most))
    if left + right >= w - 1 or top + bottom >= h - 1:
        return 0.0, 0.0, float(w), float(h)
    y0 = edge_place(rows, top, 1) if top else 0.0
    x0 = edge_place(cols, left, 1) if left else 0.0
    y1 = edge_place(rows, h - 1 - bottom, -1) + 1 if bottom else float(h)
    x1 = edge_place(cols, w - 1 - right, -1) + 1 if right else float(w)
    return x0, y0, x1 - x0, y1 - y0


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, outside: float | None = None) -> np.ndarray:
    """Bilinear values at (x, y); beyond the edge the edge is repeated, or `outside` stands."""
    h, w = img.shape[:2]
    x, y = (np.clip(np.nan_to_num(v, nan=-1e6), -1e6, 1e6) for v in (x, y))  # a degenerate map has no place for some
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    at = lambda yy, xx: img[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)].astype(np.float32)
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    if outside is not None:
        out[(x < 0) | (y < 0) | (x > w - 1) | (y > h - 1)] = outside
    return out


def extract(img: np.ndarray, rect: tuple[float, float, float, float]) -> np.ndarray:
    """The content: a slice on whole pixels, else resampled."""
    x, y, w, h = rect
    if all(abs(v - round(v)) < 1e-3 for v in rect):
        x, y, w, h = (int(round(v)) for v in rect)
        return img[y : y + h, x : x + w]
    gx, gy = np.meshgrid(x + np.arange(max(1, round(w))), y + np.arange(max(1, round(h))))
    return np.rint(sample(img, gx, gy)).astype(np.uint8)


def _lines(a: np.ndarray, m: int) -> np.ndarray:
    """a's lines (axis 0) averaged to m lines by area: differences of running sums at the target's edges."""
    n = len(a)
    if n == m:
        return a.astype(np.float64)
    sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0, dtype=np.float64)])
    edges = np.arange(m + 1) * (n / m)
    at = np.minimum(edges.astype(int), n - 1)
    return np.diff(sums[at] + (edges - at).reshape(-1, *[1] * (a.ndim - 1)) * a[at], axis=0) * (m / n)


def resize_area(img: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = img.shape[:2]
    if (w, h) == (width, height):
        return img
    rows = _lines(img, height)
    return np.rint(np.round(_lines(rows.transpose(1, 0, 2), width).transpose(1, 0, 2), 6)).astype(np.uint8)


def spectrum(grey: np.ndarray) -> np.ndarray:
    """Spectrum of a grey image under a window that fades its edges."""
    win = np.outer(np.hanning(grey.shape[0]), np.hanning(grey.shape[1])).astype(np.float32)
    return np.fft.rfft2(grey.astype(np.float32) * win)


def offset(a: np.ndarray, b: np.ndarray, shape: tuple[int, int], most: int = 24) -> tuple[int, int]:
    """(dx, dy) by which the image of spectrum b is shifted against that of a, by phase correlation; (0, 0) beyond `most`."""
    cross = b * np.conj(a)
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-9), shape)
    dy, dx = (int(v) for v in np.unravel_index(peak.argmax(), peak.shape))
    dy, dx = (v - n if v > n // 2 else v for v, n in ((dy, shape[0]), (dx, shape[1])))
    return (dx, dy) if max(abs(dx), abs(dy)) <= most else (0, 0)


def translation(a: np.ndarray, b: np.ndarray, most: int = 24) -> tuple[int, int]:
    """(dx, dy) by which b is shifted against a (grey images)."""
    return offset(spectrum(a), spectrum(b), a.shape, most)


def shift(img: np.ndarray, dx: int, dy: int) -> np.ndarray:
    h, w = img.shape[:2]
    if not dx and not dy:
        return img
    return img[np.clip(np.arange(h) - dy, 0, h - 1)][:, np.clip(np.arange(w) - dx, 0, w - 1)]


class Sized:
    """An image at the size in which it is compared last, with what comparisons need of it, each made once."""

    def __init__(self, rgb: np.ndarray):
        self.rgb, self.made = rgb, {}

    def of(self, what: str, size: tuple[int, int], make) -> np.ndarray:
        if self.made and next(iter(self.made))[1] != size:
            self.made = {}
        if (what, size) not in self.made:
            self.made[what, size] = make()
        return self.made[what, size]

    def image(self, size: tuple[int, int]) -> np.ndarray:
        return self.of("image", size, lambda: resize_area(self.rgb, *size))

    def channels(self, size: tuple[int, int]) -> np.ndarray:
        return self.of("channels", size, lambda: ycrcb(self.image(size)))

    def spectrum(self, size: tuple[int, int]) -> np.ndarray:
        return self.of("spectrum", size, lambda: spectrum(self.channels(size)[..., 0]))


def aligned(probe: Sized, reference: Sized) -> tuple[tuple[int, int], tuple[int, int], float]:
    """The smaller size of each axis, the shift that lays the probe over the reference, and the scale of the reference."""
    size = min(probe.rgb.shape[1], reference.rgb.shape[1]), min(probe.rgb.shape[0], reference.rgb.shape[0])
    p, r = probe.image(size), reference.image(size)
    dx, dy = offset(reference.spectrum(size), probe.spectrum(size), (size[1], size[0]))
    off = lambda a: np.abs(a.astype(np.int16) - r).mean()
    # flat print leaves little to correlate; a shift that doesn't help is none
    helps = (dx or dy) and off(shift(p, -dx, -dy)) < off(p)
    return size, (-dx, -dy) if helps else (0, 0), size[0] / reference.rgb.shape[1]


def prepared(probe: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both at the smaller size of each axis, the probe aligned; and the scale of the reference."""
    p, r = Sized(probe), Sized(reference)
    size, by, scale = aligned(p, r)
    return shift(p.image(size), *by), r.image(size), scale


def corners(grey: np.ndarray, most: int = 400, apart: int = 5) -> np.ndarray:
    """(n, 2) places (x, y) of the strongest corners (least eigenvalue of the structure tensor)."""
    from .regions import dilate

    gy, gx = np.gradient(grey.astype(np.float32))

    def blur(a: np.ndarray, n: int = 5) -> np.ndarray:
        wide = np.pad(a.astype(np.float64), n // 2 + 1, mode="constant")[:-1, :-1]
        c = wide.cumsum(0).cumsum(1)
        return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]) / (n * n)

    xx, yy, xy = blur(gx * gx), blur(gy * gy), blur(gx * gy)
    least = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    edge = 12
    top = (least == dilate(least, (apart, apart))) & (least > 1e-3 * least.max())
    top[:edge], top[-edge:], top[:, :edge], top[:, -edge:] = False, False, False, False
    y, x = np.nonzero(top)
    order = np.argsort(-least[y, x], kind="stable")[:most]
    return np.stack([x[order], y[order]], 1)


def directions(grey: np.ndarray, at: np.ndarray, radius: int = 8) -> np.ndarray:
    """Angle from each place to the centre of brightness of the disc around it, which turns with the image."""
    g = np.arange(-radius, radius + 1)
    disc = (g[:, None] ** 2 + g[None] ** 2 <= radius * radius).astype(np.float32)
    h, w = grey.shape
    part = grey[np.clip(at[:, 1, None, None] + g[:, None], 0, h - 1), np.clip(at[:, 0, None, None] + g, 0, w - 1)] * disc
    return np.arctan2((part * g[:, None]).sum((1, 2)), (part * g).sum((1, 2)))


def patches(grey: np.ndarray, at: np.ndarray, radius: int = 8, angle: np.ndarray | None = None) -> np.ndarray:
    """Normalized patch around each place, turned by its angle."""
    g = np.arange(-radius, radius + 1, dtype=np.float32)
    c, s = (np.ones(len(at)), np.zeros(len(at))) if angle is None else (np.cos(angle), np.sin(angle))
    x = at[:, 0, None, None] + c[:, None, None] * g - s[:, None, None] * g[:, None]
    y = at[:, 1, None, None] + s[:, None, None] * g + c[:, None, None] * g[:, None]
    p = sample(grey[..., None], x, y)[..., 0].reshape(len(at), -1).astype(np.float32)
    p -= p.mean(1, keepdims=True)
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-6)


def keypoints(grey: np.ndarray, most: int = 400, levels: int = 4, step: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) in the image and descriptors, which don't change with scale and rotation: corners of smaller and smaller images, each patch turned to its own direction."""
    places, found, scale = [], [], 1.0
    for _ in range(levels):
        h, w = (round(n * scale) for n in grey.shape)
        if min(h, w) < 48:
            break
        img = grey if scale == 1 else _lines(_lines(grey, h).T, w).T.astype(np.float32)
        at = corners(img, max(40, round(most * scale * scale)))
        if len(at):
            places.append((at + 0.5) * [grey.shape[1] / w, grey.shape[0] / h] - 0.5)
            found.append(patches(img, at, angle=directions(img, at)))
        scale *= step
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros((0, 2)), np.zeros((0, 289), np.float32))


def matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.75) -> np.ndarray:
    """(n, 2) indices whose nearest neighbour is nearer than `ratio` times the second one."""
    if len(a) == 0 or len(b) < 2:
        return np.zeros((0, 2), int)
    d = np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))
    two = np.argsort(d, axis=1, kind="stable")[:, :2]
    first, second = np.take_along_axis(d, two, 1).T
    i = np.flatnonzero(first < ratio * second)
    return np.stack([i, two[i, 0]], 1)


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Direct linear transform with normalized points."""

    def norm(p):
        m, s = p.mean(0), np.sqrt(2) / max(np.linalg.norm(p - p.mean(0), axis=1).mean(), 1e-9)
        return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])

    t, u = norm(src), norm(dst)
    (x, y), (p, q) = ((np.c_[v, np.ones(len(v))] @ m.T).T[:2] for v, m in ((src, t), (dst, u)))
    o, z = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([-x, -y, -o, z, z, z, p * x, p * y, p], 1), np.stack([z, z, z, -x, -y, -o, q * x, q * y, q], 1)])
    h = np.linalg.inv(u) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ t
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / np.where(np.abs(q[:, 2:]) < 1e-12, 1e-12, q[:, 2:])


def _four_point(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homographies through four points each, (m, 4, 2) to (m, 4, 2); degenerate draws give whatever solves them."""
    (x, y), (p, q) = src.transpose(2, 0, 1).astype(float), dst.transpose(2, 0, 1).astype(float)
    o, z = np.ones_like(x), np.zeros_like(x)
    a = np.concatenate([np.stack([x, y, o, z, z, z, -p * x, -p * y], 2), np.stack([z, z, z, x, y, o, -q * x, -q * y], 2)], 1)
    a = a + 1e-9 * np.eye(8)
    h = np.linalg.solve(a, np.concatenate([p, q], 1)[..., None])[..., 0]
    return np.concatenate([h, np.ones((len(h), 1))], 1).reshape(-1, 3, 3)


#: Draws that are tried together, and how sure the search wants to be.
BATCH, CONFIDENCE = 200, 0.999


def ransac(src: np.ndarray, dst: np.ndarray, pixels: float = 3.0, rounds: int = 2000, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """Homography from src to dst with the most inliers, and which they are; the seed fixes the draws."""
    none = np.zeros(len(src), bool)
    if len(src) < 4:
        return None, none
    r, best, done = np.random.default_rng(seed), none, 0
    while done < rounds:
        m = min(BATCH, rounds - done)
        done += m
        four = r.random((m, len(src))).argsort(1)[:, :4]
        every = _four_point(src[four], dst[four])
        q = np.einsum("mij,nj->mni", every, np.c_[src, np.ones(len(src))])
        q = q[..., :2] / np.where(np.abs(q[..., 2:]) < 1e-12, 1e-12, q[..., 2:])
        inside = np.linalg.norm(q - dst, axis=2) < pixels
        i = int(inside.sum(1).argmax())
        if inside[i].sum() > best.sum():
            best = inside[i]
        # so many draws that one of four inliers was among them with all but certainty
        if done * -np.log1p(-min(best.mean() ** 4, 1 - 1e-9)) >= -np.log(1 - CONFIDENCE):
            break
    if best.sum() < 4:
        return None, none
    h = fit_homography(src[best], dst[best])
    return h, np.linalg.norm(project(h, src) - dst, axis=1) < pixels


def corner_error(h: np.ndarray, true: np.ndarray, width: int, height: int) -> float:
    """Mean distance of an image's corners through two homographies."""
    c = np.array([[0, 0], [width, 0], [0, height], [width, height]], float)
    return float(np.linalg.norm(project(h, c) - project(true, c), axis=1).mean())


def _sources(h: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of a canvas comes from under h."""
    gx, gy = np.meshgrid(np.arange(width), np.arange(height))
    p = project(np.linalg.inv(h), np.stack([gx.ravel(), gy.ravel()], 1).astype(float))
    return p[:, 0].reshape(gx.shape), p[:, 1].reshape(gx.shape)


def covered(h: np.ndarray, width: int, height: int, canvas_width: int, canvas_height: int) -> np.ndarray:
    """Where an image of that size, seen through h, has values on a canvas."""
    return _within(*_sources(h, canvas_width, canvas_height), width, height)


def _within(x: np.ndarray, y: np.ndarray, width: int, height: int) -> np.ndarray:
    return (x >= 0) & (y >= 0) & (x <= width - 1) & (y <= height - 1)


def warp(img: np.ndarray, h: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """img seen through h on a canvas (white outside), and where it has values."""
    x, y = _sources(h, width, height)
    return np.rint(sample(img, x, y, 255.0)).astype(np.uint8), _within(x, y, img.shape[1], img.shape[0])


def reading_crop(img: np.ndarray, box: tuple[int, int, int, int], share: float = 0.10, lines: float = 1.4) -> np.ndarray:
    """A region with room for the words it cuts: sideways by lines of print (a line is no taller than twice the box's width), little above and below."""
    x, y, w, h = box
    line = min(h, max(2 * w, 8))
    dx = max(round(w * share), round(line * lines)) + 2
    dy = max(round(h * share), round(h * 0.25)) + 2
    part = img[max(0, y - dy) : y + h + dy, max(0, x - dx) : x + w + dx]
    return part if part.size else np.zeros((1, 1, 3), np.uint8)


def reading_scale(crop: np.ndarray, least_edge: int = 300, most: float = 3.0) -> float:
    """How much to enlarge a crop for reading."""
    return min(most, max(1.0, least_edge / max(crop.shape[:2])))


def stripped_share(raw: tuple[int, int], content: tuple[int, int]) -> float:
    """Share of the area that the border crop took."""
    return max(0.0, 1 - content[0] * content[1] / (raw[0] * raw[1]))
