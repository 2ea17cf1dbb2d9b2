"""Picture files of arrays: thumbnails, overlays and rendered fixtures."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .geometry import resize_area
from .jpeg import jpeg

COLOURS = {"red": (200, 30, 30), "amber": (220, 150, 20)}


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def fitted(rgb: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """At most `most` pixels on the longer side, and the scale."""
    scale = min(1.0, most / max(rgb.shape[:2]))
    return resize_area(rgb, max(1, round(rgb.shape[1] * scale)), max(1, round(rgb.shape[0] * scale))), scale


def thumbnail(rgb: np.ndarray, side: int = 320, quality: int = 88) -> bytes:
    return jpeg(fitted(rgb, side)[0], quality)


def overlay(rgb: np.ndarray, boxes: list[dict], most: int = 1200, opacity: float = 0.32, border: int = 2, quality: int = 85) -> bytes:
    """The image with its boxes filled and framed, as a JPEG file."""
    img, scale = fitted(rgb, most)
    out = img.astype(np.float32)
    for b in boxes:
        x, y, w, h = (round(b[k] * scale) for k in "xywh")
        colour = np.array(COLOURS[b.get("colour", "amber")], np.float32)
        part = out[y : y + h, x : x + w]
        part[:] = part * (1 - opacity) + colour * opacity
        for edge in (part[:border], part[-border:], part[:, :border], part[:, -border:]):
            edge[:] = colour
    return jpeg(out.astype(np.uint8), quality)


def pack(seed: int, side: int = 240, fields: int = 6) -> np.ndarray:
    """A rendered pack: a patterned ground, so that no edge counts as a border, and fields of bars that stand for lines of print."""
    r = np.random.default_rng(seed)
    tiles = r.integers(-45, 45, (side // 8, side // 8, 1)) + r.integers(110, 200, 3)
    img = np.kron(tiles, np.ones((8, 8, 1))).astype(np.uint8)
    step = (side - side // 4) // fields
    for k in range(fields):
        field(img, k, r.integers(0, 1 << 30), step)
    return img


def field(img: np.ndarray, k: int, value: int, step: int | None = None, fields: int = 6) -> tuple[int, int, int, int]:
    """Write a value's bars into field k in place; returns its box."""
    side = img.shape[0]
    step = step or (side - side // 4) // fields
    y, x, h, w = side // 4 + k * step, side // 12, step // 2, side * 2 // 3
    r = np.random.default_rng(value)
    img[y : y + h, x : x + w] = 235
    at = x
    while at < x + w - 8:
        n = int(r.integers(2, 7))
        img[y : y + h, at : at + n] = 30
        at += n + int(r.integers(2, 5))
    return x, y, w, h


def padded(img: np.ndarray, share: float = 1 / 12, value: int = 255) -> np.ndarray:
    n = round(img.shape[0] * share)
    return np.pad(img, ((n, n), (n, n), (0, 0)), constant_values=value)


def noisy(img: np.ndarray, seed: int, sigma: float = 3.0) -> np.ndarray:
    """Noise in blocks of eight, as compression leaves it."""
    r = np.random.default_rng(seed)
    return np.clip(img + r.normal(0, sigma, img.shape), 0, 255).astype(np.uint8)


# --- what a comparison shows of itself


def checkerboard(a: np.ndarray, b: np.ndarray, cells: int = 8) -> np.ndarray:
    """Two images laid over each other in alternating squares."""
    h, w = a.shape[:2]
    even = (np.arange(h)[:, None] * cells // h + np.arange(w)[None] * cells // w) % 2 == 0
    return np.where(even[..., None], a, b)


def heatmap(score: np.ndarray, ground: np.ndarray, opacity: float = 0.6) -> np.ndarray:
    """A difference map (1 at the threshold) in red over the image."""
    heat = np.clip(score / 2, 0, 1)[..., None] * opacity
    return np.rint(ground * (1 - heat) + np.array([255, 40, 0]) * heat).astype(np.uint8)


def match_lines(a: np.ndarray, b: np.ndarray, src: np.ndarray, dst: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Both images side by side with lines between matches: green where the homography agrees, else red."""
    h = max(a.shape[0], b.shape[0])
    out = np.full((h, a.shape[1] + b.shape[1], 3), 255, np.uint8)
    out[: a.shape[0], : a.shape[1]], out[: b.shape[0], a.shape[1] :] = a, b
    for (x0, y0), (x1, y1), good in zip(src, dst + [a.shape[1], 0], inside, strict=True):
        t = np.linspace(0, 1, int(np.hypot(x1 - x0, y1 - y0)) + 2)
        x, y = np.rint(x0 + t * (x1 - x0)).astype(int), np.rint(y0 + t * (y1 - y0)).astype(int)
        out[np.clip(y, 0, h - 1), np.clip(x, 0, out.shape[1] - 1)] = (20, 160, 60) if good else (200, 30, 30)
    return out


def stripped_overlay(img: np.ndarray, rect: tuple[float, float, float, float], opacity: float = 0.5) -> np.ndarray:
    """The image with the borders that the crop takes dimmed."""
    x, y, w, h = (round(v) for v in rect)
    out = np.rint(img * (1 - opacity) + np.array(COLOURS["amber"]) * opacity).astype(np.uint8)
    out[y : y + h, x : x + w] = img[y : y + h, x : x + w]
    return out


def magnified(crop: np.ndarray, least: int = 240) -> np.ndarray:
    """A crop enlarged by whole steps for display."""
    n = max(1, least // max(crop.shape[:2]))
    return np.kron(crop, np.ones((n, n, 1), np.uint8))
