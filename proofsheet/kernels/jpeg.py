"""Baseline JPEG files of arrays (ITU-T T.81).

Quantization follows a rule: a step for the mean and steeper steps for finer waves. Code words
are made for each file from its own symbol counts, so no tables are fixed.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

N = np.arange(8)
#: The cosine transform of eight samples.
WAVES = np.where(N[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * N[None] + 1) * N[:, None] * np.pi / 16)
#: Coefficients from coarse to fine: along the diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def steps(quality: int, colour: bool) -> np.ndarray:
    """Quantization steps (8 x 8) for a quality of 1 to 100; 50 is the middle, colours are coarser."""
    scale = 50 / quality if quality < 50 else 2 - quality / 50
    wave = N[:, None] + N[None]
    base = (17 + 12 * wave) if colour else (12 + 7 * wave)
    return np.clip(np.rint(base * scale), 1, 255).astype(np.int64)


def _planes(rgb: np.ndarray) -> np.ndarray:
    """Luma and colour differences in blocks (block, plane, 8, 8), about zero; edges are repeated to whole blocks."""
    h, w = rgb.shape[:2]
    a = np.pad(rgb, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    y = a @ [0.299, 0.587, 0.114]
    planes = np.stack([y - 128, (a[..., 2] - y) / 1.772, (a[..., 0] - y) / 1.402], 2)
    return planes.reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3).reshape(-1, 3, 8, 8)


def _quantized(rgb: np.ndarray, quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients in steps (block, plane, 8, 8), and the steps of each plane."""
    q = np.stack([steps(quality, k > 0) for k in range(3)])
    return np.rint(WAVES @ _planes(rgb) @ WAVES.T / q).astype(np.int64), q


def lossy(rgb: np.ndarray, quality: int) -> np.ndarray:
    """What a file of that quality shows."""
    h, w = rgb.shape[:2]
    found, q = _quantized(rgb, quality)
    # readers have whole numbers of eight bits in each plane before they turn them into colours
    y, cb, cr = np.clip(np.rint(WAVES.T @ (found * q) @ WAVES), -128, 127).transpose(1, 0, 2, 3)
    y = y + 128
    r, b = y + 1.402 * cr, y + 1.772 * cb
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    wide, high = -(-w // 8), -(-h // 8)
    whole = np.stack([r, g, b], 3).reshape(high, wide, 8, 8, 3).transpose(0, 2, 1, 3, 4).reshape(high * 8, wide * 8, 3)
    return np.clip(np.rint(whole[:h, :w]), 0, 255).astype(np.uint8)


def code_lengths(counts: np.ndarray, most: int = 16) -> dict[int, int]:
    """Length of each symbol's code word, `most` at most; room is left for a word of ones, which files don't use."""
    heap = [(int(n), 1, [int(s)]) for s, n in enumerate(counts) if n] + [(0, 1, [-1])]
    lengths = {s[0]: 0 for _, _, s in heap}
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, d, a), (m, e, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (n + m, max(d, e) + 1, a + b))
    lengths = {s: max(1, n) for s, n in lengths.items()}
    if max(lengths.values()) > most:  # shorten the longest and make others longer until all words fit
        lengths = {s: min(n, most) for s, n in lengths.items()}
        over = sum(1 << most - n for n in lengths.values()) - (1 << most)
        for s in sorted(lengths, key=lambda s: (-lengths[s], counts[s] if s >= 0 else -1)):
            while over > 0 and lengths[s] < most:
                lengths[s] += 1
                over -= 1 << most - lengths[s]
    longest = max(lengths.values())
    if lengths[-1] != longest:  # the word of ones is the last of the longest
        other = next(s for s, n in lengths.items() if n == longest)
        lengths[-1], lengths[other] = longest, lengths[-1]
    lengths.pop(-1)
    return lengths


def _words(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code word and length of each symbol, and the table as a file has it."""
    word, size, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    line = sorted(lengths, key=lambda s: (lengths[s], s))
    for s in line:
        code <<= lengths[s] - last
        word[s], size[s], last = code, lengths[s], lengths[s]
        code += 1
    return word, size, bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(line)


def _bits_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits a value takes, and these bits (a negative one's are those of its size, inverted)."""
    n = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return n, np.where(v < 0, v + (1 << n) - 1, v)


def jpeg(rgb: np.ndarray, quality: int = 85) -> bytes:
    """A colour file without subsampling."""
    h, w = rgb.shape[:2]
    found, q = _quantized(rgb, quality)
    flat = found.reshape(-1, 64)[:, ZIGZAG]  # a row for each block and plane, in the file's order
    plane = np.arange(len(flat)) % 3
    mean = flat[:, 0].reshape(-1, 3)
    n0, v0 = _bits_of(np.diff(mean, axis=0, prepend=0).ravel())
    row, at = np.nonzero(flat[:, 1:])
    first = np.append(True, row[1:] != row[:-1])
    gap = at - np.where(first, 0, np.append(0, at[:-1] + 1))
    n1, v1 = _bits_of(flat[row, at + 1])
    skips = gap // 16  # of sixteen zeros each
    ended = np.ones(len(flat), bool)
    ended[row[at == 62]] = False
    # all symbols with their order: block, then place; skips come before their coefficient
    parts = [
        (np.arange(len(flat)) * 256, n0, v0, n0, np.zeros(len(flat), bool)),
        (np.repeat(row * 256 + 2 * at + 1, skips), np.full(skips.sum(), 0xF0), np.zeros(skips.sum(), np.int64), np.zeros(skips.sum(), np.int64), np.ones(skips.sum(), bool)),
        (row * 256 + 2 * at + 2, gap % 16 * 16 + n1, v1, n1, np.ones(len(row), bool)),
        (np.flatnonzero(ended) * 256 + 255, np.zeros(ended.sum(), np.int64), np.zeros(ended.sum(), np.int64), np.zeros(ended.sum(), np.int64), np.ones(ended.sum(), bool)),
    ]
    order, symbol, value, more, fine = (np.concatenate(x) for x in zip(*parts, strict=True))
    line = np.argsort(order, kind="stable")
    symbol, value, more, fine, colour = symbol[line], value[line], more[line], fine[line], plane[order[line] // 256] > 0
    word, size, tables = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), b""
    for k in range(4):
        here = (fine == bool(k & 2)) & (colour == bool(k & 1))
        words, sizes, table = _words(code_lengths(np.bincount(symbol[here], minlength=256)))
        word[here], size[here] = words[symbol[here]], sizes[symbol[here]]
        tables += bytes([(k >> 1) << 4 | k & 1]) + table
    code, length = word << more | value, size + more
    ends = np.cumsum(length)
    bits = np.ones(-(-int(ends[-1]) // 8) * 8, np.uint8)
    for b in range(int(length.max())):
        here = np.flatnonzero(length > b)
        bits[ends[here] - 1 - b] = code[here] >> b & 1

    def part(mark: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data

    quants = b"".join(bytes([k]) + q[k].ravel()[ZIGZAG].astype(np.uint8).tobytes() for k in range(2))
    frame = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(3))
    scan = b"\x03" + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(3)) + b"\x00\x3f\x00"
    head = part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, quants) + part(0xC0, frame) + part(0xC4, tables) + part(0xDA, scan)
    return b"\xff\xd8" + head + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"
