"""Word hashes and shingle sets of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers, one for each place in a shingle.
PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {i}".encode()) | 1 for i in range(16)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


#: Numbers for the bytes and an odd base with its inverse, all modulo 2**64.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * C1)
BASE = int(C2)
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse, longer as needed
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> list[np.ndarray]:
    if len(POWERS[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return POWERS


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words, words of each text, each word's last byte and the one before (0 if none).

    Words are lower-cased (A-Z) runs of UTF-8 bytes other than ASCII white space. A hash is the
    sum of the bytes' numbers by powers of a base, mixed; sums run over all texts at once.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = LOWER[np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)]
    gap = SPACE[b]
    first, last = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _powers(len(b))
    sums = np.cumsum(BYTE[b] * up[: len(b)], dtype=np.uint64)
    h = mixed((sums[last] - sums[first - 1]) * down[first])
    n = np.diff(np.searchsorted(first, np.cumsum([1, *(len(r) + 1 for r in raw)])))
    return h, n, b[last], np.where(last > first, b[last - 1], 0)


def _set(w: np.ndarray, k: int) -> np.ndarray:
    if len(w) == 0:
        return w
    n, size = max(1, len(w) - k + 1), min(k, len(w))
    h = np.full(n, np.uint64(size))
    for i in range(size):
        h += w[i : i + n] * PLACES[i]
    return np.unique(mixed(h))


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct k-word shingles; fewer words are one shingle, none give none."""
    h, n, _, _ = word_hashes(texts)
    ends = np.cumsum(n)
    return [_set(h[e - m : e], k) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
