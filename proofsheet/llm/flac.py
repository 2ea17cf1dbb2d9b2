"""FLAC streams: a decoder and an encoder in numpy, many frames in step.

The decoder handles streams of 1 to 8 channels and up to 32 bits, of fixed and of variable
block size: constant, verbatim, fixed and linear-predictor subframes, wasted bits, side
channels, Rice and escaped partitions. It checks every header's CRC-8, every frame's CRC-16
and the stream's MD5 (if there is one), and gives PCM blocks with their sample offsets. A
frame ends where the next one begins and its CRC-16 is right, so bytes within a frame that
look like a header do no harm. Frames are decoded together, some CHUNK_BYTES of them at a
time: step t reads the t-th residual of all of them.

The encoder writes one fixed block size, linear predictors with quantized coefficients, one
Rice parameter a frame, and a seek table if a stream is long. Payloads of bytes are stored as 8-bit samples
(byte - 128).

The query writes the media column to a table in the shared folder, reads it back, decodes it
to PCM blocks and folds each row's blocks, which follow each other, to its features.

Defined results: null text counts as empty and gives one block of padding; equal texts give
equal streams; a damaged or unknown stream gives one row with the reason in `error` among the
PCM blocks and raises in the query; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own, slices, stored, texts_of

BLOCK, FRAME, RATE, ORDER, PRECISION = 576, 1152, 8000, 6, 7
#: Fixed values of the format: coefficients of the fixed predictors, newest sample first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
BLOCK_CODES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
REST = (np.int64(1) << (40 - np.arange(8))) - 1
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10
SEEK_EVERY = 64
CHUNK_BYTES = 1 << 20


def _table(poly: int, bits: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        c = np.where(c >> (bits - 1) & 1, (c << 1) ^ poly, c << 1) & ((1 << bits) - 1)
    return c


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_of(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of each run raw[start:start+length]."""
    order = np.argsort(-length, kind="stable")
    start, length, crc = start[order], length[order], np.zeros(len(start), np.uint32)
    live = len(start) - np.searchsorted(length[::-1], np.arange(1, int(length.max(initial=0)) + 1))
    for t, n in enumerate(live):
        c = crc[:n]
        crc[:n] = CRC16[(c >> 8) ^ raw[start[:n] + t]] ^ ((c << 8) & 0xFFFF)
    out = np.zeros_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """The format's UTF-8 style coding of a frame number below 2**31."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


def _coefficients(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantized predictor of each row of x by Levinson-Durbin: (rows, order) ints and shifts."""
    f = x.astype(np.float64)
    auto = np.stack([(f[:, : f.shape[1] - k] * f[:, k:]).sum(1) for k in range(order + 1)], 1)
    err, a = auto[:, 0] * (1 + 1e-9) + 1e-9, np.zeros((len(x), order))
    for i in range(order):
        r = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)) / err
        prev = a[:, :i].copy()
        a[:, i] = r
        a[:, :i] = prev - r[:, None] * prev[:, ::-1]
        err = np.maximum(err * (1 - r * r), 1e-9)
    most = np.abs(a).max(1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(most, 1e-9) * (1 + 1e-9))).astype(int), 0, 14)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Write width-bit values, most significant bit first, at bit positions `at`."""
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _frames(x: np.ndarray, numbers: np.ndarray, order: int) -> list[bytes]:
    """Frames of equal length with these samples and numbers."""
    n, size = x.shape
    coef, shift = _coefficients(x, order)
    guess = np.zeros((n, size - order), np.int64)
    for j in range(order):
        guess += coef[:, j : j + 1] * x[:, order - 1 - j : size - 1 - j]
    res = x[:, order:] - (guess >> shift[:, None])
    fold = np.where(res < 0, -2 * res - 1, 2 * res)
    sizes = np.stack([(fold >> k).sum(1) + (1 + k) * fold.shape[1] for k in range(min(15, int(fold.max()).bit_length() + 1))], 1)
    k = sizes.argmin(1)
    code = next(c for c, b in BLOCK_CODES.items() if b == size)
    heads = [bytes([0xFF, 0xF8, code << 4 | 4, 2]) + _utf8_number(i) for i in numbers.tolist()]
    heads = [h + bytes([crc8(h)]) for h in heads]
    head_len = np.array([len(h) for h in heads])
    fixed_bits = 8 + 8 * order + 4 + 5 + PRECISION * order + 2 + 4 + 4
    frame_len = head_len + (fixed_bits + sizes[np.arange(n), k] + 7) // 8 + 2
    end = np.cumsum(frame_len)
    start = end - frame_len
    bits = np.zeros(8 * int(end[-1]), np.uint8)
    at = 8 * (start + head_len)
    _put(bits, at, np.full(n, 0x40 | (order - 1) << 1), 8)
    at = at + 8
    for j in range(order):
        _put(bits, at, x[:, j] & 0xFF, 8)
        at = at + 8
    _put(bits, at, np.full(n, PRECISION - 1), 4)
    _put(bits, at + 4, shift, 5)
    at = at + 9
    for j in range(order):
        _put(bits, at, coef[:, j] & ((1 << PRECISION) - 1), PRECISION)
        at = at + PRECISION
    at = at + 6  # Rice coding with 4-bit parameters, one partition
    _put(bits, at, k, 4)
    stop = fold >> k[:, None]
    width = stop + 1 + k[:, None]
    place = (at + 4)[:, None] + np.cumsum(width, 1) - width + stop
    bits[place] = 1
    for b in range(int(k.max())):
        rows = np.flatnonzero(k > b)
        bits[place[rows] + (k[rows, None] - b)] = (fold[rows] >> b) & 1
    raw = np.packbits(bits)
    for h, s in zip(heads, start.tolist(), strict=True):
        raw[s : s + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16_of(raw, start, frame_len - 2)
    raw[end - 2], raw[end - 1] = crc >> 8, crc & 0xFF
    whole = raw.tobytes()
    return [whole[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]


#: Frames that are coded at once.
CODED_FRAMES = 512


def encode(payloads: list[bytes], order: int = ORDER, sizes: bool = True) -> list[bytes]:
    """A FLAC stream for each payload (a positive multiple of BLOCK bytes): frames of FRAME samples, the last of fewer blocks.

    CODED_FRAMES frames are in work at a time, however long a payload is. Without sizes the stream information doesn't say how large
    frames are, which the format allows: in short streams that takes room.
    """
    raw = [np.frombuffer(p, np.uint8) for p in payloads]
    cuts: dict[int, list[tuple[int, int]]] = {}  # places of frames by their size
    for i, x in enumerate(raw):
        for k, at in enumerate(range(0, len(x), FRAME)):
            cuts.setdefault(min(FRAME, len(x) - at), []).append((i, k))
    frames: list[list[bytes]] = [[b""] * -(-len(x) // FRAME) for x in raw]
    for size, places in cuts.items():
        for at in range(0, len(places), CODED_FRAMES):
            some = places[at : at + CODED_FRAMES]
            x = np.stack([raw[i][k * FRAME : k * FRAME + size] for i, k in some]).astype(np.int64) - 128
            for (i, k), f in zip(some, _frames(x, np.array([k for _, k in some]), order), strict=True):
                frames[i][k] = f
    out = []
    for x, own_ in zip(raw, frames, strict=True):
        lens = [len(f) for f in own_]
        ends = min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big") if sizes else bytes(6)
        info = struct.pack(">HH", FRAME, FRAME) + ends + ((RATE << 44) | (7 << 36) | len(x)).to_bytes(8, "big") + hashlib.md5((x ^ np.uint8(128)).tobytes()).digest()
        starts = np.cumsum([0, *lens]).tolist()
        points = b"".join(struct.pack(">QQH", k * FRAME, starts[k], min(FRAME, len(x) - k * FRAME)) for k in range(0, len(own_), SEEK_EVERY)) if len(own_) > SEEK_EVERY else b""
        seek = b"\x83" + len(points).to_bytes(3, "big") + points if points else b""  # a short stream needs none
        out.append(b"fLaC" + (b"\x00" if seek else b"\x80") + len(info).to_bytes(3, "big") + info + seek + b"".join(own_))
    return out


def _header(data: bytes, at: int) -> tuple[int, int, int, int, int, int] | None:
    """(number of frame or sample, block size, bytes of the header, channel code, sample size code, variable) at a frame start, or None."""
    if data[at : at + 1] != b"\xff" or at + 6 > len(data) or data[at + 1] & 0xFE != 0xF8:
        return None
    size, rate, lead = data[at + 2] >> 4, data[at + 2] & 15, data[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    n = lead if not more else lead & (0x3F >> more)
    for b in data[at + 5 : at + 5 + more]:
        n = n << 6 | b & 0x3F
    end = at + 5 + more
    block = BLOCK_CODES.get(size, 0)
    if size in (6, 7):
        block = int.from_bytes(data[end : end + size - 5], "big") + 1
        end += size - 5
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if data[at + 3] >> 4 > MID_SIDE or not block or end >= len(data) or crc8(data[at:end]) != data[end]:
        return None
    return n, block, end + 1 - at, data[at + 3] >> 4, data[at + 3] >> 1 & 7, data[at + 1] & 1


def _crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC16[(c >> 8) ^ b]) ^ ((c << 8) & 0xFFFF)
    return c


def parse(stream: bytes, closing: bool = False) -> tuple[dict, list[tuple[int, int, int, int, int, int]]]:
    """Stream information and the frames: (start, header bytes, end, block size, channel code, bits).

    closing: a frame ends only where its CRC-16 is right; otherwise at the first header with the next number.
    """
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info = 4, False, {"seek": []}
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the stream ends within its metadata")
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            info |= {"rate": word >> 44, "channels": (word >> 41 & 7) + 1, "bits": (word >> 36 & 31) + 1, "samples": word & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            info["seek"] = [struct.unpack_from(">QQH", body, i) for i in range(0, n, 18)]
        at += 4 + n
    if "bits" not in info:
        raise ValueError("no stream information")
    frames, place, expected = [], at, 0
    while place >= 0:
        head = _header(stream, place)
        if head and head[0] == expected and (not frames or not closing or _closes(stream, frames[-1][0], place)):
            n, block, size, layout, code, variable = head
            frames.append((place, size, block, layout, SAMPLE_BITS.get(code, info["bits"])))
            expected += block if variable else 1
        elif not frames:
            break
        place = min((x for x in (stream.find(b"\xff\xf8", place + 1), stream.find(b"\xff\xf9", place + 1)) if x >= 0), default=-1) if head and head[5] else stream.find(b"\xff\xf8" if stream[at + 1] == 0xF8 else b"\xff\xf9", place + 1)
    if info["samples"] and not frames:
        raise ValueError("no frames")
    ends = [f[0] for f in frames[1:]] + [len(stream)]
    return info, [(s, h, e, b, c, d) for (s, h, b, c, d), e in zip(frames, ends, strict=True)]


def _closes(stream: bytes, start: int, end: int) -> bool:
    return end - start > 8 and _crc16(stream[start : end - 2]) == int.from_bytes(stream[end - 2 : end], "big")


def _wrong(raw: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Which frames' CRC-16 is wrong."""
    start, end = frames[:, 0], frames[:, 2]
    said = raw[end - 2].astype(np.uint32) << 8 | raw[end - 1]
    return (end - start < 8) | (crc16_of(raw, start, end - start - 2) != said)


def decode(streams: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """Information and samples (int32; a column a channel if there are more than one) of each stream; raises on a wrong checksum."""
    parsed = [parse(s) for s in streams]
    raw = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    frames = [np.array(f, np.int64).reshape(-1, 6) + [b, 0, b, 0, 0, 0] for b, (_, f) in zip(base, parsed, strict=False)]
    none = np.zeros((0, 6), np.int64)
    owner = np.repeat(np.arange(len(streams)), [len(f) for f in frames])
    doubtful = np.unique(owner[_wrong(raw, np.concatenate([*frames, none]))]).tolist()
    for i in doubtful:  # bytes within a frame may look like the next header
        frames[i] = np.array(parse(streams[i], closing=True)[1], np.int64).reshape(-1, 6) + [base[i], 0, base[i], 0, 0, 0]
    if doubtful and _wrong(raw, np.concatenate([frames[i] for i in doubtful])).any():
        raise ValueError("wrong CRC-16 of a frame")
    every, owner = np.concatenate([*frames, none]), np.repeat(np.arange(len(streams)), [len(f) for f in frames])
    pieces: list[list[np.ndarray]] = [[] for _ in streams]
    at = 0
    while at < len(every):
        end = max(at + 1, int(np.searchsorted(every[:, 2], every[at, 0] + CHUNK_BYTES, "right")))
        part, first = every[at:end], every[at, 0]
        x = _samples(raw[first : every[end - 1, 2] + 16], part - [first, 0, first, 0, 0, 0])
        for i in np.unique(owner[at:end]).tolist():
            rows = np.flatnonzero(owner[at:end] == i)
            channels, block = parsed[i][0]["channels"], part[rows, 3]
            y = x[:channels, rows]
            pieces[i].append(y.reshape(channels, -1) if (block == x.shape[2]).all() else np.concatenate([y[:, j, :n] for j, n in enumerate(block)], 1))
        at = end
    out = []
    for (info, _), p in zip(parsed, pieces, strict=True):
        samples = np.concatenate([np.zeros((info["channels"], 0), np.int64), *p], 1).astype(np.int32)
        if info["md5"] != bytes(16) and hashlib.md5(pcm_of(info, samples.T)).digest() != info["md5"]:
            raise ValueError("wrong MD5 of the samples")
        out.append((info, samples[0] if info["channels"] == 1 else samples.T))
    return out


def pcm_of(info: dict, samples: np.ndarray) -> bytes:
    """Interleaved little-endian samples of as many bytes as the bits need."""
    wide = (info["bits"] + 7) // 8
    if wide == 1:
        return samples.astype(np.int8).tobytes()
    return np.ascontiguousarray(samples, "<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()


def _samples(raw: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """(channels, frames, samples) of frames (start, header bytes, end, block size, channel code, bits) that lie in raw, 16 bytes before its end."""
    start, head, _, block, layout, bits = frames.T
    word = np.zeros(len(raw) - 4, np.int64)  # 40 bits from each byte on
    for j in range(5):
        word = word << 8 | raw[j : len(raw) - 4 + j]
    n = np.where(layout < 8, layout + 1, 2)
    out = np.zeros((int(n.max()), len(frames), int(block.max())), np.int64)
    pos = 8 * (start + head)
    for c in range(len(out)):
        rows = np.flatnonzero(n > c)
        side = ((layout[rows] == LEFT_SIDE) | (layout[rows] == MID_SIDE)) & (c == 1) | (layout[rows] == SIDE_RIGHT) & (c == 0)
        out[c, rows, : int(block[rows].max())], pos[rows] = _subframes(word, pos[rows], block[rows], bits[rows] + side)
    if len(out) > 1:
        a, b = out[0].copy(), out[1].copy()
        for code, left, right in ((LEFT_SIDE, a, a - b), (SIDE_RIGHT, a + b, b), (MID_SIDE, ((a << 1 | b & 1) + b) >> 1, ((a << 1 | b & 1) - b) >> 1)):
            rows = layout == code
            out[0][rows], out[1][rows] = left[rows], right[rows]
    return out


def _subframes(word: np.ndarray, pos: np.ndarray, block: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of one subframe of each frame, from bit pos on, and where it ends. word: 40 bits from each byte on."""

    def bits_at(pos, width):
        """Unsigned bits; widths up to 33, 0 gives 0."""
        return (word[pos >> 3] >> (40 - (pos & 7) - width)) & ((1 << width) - 1)

    def signed(v, width):
        return v - ((v >> np.maximum(width - 1, 0) & 1) << width)

    def next_one(p):
        """The next bit that is set, from bit p on."""
        rest = word[p >> 3] & REST[p & 7]
        at = p + 40 - (p & 7) - np.frexp(rest.astype(np.float64))[1]
        for i in np.flatnonzero(rest == 0).tolist():  # a run over 32 zeros and more, which is rare
            byte = int(p[i] >> 3) + 5
            while byte < len(word) and not word[byte]:
                byte += 5
            if byte >= len(word):
                raise ValueError("the residual runs over the stream's end")
            at[i] = 8 * byte + 40 - int(word[byte]).bit_length()
        return at

    n, most, pos = len(pos), int(block.max()), pos.copy()
    kind, waste = bits_at(pos, np.int64(8)) >> 1, bits_at(pos, np.int64(8)) & 1
    pos = pos + 8
    wasted = np.zeros(n, np.int64)
    if waste.any():
        rows = np.flatnonzero(waste)
        wasted[rows] = next_one(pos[rows]) - pos[rows] + 1
    pos, depth = pos + wasted, depth - wasted
    lpc, fixed, constant, verbatim = kind >= 32, (kind >= 8) & (kind <= 12), kind == 0, kind == 1
    if not (lpc | fixed | constant | verbatim).all() or (depth < 1).any():
        raise ValueError("reserved subframe type")
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, np.where(constant, 1, block)))
    if (order > block).any():
        raise ValueError("more warm-up samples than the block has")
    x = np.zeros((n, most), np.int64)
    for t in range(int(order.max())):
        rows = np.flatnonzero(t < order)
        x[rows, t] = signed(bits_at(pos[rows], depth[rows]), depth[rows])
        pos[rows] += depth[rows]
    coef, shift = np.zeros((n, 32), np.int64), np.zeros(n, np.int64)
    if lpc.any():
        rows = np.flatnonzero(lpc)
        wide = bits_at(pos[rows], np.int64(4)) + 1
        shift[rows] = signed(bits_at(pos[rows] + 4, np.int64(5)), np.int64(5))
        if (shift < 0).any():
            raise ValueError("negative shift of a predictor")
        pos[rows] += 9
        for j in range(int(order[rows].max())):
            sub = j < order[rows]
            r = rows[sub]
            coef[r, j] = signed(bits_at(pos[r], wide[sub]), wide[sub])
            pos[r] += wide[sub]
    for o in range(1, 5):
        coef[np.ix_(fixed & (order == o), range(o))] = FIXED[o]
    coded = lpc | fixed
    rows = np.flatnonzero(coded)
    if len(rows):
        p, width, o, b = pos[rows], np.where(bits_at(pos[rows], np.int64(2)) == 1, 5, 4), order[rows], block[rows]
        part = b >> bits_at(p + 2, np.int64(4))
        if (part < 1).any():
            raise ValueError("empty partitions")
        p = p + 6
        k, raw_bits = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        sizes, steps = np.unique(part).tolist(), int(o.min())
        res, limit = np.zeros((len(rows), most), np.int64), 8 * len(word) - 1
        for t in range(steps, most):
            live = (t >= o) & (t < b)
            if t <= int(o.max()) or any(t % x == 0 for x in sizes):
                new = np.flatnonzero(live & ((t == o) | (t % part == 0)))
                k[new] = bits_at(p[new], width[new])
                p[new] += width[new]
                esc = k[new] == (1 << width[new]) - 1
                raw_bits[new] = np.where(esc, bits_at(p[new], np.int64(5)), -1)
                p[new] += 5 * esc
            one = next_one(np.where(live, p, 0))  # rows that are done look at the first frame's sync code
            kk = np.where(raw_bits < 0, k, 0)
            if (one + kk).max() >= limit:
                raise ValueError("the residual runs over the stream's end")
            v = (one - p) << kk | bits_at(one + 1, kk)
            v = (v >> 1) ^ -(v & 1)
            after = one + 1 + kk
            if (raw_bits >= 0).any():
                e = raw_bits >= 0
                w = np.maximum(raw_bits, 0)
                v, after = np.where(e, signed(bits_at(p, w), w), v), np.where(e, p + w, after)
            res[:, t] = np.where(live, v, 0)
            p = np.where(live, after, p)
        pos[rows] = p
        top = int(o.max())
        y, c, s = np.zeros((top + most, len(rows)), np.int64), coef[rows].T.copy(), shift[rows]
        y[top:] = x[rows].T
        res = res.T.copy()
        c = c[:top]
        for t in range(most):
            guess = (c * y[t : t + top][::-1]).sum(0) >> s if top else 0
            y[top + t] = np.where(t < o, y[top + t], guess + res[t])
        x[rows] = y[top:].T
    x[constant] = x[constant, :1]
    return x << wasted[:, None], pos


def decoded(streams: list[bytes]) -> list[tuple[dict, np.ndarray] | str]:
    """As decode, but a stream that can't be decoded gives the reason."""
    try:
        return decode(streams)
    except (ValueError, IndexError, KeyError, struct.error) as e:
        if len(streams) == 1:
            return [str(e) or type(e).__name__]
        return [x for s in streams for x in decoded([s])]


BLOCKS = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("row", T.LongType()), ("block", T.IntegerType()), ("sample_offset", T.LongType()), ("pcm", T.BinaryType()), ("error", T.StringType())]])
BLOCK_SAMPLES = 32 * BLOCK


def pcm_blocks(media: DataFrame, blob: str = "media", block_samples: int = BLOCK_SAMPLES, keep: tuple[str, ...] = ()) -> DataFrame:
    """PCM of media (doc_id, blob, and row, if there is one) in blocks with sample offsets (BLOCKS, and the columns to keep); a row's blocks follow each other."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, blob, 1 << 20):
            at, cols = [], [[], [], [], []]
            for i, got in enumerate(decoded([x or b"" for x in batch[blob].to_pylist()])):
                if isinstance(got, str):
                    found = [(0, 0, None, got)]
                else:
                    info, x = got
                    found = [(k, j, pcm_of(info, x[j : j + block_samples]), None) for k, j in enumerate(range(0, len(x), block_samples))]
                at += [i] * len(found)
                for c, v in zip(cols, zip(*found, strict=True), strict=bool(found)):
                    c.extend(v)
            rows = pa.array(at, pa.int64())
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(rows), batch["row"].take(rows), *made, *[batch[c].take(rows) for c in keep]], names=[*BLOCKS.names, *keep])

    row = F.col("row").cast("long") if "row" in media.columns else F.monotonically_increasing_id()
    chosen = media.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), *keep, blob)
    return chosen.mapInArrow(blocks, T.StructType([*BLOCKS.fields, *[chosen.schema[c] for c in keep]]))


class Feature:
    """Loudness, zero crossings and the loudest of 63 bins of the mean spectrum of a row's blocks, folded one by one."""

    def __init__(self, row: int):
        self.row, self.n, self.sha, self.tail = row, 0, hashlib.sha256(), b""  # row: whatever tells it from the next
        self.squares = self.cross = 0
        self.last, self.power = None, np.zeros(63)

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.int8).astype(np.int64)
        payload = (x + 128).astype(np.uint8).tobytes()
        self.sha.update(payload)
        self.tail = (self.tail + payload)[-32:]
        self.n += len(x)
        self.squares += int((x * x).sum())
        line = x if self.last is None else np.concatenate([[self.last], x])
        self.cross += int(((line[1:] < 0) != (line[:-1] < 0)).sum())
        self.last = x[-1]
        self.power += (np.abs(np.fft.rfft(x[: len(x) // BLOCK * BLOCK].reshape(-1, BLOCK).astype(np.float64), 126, axis=1)[:, 1:]) ** 2).sum(0)

    def text(self) -> str:
        return f"rms={np.sqrt(self.squares / self.n):.6f};zcr={self.cross / self.n:.6f};peak={int(self.power.argmax()) + 1}"


MEDIA = "doc_id long, n_bytes long, media binary"
KEPT = ("n_bytes", "media_bytes", "media_sha256")
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int"


def media_table(docs: DataFrame) -> DataFrame:
    """Every text's UTF-8 bytes, filled up with 255 to whole blocks, as a FLAC stream (MEDIA)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]
            full = [d + b"\xff" * (-len(d) % BLOCK if d else BLOCK) for d in data]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array(encode(full, sizes=False), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return own(docs, "doc_id", "text").mapInArrow(store, MEDIA)


def folded(blocks: DataFrame) -> DataFrame:
    """Features of each row of PCM blocks of 8-bit samples with the columns KEPT (FEATURES); an error among them raises."""
    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def rows(done: list[Feature]) -> pa.RecordBatch:
            cols = [(x.row[1], x.row[2], x.n, x.sha.hexdigest(), zlib.crc32(x.tail), x.row[3], x.row[4], x.text(), x.n // BLOCK) for x in done]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cols, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for *row, pcm, error in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", *KEPT, "pcm", "error")), strict=True):
                if error:
                    raise ValueError(error)
                if now is None or row != now.row:
                    done += [now] if now else []
                    now = Feature(row)
                now.add(pcm)
            if done:
                yield rows(done)
        if now:
            yield rows([now])

    return blocks.mapInArrow(fold, FEATURES)


def text_media_features(docs: DataFrame) -> DataFrame:
    """Store every text in a FLAC media column, read that table back, decode it to PCM blocks and describe these."""
    # short streams have much in common, which the table's codec takes out
    media = stored(media_table(docs), "media", compression="zstd", **{"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)})
    media = media.withColumns({"row": F.monotonically_increasing_id(), "media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return folded(pcm_blocks(media, keep=KEPT))
