"""Best-two-fit packing of tokenized documents into sequences of fixed length.

Bins are filled greedily with the longest piece that still fits; when none does, the bin's
smallest piece gives way to the two unpacked pieces that fill its place best, if they leave
a smaller gap. Pieces are dealt evenly at random into groups of about GROUP pieces, and
each group is packed by itself from counts of its lengths: a group wastes at most about one
sequence over packing all at once.

Defined results: null text counts as empty and is the end id alone; only documents over
the sequence length are cut, the first piece taking the remainder; repeated rows are packed
as often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import own, slices, stored, texts_of

GROUP = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """Pieces of at most `most` ids of every document (PIECES)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_flat
        for batch in slices(batches, "text"):
            rows, at = [], 0
            flat, sizes = encode(texts_of(batch), end_id)
            raw = np.ascontiguousarray(flat, "<u4").data.cast("B")
            for doc, n in zip(batch["doc_id"].to_pylist(), sizes.tolist(), strict=True):
                start = 0
                for k, end in enumerate(range((n - 1) % most + 1, n + 1, most)):
                    rows.append((doc, k, start, end - start, zlib.crc32(raw[4 * (at + start) : 4 * (at + end)])))
                    start = end
                at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return own(docs, "doc_id", "text").mapInArrow(cut, PIECES)


def best_two_fit(counts: np.ndarray) -> Iterator[list[int]]:
    """Bins, as lists of lengths. counts[n]: pieces of length n; the bin size is len(counts) - 1."""
    size, left = len(counts) - 1, counts.tolist()
    there = sum(1 << n for n in range(1, size + 1) if left[n])  # bit n: a piece of length n is left

    def take(n: int) -> None:
        nonlocal there
        left[n] -= 1
        if not left[n]:
            there &= ~(1 << n)

    def put(n: int) -> None:
        nonlocal there
        left[n] += 1
        there |= 1 << n

    while there:
        bin_, gap = [], size
        while n := (there & ((2 << gap) - 1)).bit_length() - 1 if there & ((2 << gap) - 1) else 0:
            take(n)
            bin_.append(n)
            gap -= n
        if gap and there and len(bin_) > 1:
            small = bin_[-1]  # filled in descending order
            room, best = gap + small, (small, 0, 0)
            a = (there & ((1 << room) - 1)).bit_length() - 1 if there & ((1 << room) - 1) else 0
            while a > 0 and 2 * a > best[0]:
                rest = min(room - a, a)
                below = there & ((2 << rest) - 1)
                if rest == a and left[a] < 2:
                    below &= ~(1 << a)
                b = below.bit_length() - 1 if below else 0
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                lower = there & ((1 << a) - 1)
                a = lower.bit_length() - 1 if lower else 0
            if best[1]:
                put(bin_.pop())
                for n in best[1:]:
                    take(n)
                    bin_.append(n)
        yield bin_


def pack(piece: DataFrame, most: int = 1024, group: int = GROUP) -> DataFrame:
    """Pieces (any columns, `length` among them) with sequence_id and offset."""
    table = piece.withColumn("row_", F.monotonically_increasing_id())  # piece is a stored table: the numbers don't change
    n = max(1, math.ceil(table.count() / group))
    names = [c for c in piece.columns]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_", kind="stable")
        lengths = pdf["length"].to_numpy()
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(most + 2))
        at = bounds[:-1].tolist()
        where, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, bin_ in enumerate(best_two_fit(np.diff(bounds))):
            place = 0
            for x in bin_:
                i = order[at[x]]
                at[x] += 1
                where[i], offset[i] = k, place
                place += x
        base = int(pdf["group_"].iloc[0]) << 32
        return pdf[names].assign(sequence_id=where + base, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece.schema) + ", sequence_id long, offset long"
    dealt = table.withColumn("group_", F.pmod(F.xxhash64("row_"), F.lit(n)).cast("int"))
    return dealt.groupBy("group_").applyInPandas(fill, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = 1024) -> DataFrame:
    """Every document's pieces with their places: PIECES, sequence_id, offset."""
    return pack(stored(pieces(docs, tokenizer, end_id, most), "pieces"), most)
