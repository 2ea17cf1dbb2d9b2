"""Token-id output: bit-plane shuffled segments with a chunk index.

Segment layout (little endian): header `BPS1`, plane mode (0 bytes, 1 bits), planes per
chunk, ids per chunk, ids, documents, chunks; then each chunk's planes, each a zstandard
frame; then one zstandard frame with the chunk index (first id, ids, length of each plane)
and the document index (id, its validity, length); then the index's place, the crc32 of
all before, and `BPSE`. A chunk has a fixed number of ids but for the last of a segment.

Segments are rows of a Parquet table in a shared folder: Spark commits them, so lost tasks
are redone and any store that Spark reads will do. `segment_bytes`/`read_segment` give and
take the plain bytes.

Defined results: null text counts as empty and gives the end id alone; rows with equal ids
are ordered by a hash of their text; a null id comes first; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import buckets_for, order_key, own, shared_dir, slices, texts_of, tie_key

HEAD, TAIL = struct.Struct("<4sBBIQII"), struct.Struct("<QI4s")
CHUNK_IDS, SEGMENT_IDS = 1 << 16, 1 << 18
BITS, BYTES = 1, 0


def planes_of(ids: np.ndarray, mode: int, n: int) -> list[bytes]:
    """The n bit (or byte) planes of uint32 ids, lowest first."""
    wide = np.ascontiguousarray(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T)
    if mode == BYTES:
        return [wide[b].tobytes() for b in range(n)]
    return [np.packbits(wide[b >> 3] & np.uint8(1 << (b & 7))).tobytes() for b in range(n)]


def ids_of(planes: list[bytes], mode: int, n_ids: int) -> np.ndarray:
    """Inverse of planes_of."""
    wide = np.zeros((4, n_ids), np.uint8)
    for b, p in enumerate(planes):
        raw = np.frombuffer(p, np.uint8)
        if mode == BYTES:
            wide[b] = raw
        else:
            wide[b >> 3] |= np.unpackbits(raw, count=n_ids) << np.uint8(b & 7)
    return np.ascontiguousarray(wide.T).view("<u4").ravel()


def segment_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, mode: int = BITS, chunk_ids: int = CHUNK_IDS, level: int = 3) -> bytes:
    """One self-contained segment."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    n = bits if mode == BITS else (bits + 7) // 8
    body, firsts, sizes = [], [], []
    for at in range(0, len(ids), chunk_ids):
        frames = [pack(p) for p in planes_of(ids[at : at + chunk_ids], mode, n)]
        body += frames
        firsts.append(at)
        sizes.append([len(f) for f in frames])
    index = np.array(firsts, "<u8").tobytes() + np.array(sizes, "<u4").tobytes()
    index += np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is not None for x in doc_ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes()
    data = HEAD.pack(b"BPS1", mode, n, chunk_ids, len(ids), len(doc_ids), len(firsts)) + b"".join(body)
    place = len(data)
    data += pack(index)
    return data + TAIL.pack(place, zlib.crc32(data), b"BPSE")


def read_index(blob: bytes) -> dict:
    """Header, chunk index and document index of a segment; checks its crc32."""
    import zstandard

    magic, mode, n, chunk_ids, n_ids, n_docs, n_chunks = HEAD.unpack_from(blob)
    place, crc, end = TAIL.unpack_from(blob, len(blob) - TAIL.size)
    if magic != b"BPS1" or end != b"BPSE" or zlib.crc32(memoryview(blob)[: -TAIL.size]) != crc:
        raise ValueError("damaged segment")
    raw = zstandard.ZstdDecompressor().decompress(blob[place : -TAIL.size])
    at = 8 * n_chunks
    firsts, sizes = np.frombuffer(raw, "<u8", n_chunks), np.frombuffer(raw, "<u4", n_chunks * n, at).reshape(n_chunks, n)
    at += 4 * n_chunks * n
    docs, valid = np.frombuffer(raw, "<i8", n_docs, at), np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(raw, "<u4", n_docs, at + 9 * n_docs)
    starts = HEAD.size + np.concatenate([[0], np.cumsum(sizes.ravel())[:-1]]).astype(np.int64).reshape(n_chunks, n) if n_chunks else np.zeros((0, n), np.int64)
    return {"mode": mode, "n_ids": n_ids, "chunk_ids": chunk_ids, "first": firsts, "size": sizes, "start": starts, "doc_ids": [int(d) if v else None for d, v in zip(docs, valid, strict=True)], "lengths": lengths}


def read_chunk(blob: bytes, index: dict, k: int) -> np.ndarray:
    """The ids of chunk k alone, by the chunk index."""
    import zstandard

    n = min(index["chunk_ids"], index["n_ids"] - int(index["first"][k]))
    undo = zstandard.ZstdDecompressor().decompress
    return ids_of([undo(blob[s : s + z]) for s, z in zip(index["start"][k].tolist(), index["size"][k].tolist(), strict=True)], index["mode"], n)


def read_segment(blob: bytes) -> tuple[dict, np.ndarray]:
    index = read_index(blob)
    parts = [read_chunk(blob, index, k) for k in range(len(index["first"]))]
    return index, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


SEGMENTS = "bucket int, segment int, first_id long, n_ids long, n_docs int, blob binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, mode: int = BITS) -> None:
    """Encode every text, append end_id, and write segments to path in ascending id order."""
    docs = own(docs, "doc_id", "text").withColumns({"k": order_key(), "h": tie_key()})
    ordered = docs.repartitionByRange(buckets_for(docs), "k", "h").sortWithinPartitions("k", "h", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, part, first = TaskContext.get().partitionId(), 0, 0
        docs_, lengths, ids = [], [], []

        def row(n: int, flat: np.ndarray) -> pa.RecordBatch:
            """A segment of the first n documents held."""
            nonlocal part, first
            cols = [[bucket], [part], [first], [len(flat)], [n], [segment_bytes(docs_[:n], lengths[:n], flat, mode)]]
            part, first = part + 1, first + len(flat)
            del docs_[:n], lengths[:n]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=[c.split()[0] for c in SEGMENTS.split(", ")])

        encode = encoder(tokenizer).encode_flat
        for batch in slices(batches, "text", 4 << 20):
            flat, n = encode(texts_of(batch), end_id)
            docs_ += batch["doc_id"].to_pylist()
            lengths += n.tolist()
            ids.append(flat)
            if sum(map(len, ids)) >= SEGMENT_IDS:
                flat = np.concatenate(ids)
                ends, at = np.cumsum(lengths), 0
                while len(flat) - at >= SEGMENT_IDS:  # whole documents, as many as bring a segment to its size
                    k = int(np.searchsorted(ends, at + SEGMENT_IDS)) + 1
                    end = int(ends[k - 1])
                    ends = ends[k:]
                    yield row(k, flat[at:end])
                    at = end
                ids = [flat[at:]]
        if docs_:
            yield row(len(docs_), np.concatenate(ids))

    ordered.select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(path)


INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long, segment_first long, n_chunks int"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written store, from the decoded ids (INDEX); segments are read in parallel."""
    store = spark.read.schema(SEGMENTS).parquet(path)
    sizes = {r.bucket: r.n for r in store.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}  # a number a bucket
    order = sorted(sizes)
    base = dict(zip(order, accumulate([0, *(sizes[b] for b in order)]), strict=False))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                index, ids = read_segment(batch["blob"][i].as_py())
                ends = np.cumsum(index["lengths"].astype(np.int64))
                starts, raw = ends - index["lengths"], np.ascontiguousarray(ids, "<u4").data.cast("B")
                at = base[batch["bucket"][i].as_py()] + batch["first_id"][i].as_py()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                cols = [pa.array(index["doc_ids"], pa.int64()), pa.array(starts + at, pa.int64()), pa.array(index["lengths"].astype(np.int64)), pa.array(crc, pa.int64()), pa.array([at] * n, pa.int64()), pa.array([len(index["first"])] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in INDEX.split(", ")])

    return store.select("bucket", "first_id", "blob").mapInArrow(decode, INDEX)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs to a new store in the shared folder and read it back."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
