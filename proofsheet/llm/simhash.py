"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

A fingerprint is eight bytes, each with its position. Fingerprints that differ in MOST_BITS
bits differ in as many bytes at most, so they share NEEDED positional bytes or more. The
index has postings of one positional byte, or of several at once where the fingerprints are
many: level 2 is the postings of two shared bytes, and so on. By the prefix filter, the first
`level` of the shared positions lie among the first 8 - NEEDED + level. In a posting each
pair's shared bytes are tallied, pairs that reach NEEDED are kept, and their bits compared.

A posting of over LARGE fingerprints is refined by one more byte; at level NEEDED, where all
pairs have the tally already, it is cut into blocks that meet two by two. So no task holds more
than LARGE members of a posting. Equal fingerprints are one class from the start, and tasks
pass on stars that connect what they found linked, not all pairs. No link is lost.

Defined results: a text without words (null, empty) has fingerprint zero and is linked like
any other; fewer words than a shingle are one shingle; repeated rows share a component; a
null id is ignored for component_id unless all ids of the component are null; an empty table
gives no rows; texts are read a megabyte at a time; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own, slices, stored
from .components import components

SEED, MOST_BITS = 42, 4
NEEDED = 8 - MOST_BITS
#: Members of a posting on average up to which a level is taken, of a posting up to which it is not refined, and up to which its pairs are all compared at once.
MEAN, LARGE, SMALL = 16, 4096, 64
PIECE_BYTES = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE_BYTES that end where a word does."""
    at = 0
    while len(text) - at > PIECE_BYTES and (m := GAP.search(text, at + PIECE_BYTES)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def fingerprint(text: bytes, k: int = 4) -> int:
    """SimHash of a text's k-word shingles, repeats included; 0 without words."""
    ones, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    words: list[bytes] = []
    for piece in _pieces(text):
        words += piece.lower().split()
        if len(words) >= k:
            ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
            line, starts = b" ".join(words), [0, *(e + 1 for e in ends)]
            h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)), np.uint64)
            for at in range(0, len(h), 1 << 14):
                ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
            words = words[-(k - 1) :] if k > 1 else []
    if not n and words:
        return digest(b" ".join(words), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (as a signed number) of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t or b"", k) for t in batch["text"].cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, fp long")


def level_for(n: int) -> int:
    return next((x for x in range(1, NEEDED) if n <= MEAN * 256**x), NEEDED)


def _key(number: int, positions: tuple[int, ...]) -> Column:
    out = F.lit(number).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")))
    return out


def postings(fps: DataFrame, level: int) -> DataFrame:
    """(key, fp) for every choice of `level` positions, with the key of the posting that it refines (`under`)."""
    chosen = list(combinations(range(8 - NEEDED + level), level))
    above = {c: i for i, c in enumerate(combinations(range(8 - NEEDED + level - 1), level - 1))}
    keys = [F.struct(_key(i, c).alias("key"), _key(above[c[:-1]], c[:-1]).alias("under")) for i, c in enumerate(chosen)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.key", "x.under", "fp")


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether fingerprints are near: their tally of shared bytes first, then their bits."""
    d = x ^ y
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    unequal = np.bitwise_count(((d & low) + low | d) & ~low)  # bytes that differ
    ok = unequal <= 8 - NEEDED
    ok[ok] = np.bitwise_count(d[ok]) <= MOST_BITS
    return ok


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as (member, root): the same components, a row for each member but the root."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        if (root == before).all():
            break
    rest = root != np.arange(len(ids))
    return ids[rest], ids[root[rest]]


def spanned(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of one posting: its members are visited by breadth, each against those that no one has reached."""
    member, root, left = [], [], fp
    while len(left) > 1:
        head, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 64):
                open_ = np.flatnonzero(~near)
                if not len(open_):
                    break
                near[open_] = linked(front[at : at + 64, None], left[open_][None]).any(0)
            front, left = left[near], left[~near]
            member.append(front)
            root.append(np.full(len(front), head))
    return (np.concatenate(member), np.concatenate(root)) if member else (fp[:0], fp[:0])


def near_pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the whole postings in sorted keys."""
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    size = np.diff(np.append(starts, len(key)))
    a, b = [fp[:0]], [fp[:0]]
    place, of = np.arange(len(key)) - np.repeat(starts, size), np.repeat(size, size)
    small = of <= SMALL
    for gap in range(1, int(size[size <= SMALL].max(initial=1))):
        at = np.flatnonzero(small & (place >= gap))
        at = at[linked(fp[at], fp[at - gap])]
        a.append(fp[at])
        b.append(fp[at - gap])
    for s, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        for out, x in zip((a, b), spanned(fp[s : s + n]), strict=True):
            out.append(x)
    return stars(np.concatenate(a), np.concatenate(b))


def edges_of(rows: DataFrame) -> DataFrame:
    """(a, b) that connect near fingerprints of the same posting and block; rows: key, block, fp."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([batch["key"].to_numpy(), batch["block"].to_numpy()], 1)])
            fp = np.concatenate([fp, batch["fp"].to_numpy().view(np.uint64)])
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(cut) and len(fp) > 50_000:  # the last posting may go on
                yield found(key[: cut[-1]], fp[: cut[-1]])
                key, fp = key[cut[-1] :], fp[cut[-1] :]
        if len(fp):
            yield found(key, fp)

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in near_pairs(key, fp)], names=["a", "b"])

    dealt = rows.select("key", "block", "fp").repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of postings that can't be refined, each to all pairs of blocks with its own."""
    blocks = F.ceil(F.col("n") / (LARGE // 2)).cast("int")
    cut = rows.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.greatest("own", "other").cast("long") * (1 << 31) + F.least("own", "other")
    # a block meets itself beside each other block as well, so its own pairs need no group of their own
    return cut.filter("own <> other or blocks = 1").select("key", pair.alias("block"), "fp")


def edges(fps: DataFrame, n: int) -> DataFrame:
    """(a, b) that connect all near fingerprints among these n distinct ones."""
    level, out = level_for(n), None
    none = F.lit(0).cast("long").alias("block")
    rows = postings(fps, level)
    while True:
        large = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE), "large")
        if not large.limit(1).count():
            done, rows = rows.select("key", none, "fp"), None
        else:
            done, rows = rows.join(large, "key", "left_anti").select("key", none, "fp"), rows.join(large, "key", "left_semi")
        if rows is not None and level == NEEDED:
            done, rows = done.unionByName(in_blocks(rows, large)), None
        found = stored(edges_of(done), "edges")
        out = found if out is None else out.unionByName(found)
        if rows is None:
            return out
        level += 1
        members = rows.select("fp").distinct()
        rows = stored(postings(members, level).join(large.select(F.col("key").alias("under")), "under", "left_semi"), "refined")


def near_fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id of every document."""
    signed = stored(fingerprints(docs, k), "fingerprints")
    classes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(edges(classes.select("fp"), classes.count()))
    named = classes.join(labels.select(F.col("id").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    named = stored(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = stored(named.select("fp", "label").join(least, "label").select("fp", "component_id"), "components")
    return signed.join(of, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
