"""MinHash near-duplicates with tensored banding.

Two collections of HALVES half-keys are made, each half-key from two minhashes; every pair
(one half-key of each collection) is the key of one table. HALVES**2 tables thus need only
4*HALVES minhashes. At similarity 0.75 a pair shares no table with probability 4e-6, at
0.8 with 2e-7.

Documents with equal shingle sets are one class from the start. In each table's bucket,
classes are linked to the least member and to the next one, and small buckets give all
pairs: the number of candidates grows with the rows, not with their square. Candidates are
confirmed on full shingle sets in two rounds: first each class's best candidate, then every
candidate of a small bucket that still lies across two components and that all minhashes put near. A bucket's
hot member is split over groups by salt.

What large buckets leave out is found exactly: the classes in them are joined by prefix
filtering. Each sorts its shingles, rare ones first, by one order for all; two sets as similar
as asked share a shingle among the first n - ceil(0.75 n) + 1 of both, and the places there
bound their similarity. So do bitmaps of the whole sets: a shingle whose bit the other set
lacks is not in it, so what both can share is known closely before any text is moved. Only pairs across two components are looked at, so a family that is
linked already costs nothing more. Rows of a hot shingle meet in blocks.

A family whose members are linked each to each has pairs with the square of its size. So the
join runs twice: first the rows of one shingle give a forest of their pairs, the closest ones
first, which has fewer pairs than rows. If all of a forest are links, then whatever it stands
for is one component. All pairs come only from shingles whose forest has a pair that still lies
across two components.

Defined results: null or empty text has no shingles, is linked with nothing and is kept;
repeated rows share a component and `first` marks one of them; a null id is ignored for
component_id unless all ids are null; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import order_key, own, slices, stored, texts_of
from .components import components
from .shingles import C1, PLACES, mixed, shingle_sets
from .simhash import stars

HALVES, PER_HALF = 16, 2
#: Buckets up to this size give all their pairs.
SMALL = 6
#: Share of equal minhashes below which a second-round candidate at 0.75 is out of reach (5.5 standard deviations).
NEAR = 0.45
#: Bits of the places at which shingles are counted for their order, and rows of one shingle that meet in one block.
COUNT_BITS, BLOCK_ROWS = 18, 20_000
#: Bits of a set's bitmap, and pairs of rows of one shingle that are looked at together.
BITMAP, AT_ONCE = 1024, 2_000_000
#: Links that a task turns into stars before components are found.
SPAN = 200_000
MULTIPLIERS = mixed(np.arange(1, 1 + 2 * HALVES * PER_HALF, dtype=np.uint64) * C1) | np.uint64(1)
MET = "a long, b long, shingle long, block long"
SIGNATURES = "doc_id long, k long, h long, n_shingles long, d1 long, d2 long, sig binary"


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 minhashes, a row for each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([(np.minimum.reduceat(flat * m, starts) >> np.uint64(32)).astype(np.uint32) for m in MULTIPLIERS], 1)


def table_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, HALVES**2) int64 keys by pairing the half-keys of the two collections."""
    wide = sig.astype(np.uint64)
    half = mixed(wide[:, 0::PER_HALF] * PLACES[0] + wide[:, 1::PER_HALF] * PLACES[1])
    left, right = half[:, :HALVES], half[:, HALVES:]
    pair = mixed(left[:, :, None] * PLACES[2] + right[:, None, :] * PLACES[3]).reshape(len(sig), -1)
    return (pair + np.arange(HALVES**2, dtype=np.uint64) * PLACES[4]).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(texts_of(batch), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            sigs = [None] * len(sets)
            if full:
                for i, row in zip(full, minhashes([sets[i] for i in full]), strict=True):
                    sigs[i] = row.tobytes()
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            cols = [batch["doc_id"], batch["k"], batch["h"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SIGNATURES.split(", ")])

    keyed = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", order_key().alias("k"), F.xxhash64("text").alias("h"))
    return stored(keyed.mapInArrow(sign, SIGNATURES), "signatures").withColumn("row", F.monotonically_increasing_id())


def _rows(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def bucket_pairs(key: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of sorted (key, row): every row with its bucket's first and with the next, all pairs of small buckets; rows of larger ones with themselves."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    rest = ~new
    yield row[start[rest]], row[rest]
    yield row[np.flatnonzero(rest) - 1], row[rest]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))[np.cumsum(new) - 1]
    place = np.arange(len(key)) - start
    for gap in range(2, SMALL - 1):
        at = np.flatnonzero((size <= SMALL) & (place > gap))
        yield row[at - gap], row[at]
    yield row[size > SMALL], row[size > SMALL]


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, n): pairs of rows with a < b and how often the tables gave them; a = b for rows of large buckets."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint32).reshape(part.num_rows, -1)
                found = table_keys(sig)
                yield _rows(found.ravel(), np.repeat(part["row"].to_numpy(), found.shape[1]))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, row = np.append(key, batch["a"].to_numpy()), np.append(row, batch["b"].to_numpy())
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            if cut:
                for a, b in bucket_pairs(key[:cut], row[:cut]):
                    if len(a):
                        yield _rows(a, b)
                key, row = key[cut:], row[cut:]
            elif len(key) > 200_000:  # one very large bucket: keep its first and its last row
                yield _rows(np.full(len(row) - 1, row[0]), row[1:])
                yield _rows(row[:-1], row[1:])
                yield _rows(row, row)
                key, row = key[[0, -1]], row[[0, -1]]
        if len(key):
            for a, b in bucket_pairs(key, row):
                if len(a):
                    yield _rows(a, b)

    dealt = classes.select("row", "sig").mapInArrow(keys, "a long, b long").repartition("a").sortWithinPartitions("a", "b")
    found = dealt.mapInArrow(pairs, "a long, b long").filter("a <= b")
    return stored(found.groupBy("a", "b").agg(F.count("*").alias("n")), "candidates")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Texts meet at (a, salt): a's text first, then each b's, so one text is in memory at a time.
    """
    pairs = pairs.select("a", "b")
    members = pairs.groupBy("a").agg(F.count("*").alias("m")).withColumn("salts", F.ceil(F.col("m") / 128).cast("int"))
    spread = pairs.join(members, "a").select(F.col("b").alias("row"), "a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("part"))
    heads = members.select(F.col("a").alias("row"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"))
    places = spread.unionByName(heads).join(classes.select("row", "k", "h"), "row")
    texts = own(docs, "doc_id", "text").select(order_key().alias("k"), F.xxhash64("text").alias("h"), "text")
    met = places.join(texts, ["k", "h"]).select("a", "salt", "part", "row", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head = None, None
        for batch in slices(batches, "text", 1 << 20):
            a_out, b_out = [], []
            sets = shingle_sets(texts_of(batch), k)
            for a, salt, part, row, other in zip(*(batch[c].to_pylist() for c in ("a", "salt", "part", "row")), sets, strict=True):
                if part == 0:
                    if (a, salt) != group:
                        group, head = (a, salt), other
                    continue
                both = len(np.intersect1d(head, other, assume_unique=True))
                if 100 * both >= percent * (len(head) + len(other) - both):
                    a_out.append(a)
                    b_out.append(row)
            yield _rows(a_out, b_out)

    return stored(met.repartition("a", "salt").sortWithinPartitions("a", "salt", "part").mapInArrow(compare, "a long, b long").distinct(), "links")


def forest(x: np.ndarray, y: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (x, y), the first ones preferred, that join what root tells apart, without a cycle; and the new roots."""
    out, at = [], np.arange(len(x))
    while len(at := at[root[x[at]] != root[y[at]]]):
        a, b = root[x[at]], root[y[at]]
        _, first = np.unique(np.stack([a, b], 1).ravel(), return_index=True)  # the first pair of each
        pick = np.unique(first // 2)
        out.append(at[pick])
        member, top = stars(a[pick], b[pick])
        up = np.arange(len(root))
        up[member] = top
        root = up[root]
    return np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64), root


def left_out(crowded: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, k: int, percent: int) -> Callable[..., DataFrame]:
    """pairs(), pairs(labels, groups): crowded rows (a, b) of one group (shingle, block) that may be similar enough and lie in different components.

    Without arguments a forest of each group's pairs, by the labels given here; else all pairs of these groups, by these labels.
    """
    keyed = crowded.join(classes.select("row", "k", "h"), "row").join(labels.select(F.col("id").alias("row"), "label"), "row", "left")
    texts = own(docs, "doc_id", "text").select(order_key().alias("k"), F.xxhash64("text").alias("h"), "text").dropDuplicates(["k", "h"])
    rows = stored(keyed.join(texts, ["k", "h"]).select("row", F.coalesce("label", "row").alias("label"), "text"), "crowded")
    shift = np.uint64(64 - COUNT_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            for one in shingle_sets(texts_of(batch), k):
                np.add.at(total, one >> shift, 1)
        seen = np.flatnonzero(total)
        yield _rows(seen, total[seen])

    # 2**COUNT_BITS numbers; any order that is the same for all sets is right, this one only keeps groups small
    counts = rows.mapInArrow(count, "a long, b long").groupBy("a").agg(F.sum("b").alias("b")).toArrow()
    often = np.zeros(1 << COUNT_BITS, np.int64)
    often[counts["a"].to_numpy()] = counts["b"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(often)
    kinds = "shingle long, block long, row long, label long, size int, place int, own int"
    names = [c.split()[0] for c in kinds.split(", ")]
    kinds += ", bits binary"

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in slices(batches, "text", 1 << 20):
            cols: list[list[np.ndarray]] = [[] for _ in names]
            bits: list[bytes] = []
            for row, label, one in zip(batch["row"].to_pylist(), batch["label"].to_pylist(), shingle_sets(texts_of(batch), k), strict=True):
                n = len(one)
                many = often[one >> shift]
                first = np.lexsort((one, many))[: n - -(-percent * n // 100) + 1]
                # a row of a hot shingle goes to the blocks of its own number and to all pairs of blocks with it
                blocks = np.maximum(1, -(-many[first] // BLOCK_ROWS))
                mine = int(mixed(np.array([row], np.uint64))[0])
                own_ = np.array([mine % b for b in blocks.tolist()], np.int64)
                at = np.repeat(np.arange(len(first)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                low, high = np.minimum(own_[at], other), np.maximum(own_[at], other)
                for c, v in zip(cols, (one[first][at].view(np.int64), low << 32 | high, np.full(len(at), row), np.full(len(at), label), np.full(len(at), n), at, own_[at]), strict=True):
                    c.append(v)
                marks = np.zeros(BITMAP, bool)
                marks[one & np.uint64(BITMAP - 1)] = True
                bits += [np.packbits(marks).tobytes()] * len(at)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(t.to_pandas_dtype()), t) for v, t in zip(flat, types, strict=True)), pa.array(bits, pa.binary())], names=[*names, "bits"])

    def pairs_of(g: list[np.ndarray], every: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of one shingle's rows (of two blocks of them) by size and place, every one or a forest."""
        shingle, block, row, label, size, place, own_, bits = g
        if (label == label[0]).all():
            return
        names, label = np.unique(label, return_inverse=True)
        root = np.arange(len(names))
        low, high = int(block[0]) >> 32, int(block[0]) & 0xFFFFFFFF
        step = max(1, AT_ONCE // len(row))
        for at in range(0, len(row), step):
            a = slice(at, at + step)
            need = -(-percent * (size[a, None] + size[None]) // (100 + percent))
            bound = np.minimum(size[a, None] - place[a, None], size[None] - place[None])  # if this is the first shingle that both have
            top = root[label]
            ok = (top[a, None] != top[None]) & (row[a, None] < row[None]) & (bound >= need)
            if low != high:  # rows of the same block met elsewhere
                ok &= own_[a, None] != own_[None]
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 100_000):
                p, q = i[k : k + 100_000] + at, j[k : k + 100_000]
                open_ = root[label[p]] != root[label[q]]
                p, q = p[open_], q[open_]
                x, y = bits[p], bits[q]
                left = np.minimum(size[p] - np.bitwise_count(x & ~y).sum(1), size[q] - np.bitwise_count(y & ~x).sum(1))
                near = left >= -(-percent * (size[p] + size[q]) // (100 + percent))
                p, q, close = p[near], q[near], left[near] / (size[p[near]] + size[q[near]])
                if not every and len(p):
                    order = np.argsort(-close, kind="stable")
                    chosen, root = forest(label[p[order]], label[q[order]], root)
                    p, q = p[order[chosen]], q[order[chosen]]
                if len(p):
                    of = [np.full(len(p), v) for v in (shingle[0], block[0])]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (row[p], row[q], *of)], names=[c.split()[0] for c in MET.split(", ")])

    def meet(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in names] + [np.zeros((0, BITMAP // 64), np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            new.append(np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            held = [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
            key = (held[0], held[1])
            cut = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
            if len(cut):  # the last group may go on
                yield from groups([x[: cut[-1]] for x in held], cut[:-1], every)
                held = [x[cut[-1] :] for x in held]
        if len(held[0]):
            yield from groups(held, np.zeros(0, np.int64), every)

    def groups(cols: list[np.ndarray], cut: np.ndarray, every: bool) -> Iterator[pa.RecordBatch]:
        ends = np.append(cut, len(cols[0]))
        starts = np.append(0, cut)
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            yield from pairs_of([x[s:e] for x in cols], every)

    def meet_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meet(batches, False)

    def meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meet(batches, True)

    def pairs(now: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
        dealt = rows.mapInArrow(prefixes, kinds)
        if of is not None:
            new = now.select(F.col("id").alias("row"), F.col("label").alias("now"))
            dealt = dealt.join(of, ["shingle", "block"], "left_semi").join(new, "row", "left").withColumn("label", F.coalesce("now", "row")).select(*names, "bits")
        dealt = dealt.repartition("shingle", "block").sortWithinPartitions("shingle", "block")
        return dealt.mapInArrow(meet_forest if of is None else meet_all, MET)

    return pairs


def spanning(links: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of the links: tasks of SPAN links each give a row a member, to the least of those it is linked with there."""
    n = links.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
        if held:
            yield _rows(*stars(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return stored(links.select("a", "b").repartition(-(-n // SPAN) or 1).mapInArrow(run, "a long, b long"), "spanning")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, k and h (its key and text hash), n_shingles, component_id, kept, first."""
    signed = signatures(docs, k)
    of_class = signed.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min_by(F.struct("row", "k", "h", "sig"), "row").alias("c"))
    classes = stored(of_class.select("d1", "d2", "c.*"), "classes")
    found = candidates(classes)
    pairs, crowded = found.filter("a < b"), found.filter("a = b").select(F.col("a").alias("row"))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    links = confirmed(best, classes, docs, k, percent)
    labels = components(spanning(links))

    def label(col: str, name: str) -> DataFrame:
        return labels.select(F.col("id").alias(col), F.col("label").alias(name))

    # two rows in large buckets need no candidate: the exact join sees to them
    none = F.lit(None)
    known = labels.select("id", "label", none.cast("boolean").alias("big")).unionByName(crowded.select(F.col("row").alias("id"), none.cast("long").alias("label"), F.lit(True).alias("big")))
    known = known.groupBy("id").agg(F.max("label").alias("label"), F.max("big").alias("big"))

    def of(col: str) -> DataFrame:
        return known.select(F.col("id").alias(col), F.col("label").alias(f"l{col}"), F.col("big").alias(f"g{col}"))

    open_ = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    open_ = open_.withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b")).filter("la <> lb").join(best, ["a", "b"], "left_anti")
    open_ = open_.filter(F.col("ga").isNull() | F.col("gb").isNull()).select("a", "b")
    sig = classes.select("row", "sig")
    open_ = open_.join(sig.withColumnsRenamed({"row": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"row": "b", "sig": "sb"}), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            at = np.flatnonzero((x == y).mean(1) >= NEAR)
            yield _rows(batch["a"].to_numpy()[at], batch["b"].to_numpy()[at])

    more = stored(open_.select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long"), "open")
    if more.limit(1).count():
        links = stored(links.unionByName(confirmed(more, classes, docs, k, percent)), "links")
        labels = components(spanning(links))
    if crowded.limit(1).count():
        pairs_left = left_out(crowded, classes, labels, docs, k, percent)
        met = stored(pairs_left(), "left_out")
        tried = stored(met.select("a", "b").distinct(), "tried")
        if tried.limit(1).count():
            links = stored(links.unionByName(confirmed(tried, classes, docs, k, percent)), "links")
            labels = components(spanning(links))
            ends = met.join(label("a", "la"), "a", "left").join(label("b", "lb"), "b", "left")
            groups = stored(ends.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("shingle", "block").distinct(), "groups")
            if groups.limit(1).count():
                rest = stored(pairs_left(labels, groups).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "left_out")
                if rest.limit(1).count():
                    links = stored(links.unionByName(confirmed(rest, classes, docs, k, percent)), "links")
                    labels = components(spanning(links))
    named = classes.join(label("row", "label"), "row", "left")
    named = named.select("d1", "d2", F.coalesce("label", "row").alias("label"))
    full, empty = signed.filter("n_shingles > 0").join(named, ["d1", "d2"]), signed.filter("n_shingles = 0")
    full = stored(full.select("doc_id", "k", "h", "n_shingles", "row", "label"), "members")
    least = full.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")).select("label", "m")
    out = full.join(least, "label").select("doc_id", "k", "h", "n_shingles", F.col("m.doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("m.doc_id"), F.lit(False)).alias("kept"), (F.col("row") == F.col("m.row")).alias("first"))
    alone = empty.select("doc_id", "k", "h", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first"))
    return out.unionByName(alone)
