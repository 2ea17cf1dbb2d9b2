"""Language-model scoring with a probabilistic suffix tree.

A text is its words (lower-cased A-Z, runs of bytes other than ASCII white space) and one
end. The tree's symbols are the words seen MIN_COUNT times or more, the end, and CLASSES
classes of all other words by their last two bytes. Contexts of one to DEPTH symbols are
retained if they occur MIN_COUNT times and their next symbols diverge enough from their
suffix's (they predict each occurrence from the others better by DIVERGENCE nats in all); a
context's distribution is smoothed with its suffix's, down to symbol frequencies.
A token is scored by the longest retained suffix of what precedes it; a rarer word also by
its share of its class, in which one place is kept for unknown words.

All thresholds are counts, so that the tree grows with the input. It is never in one place:
texts are stored as streams of word numbers, a row a batch, in a table bucketed by batch that
no later step moves. A batch sends its distinct words, then level by level its distinct
sequences (a context and the next symbol), by hash, one row for each part; a part adds up what
it gets and sends the counts back in the order in which they were asked for, naming for each
sequence one batch that adds it to its context's divergence. Contexts are judged in the same
way, by the sums of these. Questions of sequences go in ROUNDS, each for its share of the
parts, so that only one share is on disk at a time; answers lie in tables bucketed like the streams. Words are told apart by 56 bits of hash and their class, longer
sequences by 48 bits within their part. What goes to the driver or is broadcast are CLASSES
numbers.

Defined results: null or empty text is the end alone; a null id is not held out; repeated
rows are counted each; without training rows all counts are 0 and symbols are equally
likely; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own, shared_dir, slices, texts_of
from .shingles import C1, C2, PLACES, mixed, word_hashes

CLASSES = 256
#: Bytes of text in a batch.
SLICE_BYTES = 8 << 20
DEPTH, MIN_COUNT, MIN_ENTRY, DIVERGENCE, SMOOTH = 3, 16, 2, 5.0, 32.0
PART_BYTES = 16 << 20
#: Shares of a level's questions: part p belongs to round p % ROUNDS.
ROUNDS = 2


def held_out(col: str = "doc_id", of: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % of == part, F.lit(False))


END = np.int64(-(2**63) + 1)


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tagged hashes of all texts' tokens, ends included, and where each text begins (with one more).

    56 bits are the word's hash and the lowest its class by its last two bytes.
    """
    parts, held, size = [], [], 0
    for t in [*texts, None]:  # a megabyte at a time: sums over bytes take many times their room
        if t is None or held and size + len(t) > 1 << 20:
            parts.append(word_hashes(held))
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    h, n, one, two = (np.concatenate(x) for x in zip(*parts, strict=True))
    kind = mixed(two.astype(np.uint64) << np.uint64(8) | one) & np.uint64(CLASSES - 1)
    h = (h & ~np.uint64(0xFF) | kind).view(np.int64)
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    flat = np.full(starts[-1], END, np.int64)
    flat[np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)] = h
    return flat, starts


def _arrays(schema: str, *cols) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names, strict=True)], names=[n for n, _ in names])


def blended(n, size, listed, p):
    """Probability of a symbol seen n times after a context of `size` occurrences, over the shorter context's p."""
    return (n + (size - listed + SMOOTH) * p) / (size + SMOOTH)


STREAMS = "slice long, doc_ids array<long>, held array<boolean>, starts binary, tokens binary, words binary"
SENT = "kind int, part int, slice long, blob binary"
#: Kinds of rows: sums of a part, counts of words; level 1, 2, ... of sequences; CONTEXTS + level of their contexts.
SUMS, WORDS, CONTEXTS = -1, 0, 1000
#: Bits of a sequence's hash.
MASK = np.uint64((1 << 48) - 1)


def _squeezed(*cols: np.ndarray, level: int = 3) -> bytes:
    """Columns of one kind of numbers as byte planes, zstandard over all: high bytes of small numbers vanish."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in cols)
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _plain(blob: bytes, kind: str = "<i8", cols: int = 1) -> np.ndarray:
    """The numbers of `cols` columns of equal length, side by side."""
    raw, wide = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(cols, wide, len(raw) // (cols * wide)).transpose(0, 2, 1)).view(kind).ravel()


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes (none negative), each one's number among them, and of each distinct one its first place."""
    bits = max(len(codes) - 1, 0).bit_length()
    if int(codes.max(initial=0)).bit_length() + bits > 64:
        every, first, at = np.unique(codes, return_index=True, return_inverse=True)
        return every, at, first
    packed = codes.view(np.uint64) << np.uint64(bits) | np.arange(len(codes), dtype=np.uint64)
    packed.sort()  # of plain numbers: several times faster than an order of codes
    place, code = (packed & np.uint64((1 << bits) - 1)).view(np.int64), (packed >> np.uint64(bits)).view(np.int64)
    new = np.flatnonzero(np.diff(code, prepend=-1))
    at = np.empty(len(codes), np.int64)
    at[place] = np.repeat(np.arange(len(new)), np.diff(new, append=len(codes)))
    return code[new], at, place[new]


def streams(docs: DataFrame, parts: int) -> DataFrame:
    """The texts as STREAMS: a row of each batch has its distinct words and each token's number among them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            flat, starts = hashes(texts_of(batch))
            at, words = pd.factorize(flat)
            order = np.lexsort((words, -np.bincount(at, minlength=len(words))))  # low numbers for frequent words
            words, at = words[order], np.argsort(order)[at]
            cols = [[uuid.uuid4().int >> 65], [batch["doc_id"].to_pylist()], [batch["held_out"].to_pylist()], [_squeezed(starts.astype("<i8"))], [_squeezed(at.astype("<u4"), level=9)], [_squeezed(_steps(words))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in STREAMS.split(", ")])

    return _kept(docs.select("doc_id", "text", "held_out").mapInArrow(make, STREAMS), "streams", parts)


def _kept(df: DataFrame, what: str, parts: int) -> DataFrame:
    """A table bucketed by slice, so that no later step moves it."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, "slice").option("path", shared_dir(spark, what)).saveAsTable(name)
    return spark.table(name)


INVERSE = [np.uint64(pow(int(c), -1, 1 << 64)) for c in (C1, C2)]


def _unmixed(x: np.ndarray) -> np.ndarray:
    """Inverse of mixed."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * INVERSE[1]
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * INVERSE[0]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _address(keys: np.ndarray, level: int) -> np.ndarray:
    """Evenly spread numbers that stand for keys: words and symbols (level 0) mixed, sequences, which are hashes of 48 bits, shifted."""
    return mixed(keys.view(np.uint64)) if level == 0 else keys.view(np.uint64) << np.uint64(16)


def _order(address: np.ndarray) -> np.ndarray:
    """An order of addresses by their high bits, by place where these agree: parts ascend, and equal input is ordered alike."""
    bits = min(max(len(address) - 1, 0).bit_length(), 32)
    if len(address) > 1 << bits:  # parts are told apart by 32 bits
        return np.argsort(address, kind="stable")
    low = np.uint64((1 << bits) - 1)
    packed = address & ~low | np.arange(len(address), dtype=np.uint64)
    packed.sort()
    return (packed & low).view(np.int64)


def _dealt(keys: np.ndarray, level: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys by their address, and in this order the addresses and their parts, which ascend, too."""
    address = _address(keys, level)
    order = _order(address)
    address = address[order]
    return order, address, (((address >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Mostly ascending keys as differences (modulo 2^64), which are smaller."""
    return np.diff(keys.view(np.uint64), prepend=np.uint64(0))


def _summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64).view(np.int64)


def _spans(part: np.ndarray) -> list[tuple[int, int]]:
    at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return list(zip(at, at[1:], strict=False))


def _sent(kind: int, level: int, mark: int, parts: int, keys: np.ndarray, *cols: np.ndarray, share: int | None = None) -> list[tuple]:
    """Rows (SENT) of keys, as ascending addresses, and 8-byte columns, one for each part (or each of a round's)."""
    if not len(keys):
        return []
    order, address, part = _dealt(keys, level, parts)
    cols = [x[order].view(np.int64) for x in cols]
    return [(kind, int(part[s]), mark, _squeezed(_steps(address[s:e].view(np.int64)), *(c[s:e] for c in cols))) for s, e in _spans(part) if share is None or part[s] % ROUNDS == share]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return _arrays(SENT, *([r[i] for r in rows] for i in range(4)))


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the jobs within are deleted with the end of each job, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _by_part(sent: DataFrame, parts: int, answer, rounds: int = 1) -> DataFrame:
    """The rows that answer(kinds) gives for each part's rows, a dict from kind to (slice, blob)s: of each slice an array, beside its stream.

    In one of several rounds only each rounds-th part has rows.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for batch in batches:
            for kind, p, mark, b in zip(*(batch[c].to_pylist() for c in ("kind", "part", "slice", "blob")), strict=True):
                if p != part and held:
                    yield _batch(answer(part, held))
                    held = {}
                part = p
                held.setdefault(kind, []).append((mark, b))
        if held:
            yield _batch(answer(part, held))

    dealt = sent.repartitionById(math.ceil(parts / rounds), (F.col("part") / rounds).cast("int")).sortWithinPartitions("part")
    with _freed(sent.sparkSession):
        answers = dealt.mapInArrow(meet, SENT).repartition(parts, "slice")
        return _kept(answers.groupBy("slice").agg(F.collect_list(F.struct("kind", "part", "blob")).alias("answers")), "answers", parts)


def _asked(rows: list[tuple], cols: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """All rows' columns side by side, and each row's slice and length."""
    blobs = [_plain(b, "<i8", cols).reshape(cols, -1).copy() for _, b in rows]
    for x in blobs:
        x[0] = _summed(x[0])
    return np.concatenate(blobs, 1), [(mark, x.shape[1]) for (mark, _), x in zip(rows, blobs, strict=True)]


def _answers(kind: int, part: int, sizes: list[tuple[int, int]], values: np.ndarray) -> list[tuple]:
    ends = np.cumsum([n for _, n in sizes]).tolist()
    return [(kind, part, mark, _squeezed(values[e - n : e].astype("<i8"))) for (mark, n), e in zip(sizes, ends, strict=True)]


def _added(address: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct addresses, each row's place among them, and the values' sums."""
    every, at = np.unique(address.view(np.uint64), return_inverse=True)
    return every, at, [np.bincount(at, v, len(every)) for v in values]


def count_words(part: int, held: dict) -> list[tuple]:
    """Counts of a part's words, and a row of sums, which no slice asked for: of each class's rarer words the tokens and the words, then tokens, known words and symbols."""
    (address, n), sizes = _asked(held[WORDS], 2)
    every, at, (c,) = _added(address, n)
    words = _unmixed(every).view(np.int64)
    rare = (c < MIN_COUNT) & (words != END)
    kind = words[rare] & (CLASSES - 1)
    sums = [np.bincount(kind, c[rare], CLASSES), np.bincount(kind, c[rare] > 0, CLASSES), [c.sum(), (c > 0).sum(), (~rare).sum()]]
    return [(SUMS, part, -1 - part, _squeezed(np.concatenate(sums).astype("<i8"))), *_answers(WORDS, part, sizes, c[at])]


def count_grams(kind: int, part: int, rows: list[tuple]) -> list[tuple]:
    """Twice the counts of a part's sequences, and one more for one of the batches that asked."""
    (address, n), sizes = _asked(rows, 2)
    every, at, (c,) = _added(address, n)
    one, mine = np.empty(len(every), np.int64), np.zeros(len(at), np.int64)
    one[at] = np.arange(len(at))
    mine[one] = 1
    return _answers(kind, part, sizes, 2 * c.astype(np.int64)[at] + mine)


def retain(kind: int, part: int, rows: list[tuple]) -> list[tuple]:
    """Listed counts of the contexts asked for, -1 for those whose divergence, from all batches, is too small."""
    (address, gain, listed), sizes = _asked(rows, 3)
    _, at, (gain, listed) = _added(address, gain.view(np.float64), listed)
    return _answers(kind, part, sizes, np.where(gain >= DIVERGENCE, listed, -1.0)[at])


def meet(part: int, held: dict) -> list[tuple]:
    return [row for kind, rows in held.items() for row in (retain if kind > CONTEXTS else count_grams)(kind, part, rows)]


class Slice:
    """A batch of texts with what was answered so far: symbols, then sequences of each length with their counts."""

    def __init__(self, row: tuple, answers: dict[int, list[bytes]], parts: int):
        self.mark, self.doc_ids, self.held, starts, tokens, words = row
        self.starts, self.words = _plain(starts), _summed(_plain(words))
        self.answers, self.parts, self.tokens = answers, parts, _plain(tokens, "<u4").astype(np.int64)
        self.trained = np.repeat(~np.array(self.held, bool), np.diff(self.starts))

    def answered(self, kind: int, level: int, keys: np.ndarray, at: np.ndarray, other: int) -> np.ndarray:
        """What was answered for the keys at these places, `other` elsewhere."""
        out = np.full(len(keys), other, np.int64)
        if len(at):
            out[at[_order(_address(keys[at], level))]] = np.concatenate([_plain(b) for b in self.answers[kind]])
        return out

    def count(self, at: np.ndarray, m: int) -> np.ndarray:
        at = at[self.trained]
        return np.bincount(at[at >= 0], minlength=m).astype(np.int64)

    def asks_words(self) -> list[tuple]:
        return _sent(WORDS, 0, self.mark, self.parts, self.words, self.count(self.tokens, len(self.words)))

    def find_symbols(self, sums: np.ndarray) -> None:
        self.c = self.answered(WORDS, 0, self.words, np.arange(len(self.words)), 0)
        rare, kind = (self.c < MIN_COUNT) & (self.words != END), self.words & (CLASSES - 1)
        self.share = np.where(rare, np.log10((self.c + 1.0) / (sums[kind] + sums[CLASSES + kind] + 1.0)), 0.0)  # of all a class's words, each once more, and one unknown
        self.symbols, of = np.unique(np.where(rare, kind, self.words), return_inverse=True)
        size = np.zeros(len(self.symbols))
        size[of] = np.where(rare, sums[kind], self.c)
        self.total, self.root = sums[-3], (size + 1.0) / (sums[-3] + sums[-1] + CLASSES)
        self.end = of[np.flatnonzero(self.words == END)[0]]
        # of each level: every token's sequence (-1 where the context is too rare), its count, its key, its probability by frequency
        self.gram, self.n, self.keys, self.p = [of[self.tokens]], [size], [self.symbols], [size / max(self.total, 1)]
        self.of, self.shorter, self.mine, self.contexts, self.sizes, self.names = ([None] for _ in range(6))

    def find(self, level: int) -> None:
        """The sequences of `level` symbols seen MIN_COUNT times and the next one. Where a shorter context was rarer, so is a longer one."""
        m, k, y = len(self.symbols), len(self.n[-1]), self.gram[0]
        before, names, sizes = np.concatenate([[0], self.gram[-1][:-1]]), self.keys[-1], self.n[-1]
        if level == 1:
            before[self.starts[:-1]] = self.end  # ends stand before a text
        else:
            before[self.starts[:-1]] = k
            names, sizes = np.append(names, _joined(self.ends, END)), np.append(sizes, [self.n[0][self.end], 0])  # -1 finds the last
        self.ends = END if level == 1 else names[-1]
        where = np.flatnonzero(sizes[before] >= MIN_COUNT)
        codes, at, first = _numbered(before[where] * m + y[where])
        of = codes // m  # ascends, as codes do
        contexts = of[np.flatnonzero(np.diff(of, prepend=-1))]
        # all of a sequence's places have the same shorter one
        for line, x in zip((self.of, self.shorter, self.contexts, self.sizes, self.names), (of, self.gram[-1][where[first]], contexts, sizes, names), strict=True):
            line.append(x)
        gram = np.full(len(y), -1)
        gram[where] = at
        self.gram.append(gram)
        self.keys.append(_joined(names[of], self.symbols[codes % m]))

    def asks_grams(self, level: int, share: int | None) -> list[tuple]:
        return _sent(level, level, self.mark, self.parts, self.keys[level], self.count(self.gram[level], len(self.of[level])), share=share)

    def learn(self, level: int) -> None:
        """Counts of the sequences, as answered."""
        found = self.answered(level, level, self.keys[level], np.arange(len(self.keys[level])), 0)
        self.n.append((found >> 1).astype(np.float64))
        self.mine.append((found & 1) == 1)
        self.p.append(self.n[level] / np.maximum(self.sizes[level][self.of[level]], 1))

    def asks_contexts(self, level: int, share: int | None) -> list[tuple]:
        """This batch's part of the contexts' divergence: each occurrence against the counts without it, so that a sparse context gains nothing by chance."""
        of, m = self.of[level], len(self.sizes[level])
        at = np.flatnonzero(self.mine[level] & (self.n[level] > 0))
        n, size, p = self.n[level][at], self.sizes[level][of[at]], self.p[level - 1][self.shorter[level][at]]
        gain = np.bincount(of[at], n * np.log((n - 1 + SMOOTH * p) / (size - 1 + SMOOTH) / p), m)
        listed = np.bincount(of[at], np.where(n >= MIN_ENTRY, n, 0), m)
        asked = self.contexts[level]
        return _sent(CONTEXTS + level, level - 1, self.mark, self.parts, self.names[level][asked], gain[asked].astype("<f4").astype("<f8"), listed[asked].astype(np.int64), share=share)

    def upto(self, level: int, sums: np.ndarray, learned: int) -> "Slice":
        self.find_symbols(sums)
        for k in range(1, level + 1):
            self.find(k)
            if k <= learned:
                self.learn(k)
        return self

    def logs(self) -> np.ndarray:
        """log10 probability of each token's symbol after what precedes it."""
        p, logs = self.root, np.log10(self.root)[self.gram[0]]
        for level in range(1, len(self.n)):
            of, n, shorter = self.of[level], self.n[level], p[self.shorter[level]]
            listed = self.answered(CONTEXTS + level, level - 1, self.names[level], self.contexts[level], -1)[of]
            p = np.where(listed >= 0, blended(np.where(n >= MIN_ENTRY, n, 0), self.sizes[level][of], listed, shorter), shorter)
            where = np.flatnonzero(self.gram[level] >= 0)
            logs[where] = np.log10(p)[self.gram[level][where]]
        return logs


def _joined(context: np.ndarray | np.int64, symbol: np.ndarray | np.int64) -> np.ndarray:
    """Keys of contexts with a further symbol."""
    a, b = (np.atleast_1d(np.asarray(x, np.int64)).view(np.uint64) for x in (context, symbol))
    return (mixed(mixed(a * PLACES[0]) + b * PLACES[1]) & MASK).view(np.int64)


def _over(stream: DataFrame, answers: list[DataFrame], parts: int, run, schema: str) -> DataFrame:
    """The batches that run(slice) gives for each row of stream with all its answers."""
    rows, cols = stream, [f"answers_{i}" for i in range(len(answers))]
    for a, c in zip(answers, cols, strict=True):
        rows = rows.join(a.withColumnRenamed("answers", c).hint("shuffle_hash"), "slice", "left")  # a bucket's rows are few; sorts would take pages of memory each
    names = [c.split()[0] for c in STREAMS.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found: dict[int, list[bytes]] = {}
                for a in sorted((a for c in cols for a in batch[c][i].as_py() or []), key=lambda a: a["part"]):
                    found.setdefault(a["kind"], []).append(a["blob"])
                yield run(Slice(tuple(batch[c][i].as_py() for c in names), found, parts))

    return rows.mapInArrow(each, schema)


ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows not held out."""
    docs = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # fewer buckets than shuffle partitions would be dealt anew
    parts = max(1, math.ceil(size / PART_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stream = streams(docs, parts)
    words = _by_part(_over(stream, [], parts, lambda s: _batch(s.asks_words()), SENT), parts, count_words)
    sums = np.zeros(2 * CLASSES + 3)
    for r in words.filter("slice < 0").select(F.col("answers.blob")[0].alias("blob")).toLocalIterator():  # CLASSES numbers a part
        sums += _plain(r.blob)
    answers = [words]

    def asks(level: int, share: int | None):
        def run(s: Slice) -> pa.RecordBatch:
            s.upto(min(level, depth), sums, level - 1)
            return _batch((s.asks_grams(level, share) if level <= depth else []) + (s.asks_contexts(level - 1, share) if level > 1 else []))

        return run

    for level in range(1, depth + 2):  # the contexts of a level go with the sequences of the next
        shares = range(ROUNDS) if level <= depth else [None]
        answers += [_by_part(_over(stream, answers, parts, asks(level, r), SENT), parts, meet, len(shares)) for r in shares]
    total, distinct = int(sums[-3]), int(sums[-2])

    def score(s: Slice) -> pa.RecordBatch:
        s.upto(depth, sums, depth)
        n = np.diff(s.starts)
        base, known, line = (np.add.reduceat(x, s.starts[:-1]) for x in (np.log10(s.c + 1.0)[s.tokens], (s.c > 0).astype(np.int64)[s.tokens], s.logs() + s.share[s.tokens]))
        return _arrays(ROWS, s.doc_ids, s.held, n, known, np.full(len(n), total), base - n * math.log10(total + distinct + 1), line)

    return _over(stream, answers, parts, score, ROWS)
