"""Alignment of two tokenizations of the same bytes.

The tokens' ends are marks in packed bitsets, a bit for each byte; their AND has the shared
cuts, and ranks by popcount map each cut to the number of tokens of either side before it.
Tokens between two cuts are a group; the last token of both sides of a group end together
and are linked.

No token of either tokenizer goes beyond a space that follows another character, so texts
are cut there, each distinct unit is encoded and aligned once in a worker, and what a text
has follows from its units. Texts are read a megabyte at a time, however long they are.

Of two tokens that end together one is a suffix of the other. The vocabularies have only so
many such pairs (PairTable: 324,302 for the two of the query, whatever the corpus), so links are numbers of
pairs, corpus-wide counts are one vector of that length, and this is what is broadcast.

Defined results: null and empty texts and those whose tokens don't give back their bytes
have no tokens: zeros, and '' for the digest; repeated rows are counted as often as they
occur; a null id is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ALPHABET, BEYOND, Units
from .common import own, slices, stored

#: A cut of both tokenizers: a space after a character that isn't white space.
CUT = re.compile(r"(?<=\S) ")
#: Characters of a text read at once, and units kept by a worker.
PIECE_CHARS, MOST_UNITS = 1 << 20, 150_000
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
WRITTEN = {b: c for b, c in ALPHABET.items() if chr(b) != c}


def aligned(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared cuts (byte offsets) of two sequences of token lengths over the same bytes, and the tokens of each up to every cut."""
    ends = [np.cumsum(x, dtype=np.int64) for x in (a_len, b_len)]
    size = int(ends[0][-1]) if len(a_len) else 0
    sets = []
    for e in ends:
        marks = np.zeros(-(-size // 64) * 64, bool)
        marks[e - 1] = True
        sets.append(np.packbits(marks, bitorder="little").view("<u8"))
    shared = sets[0] & sets[1]
    last = np.flatnonzero(np.unpackbits(shared.view(np.uint8), bitorder="little"))  # place of a group's last byte
    word, upto = last >> 6, np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (last & 63)).astype(np.uint64)
    ranks = []
    for s in sets:
        n = np.bitwise_count(s).astype(np.int64)
        ranks.append((np.cumsum(n) - n)[word] + np.bitwise_count(s[word] & upto))
    return last + 1, *ranks


def group_text(a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups written as `a1,a2|b1;` one after another (ASCII), and where each ends."""
    a_n, b_n = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.repeat(b_upto - b_n, a_n)] = a
    ids[np.arange(len(b)) + np.repeat(a_upto, b_n)] = b
    marks[a_upto - 1 + b_upto - b_n], marks[a_upto + b_upto - 1] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    most = int(ids.max(initial=0))
    for k in range(1, len(str(most))):
        digits += ids >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = marks
    for k in range(len(str(most))):
        at = np.flatnonzero(digits > k)
        out[ends[at] - 2 - k] = ids[at] // 10**k % 10 + 48
    return out, ends[a_upto + b_upto - 1]


class Sides:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte = {c: b for b, c in ALPHABET.items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.space, self.stops = self.b.piece_to_id("▁"), {p: self._plain(p) for p in ".,"}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(BYTE_PIECE.fullmatch(piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def _plain(self, pre_token: str) -> list[int]:
        return [t.id for t in self.a.model.tokenize(pre_token.encode().decode("latin-1").translate(WRITTEN))]

    def ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of a space and each unit."""
        a: list = []
        for u in units:
            word, stop = (u[:-1], self.stops[u[-1]]) if u[-1:] in self.stops else (u, [])
            a.append(self._plain(" " + word) + stop if word.isalpha() and not BEYOND.search(word) else None)
        left = [i for i, x in enumerate(a) if x is None]
        for i, e in zip(left, self.a.encode_batch([" " + units[i] for i in left], add_special_tokens=False), strict=True):
            a[i] = e.ids
        b = self.b.encode(units, num_threads=1)
        return a, [x if u else [self.space] for u, x in zip(units, b, strict=True)]


class PairTable:
    """All pairs (A id, B id) of which one token is a suffix of the other, by number."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        def by_bytes(v: list[bytes]) -> dict[bytes, list[int]]:
            out: dict[bytes, list[int]] = {}
            for i, x in enumerate(v):
                if x:
                    out.setdefault(x, []).append(i)
            return out

        in_a, in_b, self.width = by_bytes(a_bytes), by_bytes(b_bytes), len(b_bytes)
        pairs = [i * self.width + j for x, own_ in in_a.items() for k in range(len(x)) for j in in_b.get(x[k:], ()) for i in own_]
        pairs += [i * self.width + j for x, own_ in in_b.items() for k in range(1, len(x)) for i in in_a.get(x[k:], ()) for j in own_]
        self.keys = np.array(sorted(pairs), np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.width + b).astype(np.int32)


class Aligner:
    """Aligns texts through their units."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = Sides(a_path, b_path)
        self.pairs = PairTable(self.sides.a_bytes, self.sides.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.units, self.texts = Units(), []
        #: Of each unit: A and B tokens, groups (-1 of a unit whose tokens don't give back its bytes), and the end of its links.
        self.counts, self.ends, self.links = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self) -> None:
        """Aligns the units that were seen for the first time."""
        fresh = self.units.fresh.copy()
        self.units.fresh.clear()
        if not fresh:
            return
        s = self.sides
        a, b = s.ids(fresh)
        raw = [b" " + u.encode() for u in fresh]
        good = np.array([b"".join(map(s.a_bytes.__getitem__, x)) == r == b"".join(map(s.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw, strict=True)])
        for i in np.flatnonzero(~good).tolist():
            a[i], b[i] = [], []
        counts = np.array([[len(x), len(y), -1] for x, y in zip(a, b, strict=True)], np.int64)
        fa, fb = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        texts, links = [b""] * len(fresh), np.zeros(0, np.int32)
        if len(fa):
            cuts, a_upto, b_upto = aligned(s.a_len[fa], s.b_len[fb])
            links = self.pairs.number(fa[a_upto - 1], fb[b_upto - 1])
            buffer, ends = group_text(fa, fb, a_upto, b_upto)
            groups = np.searchsorted(cuts, np.cumsum([len(r) for r, g in zip(raw, good.tolist(), strict=True) if g]), "right")
            counts[good, 2] = np.diff(groups, prepend=0)
            flat, stops = buffer.tobytes(), ends[groups - 1].tolist()
            for i, start, stop in zip(np.flatnonzero(good).tolist(), [0, *stops], stops, strict=False):
                texts[i] = flat[start : stop - 1]
        self.texts += texts
        past = len(self.links)
        self.ends = np.concatenate([self.ends, past + np.cumsum(np.maximum(counts[:, 2], 0))])
        self.counts, self.links = np.concatenate([self.counts, counts]), np.concatenate([self.links, links])

    def pieces(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bytes] | None]:
        """(tokens of A, of B and groups; numbers of the linked pairs; groups as text) of each text; None if its bytes aren't given back."""
        if len(self.units) > MOST_UNITS:
            self.clear()
        get, numbers = self.units.__getitem__, []
        for t in texts:
            parts = CUT.split(" " + t)
            parts[0] = parts[0][1:]
            numbers.append(np.fromiter(map(get, parts), np.int64, len(parts)))
        self.learn()
        out: list = []
        for u in numbers:
            n = self.counts[u]
            if (n[:, 2] < 0).any():
                out.append(None)
                continue
            upto = np.cumsum(n[:, 2])
            at = np.repeat(self.ends[u] - upto, n[:, 2]) + np.arange(upto[-1])
            out.append((n.sum(0), self.links[at], b";".join(map(self.texts.__getitem__, u.tolist()))))
        return out


_kept: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker."""
    if (a_path, b_path) not in _kept:
        _kept[a_path, b_path] = Aligner(a_path, b_path)
    return _kept[a_path, b_path]


def _parts(text: str) -> Iterator[str]:
    """A text in pieces, cut where units are; the space of a cut belongs to the next piece, which has it anyway."""
    at = 0
    while len(text) - at > PIECE_CHARS and (m := CUT.search(text, at + PIECE_CHARS)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def alignments(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """Of each document: ALIGNED and, if asked for, `groups` (as text). links: numbers of its linked pairs, sorted, as differences."""
    schema = ALIGNED + ", groups string" * groups
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for batch in slices(batches, "text", 1 << 20):
            texts = batch["text"].to_pylist()
            short = [i for i, t in enumerate(texts) if t and len(t) <= PIECE_CHARS]
            whole = dict(zip(short, tool.pieces([texts[i] for i in short]), strict=True))
            rows = []
            for i, (doc, t) in enumerate(zip(batch["doc_id"].to_pylist(), texts, strict=True)):
                n, links, digest, said, good = np.zeros(3, np.int64), [], hashlib.sha256(), [], bool(t)
                for found in [whole[i]] if i in whole else (tool.pieces([p])[0] for p in _parts(t or "")) if t else ():
                    if found is None:
                        good = False
                        break
                    digest.update(b";" + found[2] if links else found[2])
                    if groups:
                        said.append(found[2].decode())
                    n += found[0]
                    links.append(found[1])
                if good:
                    sorted_ = np.sort(np.concatenate(links))
                    rows.append((doc, *n.tolist(), digest.hexdigest(), np.diff(sorted_, prepend=np.int32(0)).tobytes()) + (";".join(said),) * groups)
                else:
                    rows.append((doc, 0, 0, 0, "", b"") + ("",) * groups)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, schema)


def _links(value: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(value, np.int32))


def pair_counts(found: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links each pair of the table has, corpus-wide: sums of the tasks' own, n_pairs numbers at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in slices(batches, "links", 4 << 20):
            total += np.bincount(np.concatenate([_links(v) for v in batch["links"].to_pylist()]), minlength=n_pairs)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["pair", "n"])

    rows = found.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def score_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignments of all documents with their links held against the corpus-wide counts (SCORED)."""
    found = stored(alignments(docs, a_path, b_path), "alignments", compression="zstd")
    table = aligner(a_path, b_path).pairs
    counts = pair_counts(found, len(table.keys))
    b = table.keys % table.width
    best = np.zeros(table.width, np.int64)
    np.maximum.at(best, b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == best[b]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, top = shared.value
        for batch in slices(batches, "links", 4 << 20):
            links = [_links(v) for v in batch["links"].to_pylist()]
            cols = [pa.array([f(x) for x in links], pa.int64()) for f in (len, lambda x: int(top[x].sum()), lambda x: int(counts[x].sum()))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "n_a", "n_b", "n_groups")), *cols, batch["groups_sha256"]], names=[c.split()[0] for c in SCORED.split(", ")])

    return found.mapInArrow(score, SCORED)
