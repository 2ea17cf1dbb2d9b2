"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of text.

Leaves are runs of up to 32 characters counted from the start of their sentence, so an
edit inside one sentence leaves the leaves of the others as they are. Paragraphs hash
their leaves, sections (split by blank lines) their paragraphs, the root its sections.
A fingerprint is `root|section/section`, a section its digest and `paragraph.paragraph`, a
paragraph its digest and its leaves' digests cut to six hex digits: equal roots mean equal
texts, and differing branches, found from the root down, locate edits.

Defined results: null text counts as empty; the empty text has a root and no leaves; equal
texts (repeated rows too) have equal fingerprints; an empty table gives no rows; a lone
document is its own next one; rows with equal ids are ordered by a hash of their text; a null id sorts
before all others; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, by_bucket, order_key, own, slices, texts_of, tie_key

LEAF = re.compile(r"[^.\n]{1,32}\.?|[.\n]")
BLANK = re.compile(r"(\n[ \t]*\n+)")
#: Hex digits of a leaf, and bytes of an inner node's digest.
CUT, NODE = 6, 4


def _digest(data: bytes, kind: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


def fingerprint(text: str) -> str:
    """The Merkle fingerprint of one text."""
    blake, sections, tops = hashlib.blake2b, [], []
    for section in BLANK.split(text) if text else ():
        paragraphs, hashes = [], []
        for line in section.split("\n"):
            leaves = [blake(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in LEAF.findall(line)]
            node = _digest(b"".join(leaves), b"paragraph")
            hashes.append(node)
            paragraphs.append(node[:NODE].hex() + "".join([x.hex()[:CUT] for x in leaves]))
        top = _digest(b"".join(hashes), b"section")
        sections.append(top[:NODE].hex() + ".".join(paragraphs))
        tops.append(top)
    return f"{_digest(b''.join(tops), b'root').hex()}|{'/'.join(sections)}"


def _tree(print_: str) -> list[tuple[str, list[str]]]:
    """Sections (their digest and their paragraphs, each its digest and its leaves)."""
    body = print_.partition("|")[2]
    return [(s[: 2 * NODE], s[2 * NODE :].split(".")) for s in body.split("/")] if body else []


def _leaves(print_: str) -> list[str]:
    every = "".join([p[2 * NODE :] for _, paragraphs in _tree(print_) for p in paragraphs])
    return [every[i : i + CUT] for i in range(0, len(every), CUT)]


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, 0 to 1; 1 only for equal roots."""
    if a == b:
        return 1.0
    x, y = _leaves(a), _leaves(b)
    if not x or not y:
        return 0.0
    both = sum((Counter(x) & Counter(y)).values())
    return min(2 * both / (len(x) + len(y)), 1 - 1 / (len(x) + len(y) + 1))


#: Cells of a table that nodes are aligned by where none is unique, and rounds of anchors.
CELLS, ANCHOR_ROUNDS = 4096, 3


def differing(p: list[str], q: list[str]) -> list[tuple[int, int, int, int]]:
    """Runs (i, j, k, m) in which p[i:j] gave way to q[k:m], in time about linear in both.

    Equal ends are trimmed; nodes that occur once on both sides and keep their order are anchors, and what lies between them is
    aligned by itself. Where nothing is unique, short runs are compared in full and long ones differ as a whole.
    """
    out, open_ = [], [(0, len(p), 0, len(q), 0)]
    while open_:
        i, j, k, m, depth = open_.pop()
        while i < j and k < m and p[i] == q[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and p[j - 1] == q[m - 1]:
            j, m = j - 1, m - 1
        if i == j or k == m:
            if i < j or k < m:
                out.append((i, j, k, m))
            continue
        if (j - i) * (m - k) <= CELLS:
            out += [(i + a, i + b, k + c, k + d) for tag, a, b, c, d in SequenceMatcher(None, p[i:j], q[k:m], autojunk=False).get_opcodes() if tag != "equal"]
            continue
        line = anchors(p[i:j], q[k:m]) if depth < ANCHOR_ROUNDS else []
        if not line:
            out.append((i, j, k, m))
            continue
        ends = [(i, k), *((i + x, k + y) for x, y in line), (j, m)]
        open_ += [(a, c, b, d, depth + 1) for (a, b), (c, d) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def anchors(p: list[str], q: list[str]) -> list[tuple[int, int]]:
    """Places of nodes that occur once in both, the longest sequence of them that rises on both sides."""
    once, there = ({x for x, n in Counter(v).items() if n == 1} for v in (p, q))
    at = {x: n for n, x in enumerate(q) if x in there}
    pairs = [(n, at[x]) for n, x in enumerate(p) if x in once and x in at]
    tops: list[int] = []  # least end of a rising sequence of each length
    last: list[int] = []  # its pair
    before = [-1] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        size = bisect_left(tops, y)
        before[n] = last[size - 1] if size else -1
        tops[size : size + 1], last[size : size + 1] = [y], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def changed_branches(a: str, b: str) -> list[tuple[str, int, int]]:
    """Where the edits from a to b are: (changed or removed, section and paragraph of a) and (inserted, those of b).

    Equal roots end the search; sections are aligned by their digests and only differing ones are descended, where
    paragraphs are aligned by theirs, so that an insertion doesn't move what comes after it.
    """
    if a == b:
        return []
    x, y, out = _tree(a), _tree(b), []
    for i, j, k, m in differing([s for s, _ in x], [s for s, _ in y]):
        both = min(j - i, m - k)
        for n in range(both):
            p, q = x[i + n][1], y[k + n][1]
            for c, d, e, f in differing([t[: 2 * NODE] for t in p], [t[: 2 * NODE] for t in q]):
                same = min(d - c, f - e)
                out += [("changed", i + n, c + r) for r in range(same)] + [("removed", i + n, r) for r in range(c + same, d)] + [("inserted", k + n, r) for r in range(e + same, f)]
        out += [("removed", n, r) for n in range(i + both, j) for r in range(len(x[n][1]))]
        out += [("inserted", n, r) for n in range(k + both, m) for r in range(len(y[n][1]))]
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and a column `fingerprint`."""

    @F.pandas_udf("string")
    def of(texts):
        return texts.fillna("").map(fingerprint)

    return docs.withColumn("fingerprint", of(F.col(text_col)))


def edited_text(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed_paragraphs int"


def edit_probe(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (EDITS).

    The last third of a text gives way to the start of the next document in descending id
    order. One range shuffle brings the texts into id order; each bucket also gets the last
    document of the bucket before it, so no window spans the table.
    """
    docs = own(docs, "doc_id", "text")
    buckets = Buckets(docs)
    n = len(buckets)
    if not n:
        return docs.sparkSession.createDataFrame([], EDITS)
    places = docs.withColumns({"k": order_key(), "h": tie_key()}).withColumn("place", buckets.column())
    b = F.floor(F.col("place") / 2)
    here = F.struct(b.alias("b"), F.lit(1).alias("own"))
    after = F.struct(((b + 1) % n).alias("b"), F.lit(0).alias("own"))
    placed = places.select("doc_id", "text", "k", "h", F.explode(F.when(F.col("place") % 2 == 1, F.array(here, after)).otherwise(F.array(here))).alias("p"))
    placed = placed.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "k", "h", "p.b", "p.own")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = before = before_print = None
        for batch in slices(batches, "text"):
            rows = []
            for doc, text, at, mine in zip(batch["doc_id"].to_pylist(), texts_of(batch), batch["b"].to_pylist(), batch["own"].to_pylist(), strict=True):
                if at != bucket:
                    bucket, before, before_print = at, text, None
                if mine:
                    if before_print is None:
                        before_print = fingerprint(before)
                    mark, new = fingerprint(text), edited_text(text, before)
                    new_mark = mark if new == text else fingerprint(new)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc, len(text), sha, mark, new_mark, likeness(mark, new_mark), likeness(mark, before_print), len(changed_branches(mark, new_mark))))
                    before, before_print = text, mark
                else:
                    before, before_print = text, None
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in EDITS.split(", ")])

    return by_bucket(placed, "b", n, "own", "k", "h", "text").mapInArrow(probe, EDITS)
