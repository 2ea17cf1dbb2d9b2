"""Prefix trie of conversations with smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that begin
with it, and its least member owns it. The least member of a node is the least of each deeper
node on its own path, too, so every conversation owns a suffix of its path, and (owner, depth)
names a node. Each node's text thus has one owned occurrence, and what a subtree saves is
the sum over its members' occurrences minus the owned ones: one group-by of the prefixes
sums, for each conversation, what follows on its path, and its leaf flag.

Turns become hashes and byte counts at once; no text is moved afterwards. Prefix hashes are
two 64-bit lanes, each the exclusive or of hashes of (place, turn). Conversations are numbered
and summed in blocks of BLOCK places, and only sums of blocks meet in one window, so that a
conversation with a large share of all turns is spread. A node's own ids are packed to runs in
ranges of a sort and hashed from these, run by run, as no list of them fits a row.

Defined results: turns go by turn (null first), then role and text; null role or text is
empty; rows without conv_id belong to no conversation and are left out; repeated rows are
turns of their own; an empty table gives no node; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, slices, stored

BLOCK = 4096
#: Bytes of ids in one packed run.
RUN_BYTES = 1 << 16
#: The remainders of conv_id and of its checksum that give a rebuilt conversation its head.
FAMILY, HEADS = 5, 9
TURN = "conv_id long, place long, t1 long, t2 long, bytes long"


def numbered(turns: DataFrame) -> DataFrame:
    """TURN of every turn, place from 1, in the order of turn, role and text."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    turns = own(turns, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    ranges = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *texts).repartitionByRange("conv_id", "turn", "role", "text")
    line = Window.partitionBy("conv_id", "b").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    hashes = [F.xxhash64(F.lit(s), "role", "text").alias(f"t{s}") for s in (1, 2)]
    rows = ranges.withColumn("b", F.spark_partition_id()).withColumn("r", F.row_number().over(line))
    rows = stored(rows.select("conv_id", "b", "r", *hashes, F.octet_length("text").cast("long").alias("bytes")), "turns")
    up = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "b").agg(F.count("*").alias("m")).select("conv_id", "b", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("before"))
    return rows.join(before, ["conv_id", "b"]).select("conv_id", (F.col("before") + F.col("r")).alias("place"), "t1", "t2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): conv_id and n, and TURN, of every conversation with the head of the first of its family.

    The head is the first h turns of conversation c - c % FAMILY; the conversation's own turns after its first h follow.
    """
    found = stored(numbered(turns), "numbered")
    sizes = found.groupBy("conv_id").agg(F.max("place").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    sizes = stored(sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")), "sizes")
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    every = stored(sizes.join(of_base, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0)))), "every")
    head = found.filter(F.col("place") < HEADS).withColumnRenamed("conv_id", "base").join(every.select("conv_id", "base", "head"), "base").filter("place <= head")
    tail = found.join(every.select("conv_id", "h", "head"), "conv_id").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("head"))
    names = [c.split()[0] for c in TURN.split(", ")]
    both = head.select(names).unionByName(tail.select(names))
    return every.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), both


def _along(rows: DataFrame, combine: str, values: list[str], backward: bool = False) -> DataFrame:
    """bit_xor or sum of values over each conversation's places up to each (from the last one, if backward) in r_<value>, by blocks."""
    rows = rows.withColumn("b", F.floor((F.col("place") - 1) / BLOCK))

    def line(keys: list[str], by: str, last: int) -> Window:
        order = F.col(by).desc() if backward else F.col(by)
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)

    def both(a: str, b: str) -> Column:
        return F.col(a).bitwiseXOR(F.col(b)) if combine == "bit_xor" else F.col(a) + F.col(b)

    whole = rows.groupBy("conv_id", "b").agg(*[F.expr(f"{combine}({v})").alias(v) for v in values])
    past = whole.select("conv_id", "b", *[F.coalesce(F.expr(f"{combine}({v})").over(line(["conv_id"], "b", -1)), F.lit(0).cast("long")).alias(f"p_{v}") for v in values])
    rows = rows.withColumns({f"r_{v}": F.expr(f"{combine}({v})").over(line(["conv_id", "b"], "place", 0)) for v in values}).join(past, ["conv_id", "b"])
    return rows.withColumns({f"r_{v}": both(f"r_{v}", f"p_{v}") for v in values}).drop("b", *[f"p_{v}" for v in values])


def paths(every: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, n, depth, bytes, h1, h2 and the same of the node above (u1, u2) for each node on each conversation's path, the root among them."""
    lanes = {f"l{s}": F.xxhash64(F.lit(s), "place", "t1", "t2") for s in (1, 2)}
    rows = _along(turns.withColumns(lanes), "bit_xor", [*lanes]).withColumnsRenamed({"r_l1": "h1", "r_l2": "h2"})
    above = {f"u{s}": F.col(f"h{s}").bitwiseXOR(F.col(f"l{s}")) for s in (1, 2)}
    rows = rows.withColumns(above).join(every, "conv_id").withColumn("depth", F.col("place"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = every.select("conv_id", "n", zero.alias("depth"), zero.alias("bytes"), zero.alias("h1"), zero.alias("h2"), none.alias("u1"), none.alias("u2"))
    return rows.select(root.columns).unionByName(root)


def ends_digest(ends: DataFrame) -> DataFrame:
    """h1, h2, ends_sha256: digest of each node's conv_ids in rising order, joined by commas. ends: h1, h2, conv_id."""
    runs, digests = "h1 long, h2 long, least long, run string", "h1 long, h2 long, ends_sha256 string"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, size, rows = None, [], 0, []

        def close() -> None:
            if run:
                rows.append((*key, int(run[0]), ",".join(run)))

        for batch in batches:
            for a, b, c in zip(*(batch[x].to_pylist() for x in ("h1", "h2", "conv_id")), strict=True):
                if (a, b) != key or size > RUN_BYTES:
                    close()
                    key, run, size = (a, b), [], 0
                run.append(str(c))
                size += len(run[-1]) + 1
            yield table(rows, runs)
            rows = []
        close()
        yield table(rows, runs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, rows = None, hashlib.sha256(), []
        for batch in slices(batches, "run"):
            for a, b, run in zip(*(batch[x].to_pylist() for x in ("h1", "h2", "run")), strict=True):
                if (a, b) == key:
                    h.update(b",")
                else:
                    if key:
                        rows.append((*key, h.hexdigest()))
                    key, h = (a, b), hashlib.sha256()
                h.update(run.encode())
            yield table(rows, digests)
            rows = []
        yield table([*rows, (*key, h.hexdigest())] if key else [], digests)

    def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
        kinds = [(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    packed = ends.repartitionByRange("h1", "h2", "conv_id").sortWithinPartitions("h1", "h2", "conv_id").mapInArrow(pack, runs)
    return packed.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "least").mapInArrow(digest, digests)


def prefix_trie(every: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of the trie of these conversations (conv_id, n) with these TURNs."""
    rows = stored(paths(every, turns), "paths")
    key = ["depth", "h1", "h2"]
    nodes = rows.groupBy(key).agg(F.min("conv_id").alias("owner"), F.max("n").alias("deepest"), F.min("u1").alias("u1"), F.min("u2").alias("u2"))
    nodes = stored(nodes, "nodes")
    # what each conversation owns: the nodes from `first` on, and a leaf if its path ends where no other goes on
    leaf = F.max((F.col("depth") == F.col("deepest")).cast("int")).alias("leaf")
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("first"), leaf)
    marked = rows.join(owned, "conv_id", "left")
    shared = F.when(F.col("first").isNull() | (F.col("depth") < F.col("first")), F.col("bytes")).otherwise(F.lit(0))
    marked = marked.withColumn("shared", shared).withColumn("place", F.col("depth") + 1)
    marked = _along(marked, "sum", ["shared"], backward=True)
    sums = marked.groupBy(key).agg(F.count("*").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"), F.sum("r_shared").alias("saved_tokens"))
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("h1"), F.col("u2").alias("h2")).agg(F.count("*").alias("n_children"))
    ends = ends_digest(rows.filter("depth = n").select("h1", "h2", "conv_id"))
    # a node's parent is on its owner's path; it is another's only where the owned part begins
    first = nodes.join(owned.select(F.col("conv_id").alias("owner"), "first"), "owner")
    top = first.filter("depth = first and depth > 0").select("owner", (F.col("depth") - 1).alias("depth"), F.col("u1").alias("h1"), F.col("u2").alias("h2"))
    parents = stored(top.join(nodes.select(*key, F.col("owner").alias("above")), key).select("owner", (F.col("depth") + 1).alias("depth"), "above"), "parents")
    out = stored(nodes.join(sums, key).join(kids, key, "left").join(ends, ["h1", "h2"], "left"), "summed")
    out = out.join(parents, ["owner", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "owner"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
