"""Chat formatting: collapse of cumulative snapshots before rendering.

Logs often hold a conversation again and again, each time with more turns. Each turn gets
a rolling hash of all turns up to it: two 64-bit lanes, each the exclusive or of hashes of
(place, role, text). A conversation whose last hash is an inner prefix hash of another is a
snapshot of a longer one and goes by an anti-join; of equal conversations the one with the
least conv_id stays. What remains is rendered.

Turns are numbered and hashed in blocks first, whose sums are then run over the conversation.
Blocks are the ranges of a sort of all turns, so a conversation that holds a large share of
them is spread, whatever its turn numbers are.

Defined results: turns go by (turn, role, text), null first; null role or text counts as a
value of its own (rendered as empty); repeated rows are turns of their own; a null conv_id
is one conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, stored

TEMPLATE = ("<|", "|>\n", "\n")


def _lane(seed: str, place: str) -> Column:
    return F.xxhash64(F.lit(seed), place, "role", F.col("role").isNull(), "text", F.col("text").isNull())


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, h1, h2 (of the turns up to here), n_turns."""
    ranges = own(turns, "conv_id", "turn", "role", "text").repartitionByRange("conv_id", "turn", "role", "text")
    turns = stored(ranges.withColumn("b", F.spark_partition_id()), "ranges")
    in_block = Window.partitionBy("conv_id", "b").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    blocks = turns.groupBy("conv_id", "b").agg(F.count("*").alias("m"))
    line = Window.partitionBy("conv_id").orderBy("b")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("b").alias("d"), F.coalesce(F.sum("m").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("conv_id")).alias("n_turns"))
    placed = turns.withColumn("r", F.row_number().over(in_block)).join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("b") == F.col("d"))).drop("c", "d")
    placed = placed.withColumn("place", (F.col("before") + F.col("r")).cast("long"))
    placed = placed.withColumn("l1", _lane("a", "place")).withColumn("l2", _lane("b", "place"))
    up = Window.partitionBy("conv_id", "b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("x1", F.expr("bit_xor(l1)").over(up)).withColumn("x2", F.expr("bit_xor(l2)").over(up))
    placed = stored(placed.select("conv_id", "b", "place", "role", "text", "x1", "x2", "n_turns"), "turns")
    whole = placed.groupBy("conv_id", "b").agg(F.max_by("x1", "place").alias("w1"), F.max_by("x2", "place").alias("w2"))
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    whole = whole.select(F.col("conv_id").alias("c"), F.col("b").alias("d"), F.coalesce(F.expr("bit_xor(w1)").over(past), zero).alias("p1"), F.coalesce(F.expr("bit_xor(w2)").over(past), zero).alias("p2"))
    out = placed.join(whole, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("b") == F.col("d")))
    return out.select("conv_id", "place", "role", "text", F.col("x1").bitwiseXOR(F.col("p1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("p2")).alias("h2"), "n_turns")


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): every conversation with `kept` and why, and the hashed turns.

    conversations: conv_id, n_turns, copies (equal conversations), snapshot, kept.
    """
    hashed = stored(prefix_hashes(turns), "hashed")
    last = hashed.filter("place = n_turns").select("conv_id", "n_turns", "h1", "h2")
    inner = hashed.filter("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    equal = last.groupBy("n_turns", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("m"), F.count("*").alias("copies"))
    key = ["n_turns", "h1", "h2"]
    maximal = equal.join(inner, key, "left_anti").withColumn("maximal", F.lit(True)).select(*key, "maximal")
    classes = equal.join(maximal, key, "left").select(*key, F.col("m.conv_id").alias("least"), "copies", F.col("maximal").isNull().alias("snapshot"))
    every = last.join(classes, key)
    kept = ~F.col("snapshot") & F.col("conv_id").eqNullSafe(F.col("least"))
    return every.select("conv_id", "n_turns", "copies", "snapshot", kept.alias("kept")), hashed


def rendered_turn(role: str = "role", text: str = "text") -> Column:
    a, b, c = TEMPLATE
    return F.concat(F.lit(a), F.coalesce(role, F.lit("")), F.lit(b), F.coalesce(text, F.lit("")), F.lit(c))


def render(kept: DataFrame, hashed: DataFrame) -> DataFrame:
    """conv_id, rendered: the turns of the kept conversations in order, by TEMPLATE."""
    turns = hashed.join(kept.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    line = F.transform(F.array_sort(F.collect_list(F.struct("place", rendered_turn().alias("t")))), lambda x: x["t"])
    return turns.groupBy("conv_id").agg(F.array_join(line, "").alias("rendered"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, snapshot, kept, rendered (null unless kept)."""
    every, hashed = collapse(turns)
    every = stored(every, "conversations")
    texts = render(every.filter("kept"), hashed).withColumnRenamed("conv_id", "c")
    return every.join(texts, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
