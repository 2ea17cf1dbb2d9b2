"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share by weight of a budget, at most `cap` times its own size;
what capped sources can't take is shared again by weight among the others. A document then
has an expected number of copies, target over source size. Its whole part is allocated with
certainty; for the rest, documents are ranked by their random odds u/(1-u) over their
inclusion odds p/(1-p), and taken in that order while their words fit the words still
wanted. The few words then left go, FILLS times, to the largest document that still fits.

Random numbers are hashes of a seed, the id, the source, the text and a number among rows
equal in all three, and every choice follows from them: reruns agree, however the rows lie.

The cut of a source is found in two steps, first the slot of the ranking in which its words
run out, then the place within this slot alone, so a source that holds a third of all rows
is spread over SLOTS groups. Sources are numbered in sorted partitions and shared out in
rounds of one aggregate each, so their number isn't bound by a task.

Defined results: null text has size 0 and is taken in whole copies only; a null source is a
source of its own, ordered last; repeated rows are drawn each for itself; sources of size
0 have target 0; an empty table gives no rows; further columns are ignored or kept as asked.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, stored

WORD = r"[^\x20\x09-\x0D]+"
SLOTS, FILLS = 2048, 4


def words_in(text: Column | str) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted(per: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """per (source, ...) with `w`: the weights in turn over the sources in code point order, null last."""
    low = (1 << 33) - 1  # of a row's number within its partition
    line = stored(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    line = line.withColumn("part", F.shiftright("at", 33).cast("int"))
    sizes = {r.part: r.m for r in line.groupBy("part").agg(F.count("*").alias("m")).collect()}  # a number a partition
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=0))
    rank = F.element_at(F.lit(before), F.col("part") + 1) + F.col("at").bitwiseAND(F.lit(low))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    return line.withColumn("w", w).drop("at", "part")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from rows (source, size)."""
    per = weighted(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    ratio, level, capped = F.col("most") / F.col("w"), 0.0, -1
    while True:  # the level only rises; it stands when no more sources reach their cap
        over = ratio < level
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("most"))).alias("taken"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count(F.when(over, 1)).alias("capped")).first()
        if r.w is None or r.capped == capped:
            break
        level, capped = (budget * (r["all"] or 0) - (r.taken or 0.0)) / r.w, r.capped
    return per.select("source", "source_size", F.least("most", F.when(ratio < level, F.col("most")).otherwise(F.col("w") * F.lit(level))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def pareto_sample(units: DataFrame, seed: int = 0) -> DataFrame:
    """units (doc_id, source, h, n, size, copies) with `taken_copies`.

    `copies` is the expected number of copies; (doc_id, source, h, n) tells the rows apart.
    """
    whole = F.floor("copies").cast("long")
    p = F.col("copies") - whole
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source", "h", "n"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    q = F.when((p > 0) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p)))
    ranked = units.withColumn("whole", whole).withColumn("p", p).withColumn("q", q)
    ranked = stored(ranked.withColumn("slot", F.floor(F.col("q") / (1 + F.col("q")) * SLOTS).cast("int")), "ranked")
    key = F.struct("q", "doc_id", "h", "n")
    slots = ranked.groupBy("source", "slot").agg(F.sum(F.when(F.col("q").isNotNull(), F.col("size"))).alias("m"), F.sum((F.col("p") * F.col("size")).cast("decimal(28,6)")).alias("wanted"))  # exact, in whatever order
    wanted = F.sum("wanted").over(Window.partitionBy("source")).cast("double")
    past = Window.partitionBy("source").orderBy(F.col("slot").asc_nulls_first())
    slots = slots.withColumn("wanted", wanted).withColumn("before", F.coalesce(F.sum("m").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = slots.filter((F.col("slot").isNotNull()) & (F.col("before") + F.col("m") > F.col("wanted")))
    # the slot in which a source's words run out; a source without one is taken whole
    marks = slots.groupBy("source").agg(F.first("wanted").alias("wanted"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    cut = last.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("slot", "before")).alias("c"))
    marks = stored(marks.join(cut, _same(F.col("source"), F.col("s")), "left").select(F.col("source").alias("s"), "wanted", "m", F.col("c.slot").alias("cut"), F.col("c.before").alias("before")), "marks")
    crossing = ranked.join(marks, _same(F.col("source"), F.col("s")) & (F.col("slot") == F.col("cut")))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("q", "doc_id", "h", "n").rowsBetween(Window.unboundedPreceding, 0))
    fitting = crossing.select("source", key.alias("key"), "size", "before", "wanted", run.alias("run")).filter(F.col("before") + F.col("run") <= F.col("wanted"))
    ends = fitting.groupBy(F.col("source").alias("t")).agg(F.max("key").alias("end"), F.max("run").alias("run"))
    kind = "struct<size:bigint,q:double,doc_id:bigint,h:bigint,n:bigint>"
    left = F.col("wanted") - F.when(F.col("cut").isNull(), F.col("m")).otherwise(F.col("before") + F.coalesce("run", F.lit(0)))
    goals = stored(marks.join(ends, _same(F.col("s"), F.col("t")), "left").select("s", "cut", "end", left.alias("left"), F.array().cast(f"array<{kind}>").alias("fills")), "cuts")
    behind = (F.col("slot") > F.col("cut")) | ((F.col("slot") == F.col("cut")) & (F.col("end").isNull() | (key > F.col("end"))))
    one = F.struct("size", "q", F.col("doc_id").cast("long").alias("doc_id"), "h", F.col("n").cast("long").alias("n"))
    for _ in range(FILLS):
        # a round's documents come in descending order, so the last one taken bounds the next
        open_ = ranked.join(goals, _same(F.col("source"), F.col("s"))).filter(behind & (F.col("size") <= F.col("left")))
        open_ = open_.withColumn("one", one).filter((F.size("fills") == 0) | (F.col("one") < F.element_at("fills", -1)))
        best = open_.groupBy(F.col("source").alias("t")).agg(F.max("one").alias("one"))
        more = goals.join(best, _same(F.col("s"), F.col("t")), "left")
        taken = F.col("one").isNotNull()
        goals = stored(more.select("s", "cut", "end", F.when(taken, F.col("left") - F.col("one.size")).otherwise(F.col("left")).alias("left"), F.when(taken, F.concat("fills", F.array(F.col("one").cast(kind)))).otherwise(F.col("fills")).alias("fills")), "cuts")
    drawn = ranked.join(goals, _same(F.col("source"), F.col("s")), "left")
    extra = F.when(F.col("q").isNull(), 0).when(F.col("cut").isNull() | ~behind | F.array_contains("fills", one.cast(kind)), 1).otherwise(0)
    return drawn.select(*units.columns, (F.col("whole") + F.coalesce(extra, F.lit(0))).alias("taken_copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """Per document: doc_id, source, h (hash of the text), size, source_size, target, taken_copies, taken (words)."""
    sized = own(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("h"), words_in("text").alias("size"))
    # rows equal in id, source and text are numbered by their count: no order among them is needed
    sized = sized.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("m"))
    sized = stored(sized.select("doc_id", "source", "h", "size", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("n")), "sizes")
    goals = stored(source_targets(sized, weights, budget, cap), "targets")
    units = sized.join(goals.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s"))).drop("s")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = pareto_sample(units.withColumn("copies", F.least(copies, F.lit(float(cap)))), seed)
    return drawn.withColumn("taken", F.col("size") * F.col("taken_copies")).drop("n", "copies")
