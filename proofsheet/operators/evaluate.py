"""Evaluation and calibration: outcomes by facet, false alarms, percentiles, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import text as X
from proofsheet.functions.boxes import overlap_score
from proofsheet.functions.verdict import finite6
from proofsheet.tables import stored

from .versions import LEAST_OVERLAP


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def facet_tally(cases: DataFrame, facets: list[str], outcome: str = "outcome") -> DataFrame:
    """Counts of each facet value by outcome: one scan, one aggregation over grouping sets."""
    values = cases.select(outcome, *[F.col(f).cast("string").alias(f) for f in facets])
    pairs = values.select(outcome, F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets])).alias("p"))
    return pairs.groupBy("p.facet", "p.value", outcome).agg(F.count("*").alias("n"))


def accuracy(tally: DataFrame) -> DataFrame:
    """Cases, accuracy among the decided ones and coverage of each facet value."""
    n = lambda *o: F.coalesce(F.sum(F.when(F.col("outcome").isin(*o), F.col("n"))), F.lit(0))
    decided = n("CORRECT", "WRONG")
    return tally.groupBy("facet", "value").agg(F.sum("n").alias("cases"), share(n("CORRECT"), decided).alias("accuracy_when_decided"), share(decided, F.sum("n")).alias("coverage"))


def false_alarms(cases: DataFrame, least_quality: int = 75) -> DataFrame:
    """Among approved artwork: wrong verdicts and refusals, which are different failures; also at good quality (none stated counts)."""
    good = F.coalesce(F.col("quality") >= least_quality, F.lit(True))
    wrong, refused = F.col("outcome") == "WRONG", F.col("outcome") == "REFUSED"
    return cases.filter("approved").agg(F.count("*").alias("approved"), F.count_if(wrong).alias("false_alarms"), F.count_if(refused).alias("refusals"), F.count_if(wrong & good).alias("false_alarms_good"), F.count_if(refused & good).alias("refusals_good"))


def percentile(c: str, q: float) -> Column:
    """Exact percentile by linear interpolation."""
    return F.percentile(c, q)


def percentiles(rows: DataFrame, values: list[str], wanted: dict[str, tuple[str, float]], keys: list[str] | None = None) -> DataFrame:
    """Exact percentiles by linear interpolation: a column for each of wanted (name -> value column, share) in one row a group.

    All ranks of all groups and value columns come from one sort: equal values are counted first, ranges of the sorted values
    know how many lie before them, and each wanted rank is the value whose places hold it. rows are scanned once, whatever the
    number of ranks; no task holds a group. Nulls and NaN don't count; a group without a value gives none, and no rows
    without keys give one row of nulls.
    """
    keys = keys or []
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c_"), F.col(v).cast("double").alias("v_")) for i, v in enumerate(values)]))
    known = rows.select(*keys, each.alias("x_")).select(*keys, "x_.*").filter("v_ is not null and not isnan(v_)")
    counted = stored(known.groupBy(*keys, "c_", "v_").agg(F.count("*").alias("n_")), "counted")
    placed = stored(counted.repartitionByRange(*keys, "c_", "v_").withColumn("p_", F.spark_partition_id()), "ranges")
    line = Window.partitionBy(*keys, "c_")
    sums = placed.groupBy(*keys, "c_", "p_").agg(F.sum("n_").alias("m_"))  # a row for each range that a group lies in
    sums = sums.select(*keys, "c_", "p_", F.coalesce(F.sum("m_").over(line.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("m_").over(line).alias("all_"))
    inside = F.sum("n_").over(Window.partitionBy(*keys, "c_", "p_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "c_", "p_")]
    joined = placed.withColumn("inside_", inside).alias("a").join(sums.alias("b"), same)
    ends = joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.c_", "v_", (F.col("before_") + F.col("inside_")).alias("end_"), "n_", "all_")
    out = []
    for name, (value, share_) in wanted.items():
        place = F.lit(share_) * (F.col("all_") - 1)
        low = F.floor(place)
        here = F.col("c_") == values.index(value)

        def at(rank: Column, here: Column = here) -> Column:
            return F.max(F.when(here & (rank < F.col("end_")) & (rank >= F.col("end_") - F.col("n_")), F.col("v_")))

        a, b = at(low), at(F.least(low + 1, F.col("all_") - 1))
        out.append((a + (b - a) * F.max(F.when(here, place - low))).alias(name))
    return ends.groupBy(*keys).agg(*out)


def noise_thresholds(samples: DataFrame, value: str, changed: str) -> DataFrame:
    """Threshold from unchanged samples (p99.9) and its margin to the changed ones (p99)."""
    quiet, moved = F.when(~F.col(changed), F.col(value)).alias("quiet"), F.when(F.col(changed), F.col(value)).alias("moved")
    found = percentiles(samples.select(quiet, moved), ["quiet", "moved"], {"threshold": ("quiet", 0.999), "top": ("moved", 0.99)})
    return found.select("threshold", (F.col("top") - F.col("threshold")).alias("margin"))


def pair_thresholds(samples: DataFrame, changed: str, ssim: str = "ssim", chroma: str = "chroma") -> DataFrame:
    """Thresholds of pairs: p99.9 of the unchanged pixels' structural and colour differences, and their margins to the changed ones' p99."""
    split = {f"{c}_{s}": F.when(F.col(changed) == (s == "moved"), F.col(v)) for c, v in (("ssim", ssim), ("chroma", chroma)) for s in ("quiet", "moved")}
    wanted = {n: (n, 0.999 if n.endswith("quiet") else 0.99) for n in split}
    found = percentiles(samples.select(*[c.alias(n) for n, c in split.items()]), [*split], wanted)
    return found.select(*[x for c in ("ssim", "chroma") for x in (F.col(f"{c}_quiet").alias(f"{c}_threshold"), (F.col(f"{c}_moved") - F.col(f"{c}_quiet")).alias(f"{c}_margin"))])


def tails(samples: DataFrame, key: str, value: str) -> DataFrame:
    """The p99.9 of each image, then percentiles of those."""
    per = percentiles(samples, [value], {"tail": (value, 0.999)}, [key])
    return percentiles(per, ["tail"], {f"p{int(q * 100)}": ("tail", q) for q in (0.5, 0.95, 0.99)})


def clean_cutoff(fraction: Column) -> Column:
    return F.greatest(3 * F.max(fraction), F.lit(1e-5))


def region_cutoff(quiet: str, moved: str) -> Column:
    """Geometric mean of the quiet ones' p99 and the changed ones' p05, within .005 and .5."""
    mean = F.sqrt(F.greatest(F.percentile(quiet, 0.99), F.lit(1e-4)) * F.greatest(F.percentile(moved, 0.05), F.lit(1e-3)))
    return F.greatest(F.lit(0.005), F.least(F.lit(0.5), mean))


def histogram(samples: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return samples.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def pipeline_confidence(stages: DataFrame) -> DataFrame:
    """Least confidence over the stages but the hash, nulls apart; none gives 0."""
    c = F.when(F.col("stage") != "hash", F.col("confidence"))
    return stages.groupBy("case_id").agg(F.bround(F.coalesce(F.min(c), F.lit(0.0)), 4).alias("confidence"))


def run_rates(done: DataFrame, key: str, seconds: Column, cached: Column, totals: DataFrame | None = None) -> DataFrame:
    """Of each run: images done, images a second, share of cached ones and, with totals (key, total), the seconds that are left."""
    per = done.groupBy(key).agg(F.count("*").alias("done"), (F.count("*") / (F.max(seconds) - F.min(seconds) + 1)).alias("rate"), (F.count_if(cached) / F.count("*")).alias("cached_share"))
    if totals is None:
        return per
    left = F.greatest(F.col("total") - F.coalesce("done", F.lit(0)), F.lit(0))
    return totals.join(per, key, "left").withColumn("seconds_left", F.when(left == 0, 0.0).otherwise(F.try_divide(left, F.col("rate")))).drop("total")


def findings_with_images(findings: DataFrame, images: DataFrame) -> DataFrame:
    """Findings with their image's columns (prefixed image_); a finding whose image is gone stays, with nulls."""
    named = images.select("image_id", *[F.col(c).alias(f"image_{c}") for c in images.columns if c != "image_id"])
    return findings.join(named, "image_id", "left")


def stage_timing(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.median("ms"), 6).alias("median_ms"), F.max("ms").alias("max_ms"))


def trace_rows(stages: DataFrame) -> DataFrame:
    """The trace of each case, in order, kept unless it passed; metrics that aren't finite are null."""
    entry = F.struct("ordinal", "stage", finite6("ms").alias("ms"))
    per = stages.groupBy("case_id", "verdict").agg(F.array_sort(F.collect_list(entry)).alias("trace"))
    return per.withColumn("trace", F.when(F.col("verdict") != "PASS", F.col("trace")))


def strided(samples: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Every k-th sample of a group so that `most` remain at most, the first one included."""
    n = F.count("*").over(Window.partitionBy(key))
    i = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return samples.withColumn("i_", i).withColumn("k_", F.ceil(n / most)).filter("i_ % k_ = 0").drop("i_", "k_")


def stratified_plan(weights: DataFrame, count: int) -> DataFrame:
    """(class, n) with proportional counts, in turn: the first of each class, then the second."""
    total = F.sum("weight").over(Window.partitionBy())
    per = weights.withColumn("m", F.greatest(F.lit(1), F.bround(F.col("weight") * count / total, 0).cast("int")))
    return per.select("class", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("n"))


# --- pairs

#: The verdicts that each class of pairs accepts.
ACCEPTED = {
    "identical": ["IDENTICAL"], "recompressed": ["MATCH"], "resized": ["MATCH"], "shifted": ["MATCH"],
    "recoloured": ["MATCH_WITH_COSMETIC_DIFFERENCES", "NEEDS_REVIEW"], "text_edit": ["DIFFERENT", "NEEDS_REVIEW"], "number_edit": ["DIFFERENT", "NEEDS_REVIEW"],
    "element_removed": ["DIFFERENT", "NEEDS_REVIEW"], "different_product": ["CANNOT_COMPARE"],
}
UNCHANGED = ["identical", "recompressed", "resized", "shifted", "recoloured"]


def scored_pairs(cases: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """cases with score (correct, refused, false_alarm, wrong or failed), localised and read.

    cases: class, verdict, errored, boxes (found), edit_box (null if nothing was edited), old_value, new_value,
    readings (ref_text, mkt_text of each region). An edit is localised if a box overlaps it, and read if one region
    has all tokens of the old value on the reference's side and of the new one on the listing's.
    """
    accepted = F.create_map(*[x for k, v in ACCEPTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    ok = F.coalesce(F.array_contains(F.try_element_at(accepted, F.col("class")), F.col("verdict")), F.lit(False))
    alarm = F.col("class").isin(UNCHANGED) & (F.col("verdict") == "DIFFERENT")
    score = F.when(F.col("errored"), "failed").when(ok, "correct").when(F.col("verdict") == "CANNOT_COMPARE", "refused").when(alarm, "false_alarm").otherwise("wrong")
    localised = F.col("edit_box").isNotNull() & F.exists("boxes", lambda b: overlap_score(F.col("edit_box"), b) > least)
    rows = cases.withColumns({"score": score, "localised": F.coalesce(localised, F.lit(False))})
    # no row leaves its task: all regions of a case are folded at once, and only those of edits
    edit, empty = F.col("edit_box").isNotNull(), F.array().cast("array<string>")
    sides = {c: X.folded_each(F.col(f"readings.{t}")) for c, t in (("a_", "ref_text"), ("b_", "mkt_text"))}
    said = rows.filter(edit).withColumns(sides | {c: F.coalesce(X.tokens(F.col(v)), empty) for c, v in (("p_", "old_value"), ("q_", "new_value"))})
    lacks = lambda value, text: F.size(F.array_except(value, F.coalesce(X.tokens_of(text), empty))) > 0
    both = F.zip_with("a_", "b_", lambda a, b: ~lacks(F.col("p_"), a) & ~lacks(F.col("q_"), b))
    read = said.withColumn("read", F.coalesce(F.exists(both, lambda x: x), F.lit(False))).drop("a_", "b_", "p_", "q_")
    return read.unionByName(rows.filter(~edit).withColumn("read", F.lit(False)))


def class_summary(scored: DataFrame) -> DataFrame:
    """Of each class: cases, accuracy, false alarms, refusals, and of its edits the shares localised and read (null without edits)."""
    edits = F.count_if(F.col("edit_box").isNotNull())
    share = lambda c: F.try_divide(F.count_if(F.col(c)), edits)
    n = lambda s: F.count_if(F.col("score") == s)
    return scored.groupBy("class").agg(F.count("*").alias("cases"), (n("correct") / F.count("*")).alias("accuracy"), n("false_alarm").alias("false_alarms"), n("refused").alias("refused"), share("localised").alias("localisation_rate"), share("read").alias("read_rate"))


def key_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of two tables with the side they are on: both, left or right."""
    say = lambda df, s: df.withColumn("side", F.lit(s))
    return say(a.intersect(b), "both").unionByName(say(a.distinct().exceptAll(b.distinct()), "left")).unionByName(say(b.distinct().exceptAll(a.distinct()), "right"))


# --- readings of an engine


def reading_order(tokens: DataFrame, region: str, tie: str, band: float = 0.6) -> DataFrame:
    """tokens (region, x, y, w, h) with their `place`: lines of `band` times the median height, then from left to right."""
    w = Window.partitionBy(region)
    line = F.bround(F.col("y") / F.greatest(F.lit(1.0), band * F.median("h").over(w)), 0)
    return tokens.withColumn("line_", line).withColumn("place", F.row_number().over(w.orderBy("line_", "x", tie)).cast("long")).drop("line_")


# --- the corpus of variants

#: The axes of the transforms that a corpus applies.
AXES = {"quality": [95, 85, 75, 60], "size": [1500, 1200, 1000, 800], "padding": ["none", "white", "transparent"], "format": ["jpeg", "webp"], "extra": ["strip", "exif", "srgb"]}


def variant_cross_product(spark) -> DataFrame:
    """All 288 transforms."""
    out = spark.range(1).select()
    for name, values in AXES.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def variant_grid(spark, seed: int = 0, per_cell: int = 1) -> DataFrame:
    """Each quality and size with per_cell draws of the other axes, which follow from the seed."""
    out = spark.range(per_cell).select(F.col("id").alias("draw"))
    for name in ("quality", "size"):
        out = out.select("*", F.explode(F.array(*map(F.lit, AXES[name]))).alias(name))
    for name in ("padding", "format", "extra"):
        values = F.array(*map(F.lit, AXES[name]))
        out = out.withColumn(name, F.element_at(values, (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "quality", "size", "draw"), F.lit(len(AXES[name]))) + 1).cast("int")))
    return out.drop("draw")
