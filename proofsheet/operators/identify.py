"""Identification of a listing among a product's versions, as a cascade of tables.

Each stage decides some probes and hands the rest on, so that costly stages see only what
cheap ones left open. No probe is accepted because the stages ran out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions.verdict import margin_confidence, margin_gate
from proofsheet.tables import stored

#: Probes and candidates of a product that are compared at once.
BLOCK = 512
NEAREST = "probe_id long, hits long, matched_id long, fraction double, first double, first_id long, second double"


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """product_id and the number of blocks for its rows."""
    return rows.groupBy("product_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(key))


def nearest(probes: DataFrame, candidates: DataFrame, threshold: float, clean: float) -> DataFrame:
    """What whole_image and ranked need of each probe's fractions, without a row a pair: NEAREST, with the candidates under `clean` counted.

    A block of probes meets a block of its product's candidates in numpy, and each probe leaves it with one row. The pairs of a
    product grow with the square of its rows, but tables only with their BLOCKth part. Only vectors of one length, without nulls, are compared.
    """
    first = candidates.groupBy("product_id", "sha").agg(F.min_by(F.struct("candidate_id", "ref"), "candidate_id").alias("c")).select("product_id", "c.*")
    whole = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull())
    p, c = probes.select("probe_id", "product_id", "vec").filter(whole("vec")), first.filter(whole("ref"))
    sizes = stored(_blocks(p, "p_").join(_blocks(c, "c_"), "product_id"), "blocks")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = ["product_id", "dims", "pb", "cb"]
    p = p.join(F.broadcast(sizes), "product_id").select("product_id", F.size("vec").alias("dims"), deal("probe_id", "p_").alias("pb"), every("c_").alias("cb"), "probe_id", "vec")
    # both sides may come from one table: the name is given anew
    c = c.join(F.broadcast(sizes), "product_id").select(F.col("product_id").alias("product_id"), F.size("ref").alias("dims"), every("p_").alias("pb"), deal("candidate_id", "c_").alias("cb"), "candidate_id", "ref")

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in NEAREST.split(", ")]
        kinds = [pa.float64() if x.endswith("double") else pa.int64() for x in NEAREST.split(", ")]
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        right = right.sort_by("candidate_id")
        dims, ids = left["dims"][0].as_py(), right["candidate_id"].to_numpy()
        flat = lambda t, x: np.ascontiguousarray(t[x].combine_chunks().flatten().to_numpy().reshape(-1, dims).T)
        theirs = flat(right, "ref")
        parts: list[list[np.ndarray]] = []
        for at in range(0, left.num_rows, BLOCK):
            mine = flat(left.slice(at, BLOCK), "vec")
            alike = np.zeros((mine.shape[1], len(ids)), np.int16 if dims < 2**15 else np.int64)
            for a, b in zip(mine, theirs, strict=True):
                alike += np.abs(a[:, None] - b[None]) <= threshold
            share = (dims - alike.astype(np.int64)) / dims
            hit, rows = share < clean, np.arange(len(share))
            one = share.argmin(1)  # the first of equals
            least = share[rows, one]
            share[rows, one] = np.inf
            parts.append([left["probe_id"].slice(at, BLOCK).to_numpy(), hit.sum(1), np.where(hit.any(1), ids[hit.argmax(1)], -1), least, least, ids[one], share.min(1)])
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        none = {2: cols[1] == 0, 6: np.isinf(cols[6])}
        return pa.table([pa.array(v, k, mask=none.get(i)) for i, (v, k) in enumerate(zip(cols, kinds, strict=True))], names=names)

    seen = p.groupBy(*group).cogroup(c.groupBy(*group)).applyInArrow(met, NEAREST)
    order = F.sort_array(F.array_compact(F.flatten(F.collect_list(F.array("first", "second")))))
    per = seen.groupBy("probe_id").agg(F.sum("hits").alias("n"), F.min("matched_id").alias("matched_id"), F.min("fraction").alias("fraction"), F.min(F.struct("first", "first_id")).alias("w"), order.alias("o"))
    return stored(per.select("probe_id", "n", "matched_id", "fraction", F.col("w.first_id").alias("first_id"), F.col("w.first").alias("best"), F.get("o", F.lit(1)).alias("runner_up")), "nearest")


def clean_one(near: DataFrame) -> DataFrame:
    """whole_image of a table of nearest ones."""
    return near.filter("n = 1").select("probe_id", "matched_id", (1 - F.col("fraction")).alias("confidence"))


def leading(near: DataFrame, ratio: float) -> DataFrame:
    """ranked of a table of nearest ones."""
    per = near.filter(F.col("runner_up").isNotNull()).filter(margin_gate("best", "runner_up", ratio))
    return per.select("probe_id", F.col("first_id").alias("matched_id"), margin_confidence("best", "runner_up").alias("confidence"))


def fractions(probes: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Share of changed values for each probe and candidate of its product.

    probes: probe_id, product_id, vec; candidates: candidate_id, product_id, sha, ref. Only
    one candidate of each content is compared.
    """
    first = candidates.groupBy("product_id", "sha").agg(F.min_by(F.struct("candidate_id", "ref"), "candidate_id").alias("c")).select("product_id", "c.*")
    pairs = probes.join(first, "product_id")
    changed = F.aggregate(F.zip_with("vec", "ref", lambda a, b: (F.abs(a - b) > threshold).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.select("probe_id", "product_id", "candidate_id", (changed / F.size("vec")).alias("fraction"))


def whole_image(compared: DataFrame, clean: float) -> DataFrame:
    """Probes with exactly one candidate strictly under the limit."""
    hit = F.col("fraction") < clean
    per = compared.groupBy("probe_id").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("candidate_id"))).alias("matched_id"), F.min("fraction").alias("fraction"))
    return per.filter("n = 1").select("probe_id", "matched_id", (1 - F.col("fraction")).alias("confidence"))


def ranked(totals: DataFrame, ratio: float) -> DataFrame:
    """Winner by least total over the runner-up, if it leads by the ratio.

    totals: probe_id, candidate_id, total.
    """
    w = Window.partitionBy("probe_id").orderBy("total", "candidate_id")
    two = totals.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    per = two.groupBy("probe_id").agg(F.max(F.when(F.col("n") == 1, F.col("candidate_id"))).alias("matched_id"), F.max(F.when(F.col("n") == 1, F.col("total"))).alias("best"), F.max(F.when(F.col("n") == 2, F.col("total"))).alias("runner_up"))
    per = per.filter(F.col("runner_up").isNotNull())
    return per.filter(margin_gate("best", "runner_up", ratio)).select("probe_id", "matched_id", margin_confidence("best", "runner_up").alias("confidence"))


def single_candidate(compared: DataFrame, accept_below: float) -> DataFrame:
    """Probes whose product has one content only, if it is near enough."""
    per = compared.groupBy("probe_id").agg(F.count("*").alias("n"), F.min("candidate_id").alias("matched_id"), F.min("fraction").alias("fraction"))
    return per.filter((F.col("n") == 1) & (F.col("fraction") < accept_below)).select("probe_id", "matched_id", (1 - F.col("fraction")).alias("confidence"))


def waterfall(probes: DataFrame, stages: list[tuple[str, object]]) -> DataFrame:
    """probe_id, matched_id, confidence, method by the first stage that decides; NONE if none does.

    A stage takes the open probes and returns probe_id, matched_id, confidence of those it decides. What it finds is
    a table in the shared folder, so that no stage runs twice.
    """
    open_, done = probes, None
    for name, stage in stages:
        found = stored(stage(open_).withColumn("method", F.lit(name)), "decided")
        done = found if done is None else done.unionByName(found)
        open_ = open_.join(found.select("probe_id"), "probe_id", "left_anti")
    rest = open_.select("probe_id", F.lit(None).cast("long").alias("matched_id"), F.lit(0.0).alias("confidence"), F.lit("NONE").alias("method"))
    return done.unionByName(rest)
