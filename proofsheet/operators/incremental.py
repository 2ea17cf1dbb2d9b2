"""Incremental runs: what to process again, what to carry forward, what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A finding is carried forward only if all of these are as they were in the last complete run.
KEY = ["sha", "current_version_id", "config_hash", "pipeline_version"]


def previous_run(runs: DataFrame) -> DataFrame:
    """run_id and the last complete run before it."""
    done = F.when(F.col("status") == "COMPLETE", F.col("run_id"))
    before = Window.partitionBy().orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    return runs.select("run_id", F.max(done).over(before).alias("previous_id"))


def partition_cached(current: DataFrame, previous: DataFrame, key: list[str] | None = None) -> DataFrame:
    """current by path with `cached` and the previous finding's id; errors are processed again.

    current: path and the key's columns; previous: the same, verdict and finding_id.
    """
    key = KEY if key is None else key
    old = previous.select("path", *[F.col(k).alias(f"old_{k}") for k in key], "verdict", "finding_id")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"old_{k}"))
    hit = F.coalesce(F.col("finding_id").isNotNull() & same & (F.col("verdict") != "ERROR"), F.lit(False))
    return current.join(old, "path", "left").select(*current.columns, hit.alias("cached"), F.when(hit, F.col("finding_id")).alias("carried_id"))


def carry_forward(cached: DataFrame, findings: DataFrame, run_id: Column) -> DataFrame:
    """The previous findings of cached paths as rows of this run, error and trace included."""
    return cached.filter("cached").select("path", F.col("carried_id").alias("finding_id")).join(findings, "finding_id").withColumn("run_id", run_id)


def retained(items: DataFrame, by: str, keep: int = 6) -> DataFrame:
    """items with `kept`: whether their number is among the newest ones."""
    newest = items.select(by).distinct().orderBy(F.desc(by)).limit(keep).withColumn("kept", F.lit(True))
    return items.join(F.broadcast(newest), by, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))  # `keep` rows


def on_change(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Rows whose payload differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = F.lag(F.lit(1)).over(w).isNull()
    for c in payload:
        moved = moved | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return rows.withColumn("moved_", moved).filter("moved_").drop("moved_")


def known_products(inputs: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs whose product has a version, and the rest."""
    have = versions.select("product_id").distinct()
    return inputs.join(have, "product_id", "left_semi"), inputs.join(have, "product_id", "left_anti")


def by_product(images: DataFrame, path: str = "path") -> DataFrame:
    """Images of a product side by side, so that its versions are decoded once and stay near."""
    return images.repartition("product_id").sortWithinPartitions("product_id", path)


def first_failures(findings: DataFrame, order: list[str], reason: str = "reason", most: int = 50) -> DataFrame:
    """The failures that a run's report lists."""
    return findings.filter(F.col(reason).isNotNull()).orderBy(*order).limit(most)
