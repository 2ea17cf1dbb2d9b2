"""The registry of approved artwork as a store: deliveries are merged in, and each build is one state.

A version keeps its id for good, since findings of earlier runs refer to it: a label that a
product's delivery no longer has is retired, not erased. Regions are derived from versions and
made anew for the delivered products. Both tables change in one step. Only parts in which
something changed are written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.sources.versioned import Conflict, Log, Store
from proofsheet.tables import stored

KEY = ["product_id", "version_label"]
#: Tables that are a run's history.
HISTORY = ["findings", "images", "runs", "acknowledgements"]


def merged(old: DataFrame | None, delivery: DataFrame, build: int) -> DataFrame:
    """Versions after a delivery: its columns, version_id, retired, change (the last one) and changed_in (its build); `moved` tells this build's changes.

    delivery: product_id, version_label, is_current and any further columns. Of rows with the same label the greatest counts.
    """
    payload = [c for c in delivery.columns if c not in KEY]
    new = delivery.groupBy(*KEY).agg(F.max(F.struct(*payload)).alias("new"))
    ident = F.xxhash64(*KEY).alias("version_id")
    if old is None:
        return new.select(*KEY, "new.*", ident, F.lit(False).alias("retired"), F.lit("inserted").alias("change"), F.lit(build).cast("long").alias("changed_in"), F.lit(True).alias("moved"))
    before = old.select(*KEY, F.struct(*payload).alias("old"), "retired", "change", "changed_in")
    delivered = delivery.select("product_id", F.lit(True).alias("delivered")).distinct()
    both = before.join(new, KEY, "full_outer").join(delivered, "product_id", "left")
    gone = F.col("new").isNull() & F.coalesce("delivered", F.lit(False))
    change = (
        F.when(F.col("old").isNull(), "inserted")
        .when(gone & ~F.col("retired"), "retired")
        .when(F.col("new").isNotNull() & (~F.col("new").eqNullSafe(F.col("old")) | F.col("retired")), "changed")
    )
    both = both.withColumns({"now": change, "gone": gone})
    values = [F.when(F.col("gone"), F.lit(False)).otherwise(F.coalesce("new.is_current", "old.is_current")).alias("is_current") if c == "is_current" else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in payload]
    moved = F.col("now").isNotNull()
    return both.select(
        *KEY, *values, ident, (F.col("gone") | (F.col("new").isNull() & F.coalesce("retired", F.lit(False)))).alias("retired"),
        F.coalesce("now", "change").alias("change"), F.when(moved, F.lit(build)).otherwise(F.col("changed_in")).cast("long").alias("changed_in"), moved.alias("moved"),
    )


def build(store: Store, delivery: DataFrame, regions: DataFrame | None = None) -> int:
    """Merge a delivery into `versions` and, if given, replace the delivered products' `regions` (product_id, ...): the number of the new state."""
    number, document = store.head()
    part = store.part_of("product_id").alias("part")
    delivery = stored(delivery, "delivery")
    delivered = {r[0] for r in delivery.select(part).distinct().collect()}  # numbers of parts
    tables = {name: {"schema": t["schema"], "folders": dict(t["folders"])} for name, t in document["tables"].items()}

    def put(name: str, rows: DataFrame, emptied: set[int]) -> None:
        schema, folders = store.write(rows, "part")
        kept = {p: f for p, f in tables.get(name, {"folders": {}})["folders"].items() if int(p) not in emptied}
        tables[name] = {"schema": schema, "folders": kept | folders}

    rows = stored(merged(store.read("versions", number, delivered), delivery, number + 1).withColumn("part", part), "merged")
    touched = {r[0] for r in rows.filter("moved").select("part").distinct().collect()}
    if touched or "versions" not in tables:
        put("versions", rows.filter(F.col("part").isin(touched)).drop("moved"), touched)
    if regions is not None:
        old = store.read("regions", number, delivered)
        new = regions.join(delivery.select("product_id").distinct(), "product_id", "left_semi")
        if old is not None:
            new = old.join(delivery.select("product_id").distinct(), "product_id", "left_anti").unionByName(new)
        put("regions", new.withColumn("part", part), delivered)
    store.log.publish(number + 1, {"parts": document["parts"], "tables": tables})
    return number + 1


def reset(store: Store, tables: list[str] | None = None) -> int:
    """A state without a run's history, for a corpus that was made anew: the number of the new state."""
    number, document = store.head()
    gone = HISTORY if tables is None else tables
    store.log.publish(number + 1, document | {"tables": {n: t for n, t in document["tables"].items() if n not in gone}})
    return number + 1


def versions(store: Store, number: int | None = None) -> DataFrame:
    """The registry in a state, with `status`: what its build did to each version."""
    number = store.head()[0] if number is None else number
    rows = store.read("versions", number)
    return rows.withColumn("status", F.when(F.col("changed_in") == number, F.col("change")).otherwise("unchanged"))


# --- one run at a time


def start_run(log: Log, run_id: int) -> int:
    """Says in the log that a run is RUNNING: the entry's number. An error if one is running, also if two start at once."""
    n = max(log.numbers(), default=0)
    last = log.document(n) if n else {}
    if last.get("status") == "RUNNING":
        raise RuntimeError(f"run {last['run_id']} is still running")
    try:
        log.publish(n + 1, {"run_id": run_id, "status": "RUNNING"})
    except Conflict as e:
        raise RuntimeError("another run has just been started") from e
    return n + 1


def end_run(log: Log, number: int, status: str = "COMPLETE") -> None:
    """Ends the run that started with this entry; of several that try, one does."""
    log.publish(number + 1, {"run_id": log.document(number)["run_id"], "status": status})


def reap(log: Log) -> int | None:
    """After a restart: what is still RUNNING has FAILED; the run's id, None if there is none."""
    n = max(log.numbers(), default=0)
    last = log.document(n) if n else {}
    if last.get("status") != "RUNNING":
        return None
    end_run(log, n, "FAILED")
    return last["run_id"]
