"""Runs over a store of findings that touch only what has changed.

Findings lie in parts by a hash of their path. A run digests its inputs by part, one aggregate
without a join, and compares with the digests that the run before put into its document: a
part with the same inputs is carried by reference, its findings are neither read nor moved.
Only the other parts are read and compared path by path, and only new and changed inputs are
processed. A part with an error in it is never carried as a whole, since errors are tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.sources.versioned import Store
from proofsheet.tables import stored

from .incremental import partition_cached


def digests(inputs: DataFrame, key: list[str]) -> dict[str, list[int]]:
    """Rows, and two sums over (path, key) that don't depend on their order, of each part."""
    marks = [F.xxhash64(F.lit(s), "path", *key) for s in (1, 2)]
    rows = inputs.groupBy("part").agg(F.count("*").alias("n"), *[F.bit_xor(m).alias(f"x{i}") for i, m in enumerate(marks)]).collect()
    return {str(r.part): [r.n, r.x0, r.x1] for r in rows}


def rerun(store: Store, inputs: DataFrame, key: list[str], process: Callable[[DataFrame], DataFrame]) -> tuple[int, dict[str, int]]:
    """One run: its number, and how many parts were carried and compared, and how many inputs were processed.

    inputs: path (each once) and the key's columns. process takes inputs that need it and returns path, verdict and any further
    columns; findings are kept with the key and `made_in`, the run that made them.
    """
    number, document = store.head()
    inputs = stored(inputs.select("path", *key, store.part_of("path").alias("part")), "inputs")
    now, table = digests(inputs, key), document["tables"].get("findings")
    before, failed = document.get("digests", {}), set(document.get("failed", []))
    same = {p for p, d in now.items() if before.get(p) == d and p not in failed} if table else set()
    rest = sorted({int(p) for p in now} - {int(p) for p in same})
    open_ = inputs.filter(F.col("part").isin(rest))
    old = store.read("findings", number, set(rest)) if table else None
    if old is None:
        todo, kept = open_, None
    else:
        split = stored(partition_cached(open_, old.withColumn("finding_id", F.col("path")), key), "split")
        todo = split.filter("not cached").select(*inputs.columns)
        kept = split.filter("cached").select("path", "part").join(old, "path")
    done = process(todo.drop("part")).join(todo, "path").withColumn("made_in", F.lit(number + 1).cast("long"))
    done = stored(done, "done")
    n = done.count()
    rows = done if kept is None else done.unionByName(kept)
    schema, folders = store.write(rows, "part")
    errors = [str(r.part) for r in done.filter("verdict = 'ERROR'").select("part").distinct().collect()]  # of parts
    carried = {p: table["folders"][p] for p in same if p in table["folders"]} if table else {}
    tables = document["tables"] | {"findings": {"schema": schema, "folders": carried | folders}}
    store.log.publish(number + 1, {"parts": document["parts"], "tables": tables, "digests": now, "failed": errors})
    return number + 1, {"carried": len(same), "compared": len(rest), "processed": n}
