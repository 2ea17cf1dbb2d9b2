"""What was computed of each content, kept between runs.

A store's table holds rows by the hash of their content (`sha`). A run reads those it wants, computes the
others and adds them; nothing that is kept is computed or written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.sources.versioned import Store
from proofsheet.tables import stored

from .images import measured


def kept(store: Store | None, table: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of all wanted contents (`sha` and what compute needs): those that the store's table has, and new ones, which it gets.

    compute takes the wanted rows that are missing and returns rows with `sha`. Without a store all are computed. Of two runs
    that add at the same time one gets a Conflict and may be started again.
    """
    if store is None:
        return measured(compute(wanted), table)
    wanted = wanted.withColumn("part", store.part_of("sha"))
    parts = {r[0] for r in wanted.select("part").distinct().collect()}  # numbers of parts
    number, document = store.head()
    old = store.read(table, number, parts)
    if old is not None:
        old = stored(old.join(wanted.select("sha").distinct(), "sha", "left_semi"), table)
        wanted = wanted.join(old.select("sha"), "sha", "left_anti")
    new = measured(compute(wanted.drop("part")), table)
    if new.limit(1).count():
        schema, folders = store.write(new.withColumn("part", store.part_of("sha")), "part")
        before = document["tables"].get(table, {"folders": {}})["folders"]
        added = {f"{p}@{number + 1}": f for p, f in folders.items()}
        store.log.publish(number + 1, document | {"tables": document["tables"] | {table: {"schema": schema, "folders": before | added}}})
    return new if old is None else old.unionByName(new)
