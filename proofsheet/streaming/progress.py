"""Progress of runs as streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from proofsheet.sources.versioned import Conflict, Log
from proofsheet.tables import shared_dir


def counts(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """Running counts of a run by verdict; as a stream its rows are emitted when they change."""
    return findings.groupBy(key, "verdict").agg(F.count("*").alias("n"))


SEEN, OUT = "sha string, version long", "path string, sha string, version long, status string"


def changes(probes: DataFrame) -> DataFrame:
    """A stream of probes (path, sha, version) with NEW, CHANGED or CACHED by what was last seen of the path.

    The state is one row a path, kept by Spark's state store.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for f in frames:
            rows = []
            for r in f.itertuples():
                now = (r.sha, int(r.version))
                rows.append((key[0], *now, "NEW" if last is None else "CACHED" if last == now else "CHANGED"))
                last = now
            yield pd.DataFrame(rows, columns=["path", "sha", "version", "status"])
        state.update(last)

    return probes.groupBy("path").applyInPandasWithState(step, OUT, SEEN, "append", GroupStateTimeout.NoTimeout)


#: What goes out of a pair at once: how many stages went before, and columns of the stages.
GIVEN = "pair_id string, before int, ordinal array<int>, stage array<string>, status array<string>, late array<boolean>"
#: Spark's state store that keeps states on disk.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: What is kept of a block of pairs: columns of its pairs first, then those of all held stages and of all gaps, pair by pair.
TOLD = (
    "pair_id array<string>, next array<int>, place array<int>, due array<long>, n_held array<int>, n_gaps array<int>, "
    "ordinal array<int>, stage array<string>, status array<string>, gap array<int>"
)


@dataclass(slots=True)
class Told:
    """A pair: the ordinal that is next, how many were given out, when its wait ends (None: nothing waits), what is held, and the gaps before `next`."""

    next: int = 1
    place: int = 0
    due: int | None = None
    held: dict[int, tuple[str, str]] = field(default_factory=dict)
    gaps: set[int] = field(default_factory=set)


class InOrder:
    """Gives out the stages of each pair in order: a stage waits for those before it, `wait` milliseconds at most, without end if None.

    When the time is over, what is held goes out as it is, marked late, and the gaps are noted, so that a stage that comes
    after all goes out late, too. A stage that comes again is given out once. A key is a block of pairs, which share nothing but
    the call: it takes much longer than the rows of a pair.
    """

    def __init__(self, wait: int | None):
        self.wait = wait

    def step(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, late, out = self.read(state), {}, []
        for f in frames:
            for pair, o, stage, status in zip(*(f[c].tolist() for c in ("pair_id", "ordinal", "stage", "status")), strict=True):
                if (p := told.get(pair)) is None:
                    p = told[pair] = Told()
                if o >= p.next:
                    p.held.setdefault(o, (stage, status))
                elif o in p.gaps:
                    p.gaps.discard(o)
                    late.setdefault(pair, []).append((o, stage, status, True))
        now = None if self.wait is None else state.getCurrentProcessingTimeMs()
        for pair, p in told.items():
            rows = sorted(late.get(pair, ()))
            while p.next in p.held:
                rows.append((p.next, *p.held.pop(p.next), False))
                p.next += 1
            if not p.held:
                p.due = None
            elif p.due is None:
                p.due = None if now is None else now + self.wait
            elif p.due <= now:
                end = max(p.held) + 1
                p.gaps.update(o for o in range(p.next, end) if o not in p.held)
                rows += [(o, *p.held[o], True) for o in sorted(p.held)]
                p.next, p.due, p.held = end, None, {}
            if rows:
                out.append((pair, p.place, *map(list, zip(*rows, strict=True))))
                p.place += len(rows)
        self.keep(told, state)
        if dues := [p.due for p in told.values() if p.due is not None]:
            state.setTimeoutDuration(max(min(dues) - now, 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in GIVEN.split(", ")])

    def read(self, state: GroupState) -> dict[str | None, Told]:
        if not state.exists:
            return {}
        *pairs, n_held, n_gaps, ordinals, stages, statuses, gaps = state.get
        held, gap = zip(ordinals, zip(stages, statuses, strict=True), strict=True), iter(gaps)
        return {pair: Told(next_, place, due, dict(islice(held, h)), set(islice(gap, g))) for pair, next_, place, due, h, g in zip(*pairs, n_held, n_gaps, strict=True)}

    def keep(self, told: dict[str | None, Told], state: GroupState) -> None:
        pairs, held = told.values(), [(o, *v) for p in told.values() for o, v in p.held.items()]
        state.update((
            list(told), [p.next for p in pairs], [p.place for p in pairs], [p.due for p in pairs], [len(p.held) for p in pairs], [len(p.gaps) for p in pairs],
            *([h[i] for h in held] for i in range(3)), [o for p in pairs for o in p.gaps],
        ))


def stages(rows: DataFrame, of: int = 7, wait: int | None = 30_000, blocks: int = 1024) -> DataFrame:
    """A stream of stage rows (pair_id, ordinal from 1, stage, status), in any order: each once, in order, with the share that is done.

    place counts what was given out of a pair; see InOrder for stages whose predecessors don't come. The wait is one of the clock: a bounded
    stream that is read from files takes None, or what is late depends on how long a batch takes. Pairs are kept in `blocks` by their
    hash, and a batch reads and writes the blocks it touches, so take as many as make one a few thousand stages; the number stays with
    the checkpoint.
    """
    rows.sparkSession.conf.set(*STORE)
    block = F.pmod(F.xxhash64("pair_id"), F.lit(blocks)).alias("block")
    clock = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    given = rows.select(block, "pair_id", "ordinal", "stage", "status").groupBy("block").applyInPandasWithState(InOrder(wait).step, GIVEN, TOLD, "append", clock)
    each = given.select("pair_id", "before", F.posexplode(F.arrays_zip("ordinal", "stage", "status", "late"))).select("pair_id", (F.col("before") + F.col("pos") + 1).alias("place"), "col.*")
    return each.select("pair_id", "place", "ordinal", "stage", "status", (F.col("ordinal") / of).alias("share"), (F.col("ordinal") >= of).alias("finished"), "late")


def watched(shown: DataFrame, listener: Callable[[Row], None], checkpoint: str, on_start: Callable[[], None] | None = None, every: str = "500 milliseconds"):
    """Calls listener for each row of a stream of stages, in the order of places, and on_start before the first; what they raise is dropped.

    Rows come to the driver one partition at a time.
    """

    def tell(f: Callable, *args: object) -> None:
        with suppress(Exception):
            f(*args)

    def put(batch: DataFrame, number: int) -> None:
        if number == 0 and on_start is not None:
            tell(on_start)
        for row in batch.orderBy("pair_id", "place").toLocalIterator():
            tell(listener, row)

    return shown.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def put_once(log: Log, batch: DataFrame, number: int, most_rows: int = 25) -> bool:
    """Commits a batch in files of most_rows rows; whether it did: a batch that is in the log already changes nothing.

    The rows are visible when the log names their folder, all at once; a batch that was killed on its way is written anew.
    """
    if log.has(number):
        return False
    folder = log.data_folder()
    batch.write.option("maxRecordsPerFile", most_rows).parquet(folder)
    try:
        log.publish(number, {"folder": folder, "schema": batch.schema.json()})
    except Conflict:  # the same batch by another attempt
        return False
    return True


def committed(stream: DataFrame, path: str, checkpoint: str, every: str = "500 milliseconds", most_rows: int = 25, listener: Callable[[DataFrame, int], None] | None = None):
    """Commits a stream's rows exactly once, each `every` at the latest; a listener sees each new batch, and what it raises is dropped."""
    log = Log(stream.sparkSession, path)

    def put(batch: DataFrame, number: int) -> None:
        if put_once(log, batch, number, most_rows) and listener is not None:
            with suppress(Exception):
                listener(batch, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def committed_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that are committed, None before the first commit."""
    log = Log(spark, path)
    if not log.numbers():
        return None
    entries = spark.read.schema("folder string, schema string").json(f"{path.rstrip('/')}/log").collect()  # one row a commit
    return spark.read.schema(StructType.fromJson(json.loads(entries[0].schema))).parquet(*[e.folder for e in entries])


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """All that a bounded stream gives; its timers don't go on without data.

    Rows that are appended go to a table in the shared folder; what a mode gives anew in each batch goes through a memory table. The state
    has `partitions` if fewer are enough than shuffles have: each costs a third of a second of CPU in every batch, whatever it holds.
    """
    spark, shuffles = stream.sparkSession, "spark.sql.shuffle.partitions"
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    if partitions is not None:
        settings[shuffles] = str(min(partitions, int(spark.conf.get(shuffles))))
    before = {k: spark.conf.get(k) for k in settings}
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    path = shared_dir(spark, name) if mode == "append" else None
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        q = writer.format("memory").start() if path is None else writer.format("parquet").start(path)
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.table(name) if path is None else spark.read.schema(stream.schema).parquet(path)
