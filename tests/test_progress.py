import random
import time

import pandas as pd
import pytest

from proofsheet.sources.versioned import Log
from proofsheet.streaming import progress

STAGES = "pair_id string, ordinal int, stage string, status string"


def as_stream(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_stages_come_out_in_order(spark, tmp_path):
    rows = [(p, o, f"s{o}", "OK") for p in "abc" for o in range(1, 8)]
    rows += rows[:5]  # some come twice
    random.Random(3).shuffle(rows)
    stream = as_stream(spark, f"{tmp_path}/in", [rows[:9], rows[9:15], rows[15:]], STAGES)
    got = progress.drained(progress.stages(stream), "in_order", "append", f"{tmp_path}/c").collect()
    assert sorted((r.pair_id, r.place, r.ordinal, r.stage, r.finished, r.late) for r in got) == [(p, o, o, f"s{o}", o == 7, False) for p in "abc" for o in range(1, 8)]


def test_a_bounded_stream_has_no_clock(spark, tmp_path):
    rows = [("a", o, f"s{o}", "OK") for o in (3, 2, 1)]
    for wait, late in ((1, {True}), (None, {False})):  # every batch takes longer than a millisecond
        stream = as_stream(spark, f"{tmp_path}/{wait}", [[r] for r in rows], STAGES)
        got = progress.drained(progress.stages(stream, 3, wait=wait), f"no_clock_{wait}", "append", f"{tmp_path}/c{wait}").collect()
        assert sorted(r.ordinal for r in got) == [1, 2, 3] and {r.late for r in got if r.ordinal > 1} == late


def test_appended_rows_are_a_table_of_files(spark, tmp_path):
    stream = as_stream(spark, f"{tmp_path}/in", [[("a", 2, "s2", "OK")], [("a", 1, "s1", "OK")]], STAGES)
    got = progress.drained(progress.stages(stream, 2, wait=None), "files", "append", f"{tmp_path}/c")
    assert got.count() == 2 and got.inputFiles()  # a memory table has none: its rows are the driver's


def test_pairs_are_kept_in_blocks(spark, tmp_path):
    rows = [(p, o, f"s{o}", "OK") for p in (*(f"p{i}" for i in range(50)), None) for o in range(1, 6)]
    random.Random(5).shuffle(rows)
    stream = as_stream(spark, f"{tmp_path}/in", [rows[:90], rows[60:180], rows[180:]], STAGES)
    got = progress.drained(progress.stages(stream, 5, wait=None, blocks=3), "blocks", "append", f"{tmp_path}/c")
    assert spark.read.format("statestore").load(f"{tmp_path}/c").count() == 3
    shown = {(r.pair_id, r.place, r.ordinal, r.stage, r.share, r.finished, r.late) for r in got.collect()}
    assert got.count() == len(rows) and shown == {(p, o, o, s, o / 5, o == 5, False) for p, o, s, _ in rows}


def test_a_small_state_has_few_partitions(spark, tmp_path):
    for asked, parts in ((1, 1), (99, 4)):
        stream = as_stream(spark, f"{tmp_path}/{asked}", [[("a", 2, "s2", "OK")], [("a", 1, "s1", "OK")]], STAGES)
        got = progress.drained(progress.stages(stream, 2, wait=None), f"parts_{asked}", "append", f"{tmp_path}/c{asked}", asked)
        assert got.count() == 2 and {r.numPartitions for r in spark.read.format("state-metadata").load(f"{tmp_path}/c{asked}").collect()} == {parts}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_a_bounded_stream_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(STAGES).parquet(f"{tmp_path}/in")
    got = progress.drained(progress.stages(stream), "no_rows", "append", f"{tmp_path}/c")
    assert got.count() == 0 and got.columns == ["pair_id", "place", "ordinal", "stage", "status", "share", "finished", "late"]


def test_each_pair_of_a_block_has_its_own_wait():
    class State:
        exists, now, get, timeout = False, 0, None, None

        def update(self, told):
            self.exists, self.get, self.timeout = True, told, None

        def getCurrentProcessingTimeMs(self):
            return self.now

        def setTimeoutDuration(self, wait):
            self.timeout = self.now + wait

    state, given = State(), []
    calls = [(0, "a2 c2"), (50, "b2 c1"), (60, "c4"), (100, ""), (110, "a2 a1"), (150, ""), (160, ""), (170, "c3")]
    for state.now, came in calls:
        frame = pd.DataFrame([(x[0], int(x[1]), f"s{x[1]}", "OK") for x in came.split()], columns=["pair_id", "ordinal", "stage", "status"])
        for out in progress.InOrder(100).step((0,), iter([frame]), state):
            given += [(state.now, r.pair_id, r.before + 1 + i, o, late) for r in out.itertuples() for i, (o, late) in enumerate(zip(r.ordinal, r.late))]
        assert state.timeout == {0: 100, 50: 100, 60: 100, 100: 150, 110: 150, 150: 160}.get(state.now)
    # what c held went out at 50, so 4 waits from 60 on, not from 0
    assert given == [(50, "c", 1, 1, False), (50, "c", 2, 2, False), (100, "a", 1, 2, True), (110, "a", 2, 1, True), (150, "b", 1, 2, True), (160, "c", 3, 4, True), (170, "c", 4, 3, True)]


def until(done, seconds=90):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.3)
    assert done()


def test_a_stage_whose_predecessor_stays_away(spark, tmp_path):
    stream = as_stream(spark, f"{tmp_path}/in", [[("a", 1, "s1", "OK"), ("a", 3, "s3", "OK"), ("b", 2, "s2", "OK")]], STAGES)
    seen, begun = [], []

    def listener(row):
        seen.append((row.pair_id, row.place, row.ordinal, row.late))
        raise ValueError("dropped")

    q = progress.watched(progress.stages(stream, 3, wait=200), listener, f"{tmp_path}/c", lambda: begun.append(1), "200 milliseconds")
    try:
        until(lambda: len(seen) == 3)
        spark.createDataFrame([("a", 2, "s2", "OK"), ("a", 3, "s3", "OK"), ("b", 3, "s3", "OK")], STAGES).coalesce(1).write.parquet(f"{tmp_path}/in/9")
        until(lambda: len(seen) == 5)
    finally:
        q.stop()
    assert sorted(seen) == [("a", 1, 1, False), ("a", 2, 3, True), ("a", 3, 2, True), ("b", 1, 2, True), ("b", 2, 3, False)] and begun == [1]


def test_a_batch_is_committed_once(spark, tmp_path, monkeypatch):
    log, rows = Log(spark, f"{tmp_path}/t"), spark.range(60)
    assert progress.committed_rows(spark, f"{tmp_path}/t") is None
    assert progress.put_once(log, rows.coalesce(1), 0) and not progress.put_once(log, rows, 0)
    assert len([n for n in log.names(log.document(0)["folder"]) if n.endswith(".parquet")]) == 3  # 25 rows a file

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Log, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            progress.put_once(log, spark.range(100, 110), 1)
    assert progress.committed_rows(spark, f"{tmp_path}/t").count() == 60
    assert progress.put_once(log, spark.range(100, 110), 1)
    assert sorted(r.id for r in progress.committed_rows(spark, f"{tmp_path}/t").collect()) == [*range(60), *range(100, 110)]


def test_a_replayed_stream_changes_nothing(spark, tmp_path):
    stream = as_stream(spark, f"{tmp_path}/in", [[(1, "PASS")], [(1, "ERROR"), (2, "PASS")]], "run_id long, verdict string")
    seen = []
    for checkpoint in ("c", "other"):  # without the first one's progress all batches come again
        q = progress.committed(stream, f"{tmp_path}/t", f"{tmp_path}/{checkpoint}", "100 milliseconds", listener=lambda batch, number: seen.append(number))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert seen == [0, 1] and progress.committed_rows(spark, f"{tmp_path}/t").count() == 3
