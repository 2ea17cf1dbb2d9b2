import pytest
from pyspark.sql import functions as F

from proofsheet.operators import registry
from proofsheet.sources.versioned import Conflict, Log, Store
from proofsheet.tables import shared_dir

SCHEMA = "product_id string, version_label string, sha string, is_current boolean"
FIRST = [("p", "1", "a", False), ("p", "2", "b", True), ("q", "1", "c", True), ("r", "1", "d", True), (None, None, None, True)]
SECOND = [("p", "2", "b", False), ("p", "3", "e", True), ("q", "1", "C", True), ("q", "1", "B", False)]


def state(store, number=None):
    return {(r.product_id, r.version_label): (r.sha, r.is_current, r.retired, r.status) for r in registry.versions(store, number).collect()}


@pytest.fixture
def store(spark):
    return Store(spark, shared_dir(spark, "registry"), parts=4)


def test_two_deliveries(spark, store):
    rows = lambda x: spark.createDataFrame(x, SCHEMA)
    region = lambda x: spark.createDataFrame(x, "product_id string, x int")
    assert registry.build(store, rows(FIRST), region([("p", 1), ("r", 2), ("other", 3)])) == 1
    assert registry.build(store, rows(SECOND), region([("p", 4), ("p", 5)])) == 2
    assert state(store) == {
        ("p", "1"): ("a", False, True, "retired"), ("p", "2"): ("b", False, False, "changed"), ("p", "3"): ("e", True, False, "inserted"),
        ("q", "1"): ("C", True, False, "changed"), ("r", "1"): ("d", True, False, "unchanged"), (None, None): (None, True, False, "unchanged"),
    }
    assert sorted(map(tuple, store.read("regions").collect())) == [("p", 4), ("p", 5), ("r", 2)]
    # the state before is still there
    assert {v[3] for v in state(store, 1).values()} == {"inserted"} and len(state(store, 1)) == 5
    ids = lambda n: {(r.product_id, r.version_label): r.version_id for r in registry.versions(store, n).collect()}
    assert ids(1).items() <= ids(2).items()
    # a label that comes again is no longer retired; one that stays away is not retired twice
    registry.build(store, rows([("p", "1", "a", True)]))
    again = state(store)
    assert again["p", "1"] == ("a", True, False, "changed") and again["p", "2"][2:] == (True, "retired") and again["q", "1"][3] == "unchanged"
    registry.build(store, rows([("p", "1", "a", True)]))
    assert {v[3] for v in state(store).values()} == {"unchanged"}


def test_unchanged_parts_are_carried_by_reference(spark, store):
    rows = spark.createDataFrame([(f"p{i}", "1", "a", True) for i in range(40)], SCHEMA)
    registry.build(store, rows)
    before = store.head()[1]["tables"]["versions"]["folders"]
    registry.build(store, rows.filter("product_id = 'p7'").withColumn("sha", F.lit("b")))
    after = store.head()[1]["tables"]["versions"]["folders"]
    assert sum(before[p] != after[p] for p in before) == 1 and len(state(store)) == 40
    registry.build(store, rows.filter("product_id = 'p8'"))
    assert store.head()[1]["tables"]["versions"]["folders"] == after


def test_a_killed_build_leaves_the_state_before(spark, store, monkeypatch):
    rows = spark.createDataFrame(FIRST, SCHEMA)
    registry.build(store, rows)
    before = state(store)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Log, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            registry.build(store, spark.createDataFrame(SECOND, SCHEMA))
    assert state(store) == before and store.head()[0] == 1
    assert registry.build(store, spark.createDataFrame(SECOND, SCHEMA)) == 2


def test_of_two_writers_one_is_told(spark, store):
    store.log.publish(1, {"parts": 4, "tables": {}})
    with pytest.raises(Conflict):
        store.log.publish(1, {"parts": 8, "tables": {}})
    assert store.head() == (1, {"parts": 4, "tables": {}}) and store.log.numbers() == [1]


def test_reset_drops_history_only(spark, store):
    registry.build(store, spark.createDataFrame(FIRST, SCHEMA))
    number, document = store.head()
    schema, folders = store.write(spark.range(3).withColumn("part", F.lit(0)), "part")
    store.log.publish(number + 1, document | {"tables": document["tables"] | {"findings": {"schema": schema, "folders": folders}}})
    assert store.read("findings").count() == 3
    registry.reset(store)
    assert store.read("findings") is None and len(state(store)) == 5


def test_empty_delivery(spark, store):
    registry.build(store, spark.createDataFrame([], SCHEMA))
    assert state(store) == {}


def test_one_run_at_a_time(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/runs")
    first = registry.start_run(log, 7)
    with pytest.raises(RuntimeError, match="run 7"):
        registry.start_run(log, 8)
    registry.end_run(log, first)
    with pytest.raises(Conflict):
        registry.end_run(log, first, "FAILED")
    second = registry.start_run(log, 8)
    assert registry.reap(log) == 8 and registry.reap(log) is None
    assert log.document(second + 1) == {"run_id": 8, "status": "FAILED"}


def test_of_two_runs_that_start_at_once_one_is_told(spark, tmp_path, monkeypatch):
    log = Log(spark, f"{tmp_path}/runs")
    registry.start_run(log, 1)
    with monkeypatch.context() as m:
        m.setattr(Log, "numbers", lambda self: [])  # what the other one saw
        with pytest.raises(RuntimeError, match="just been started"):
            registry.start_run(log, 2)


def test_old_states_are_deleted(spark, store):
    for k in range(5):
        registry.build(store, spark.createDataFrame([("p", "1", f"s{k}", True), ("q", "1", "same", True)], SCHEMA))
    before = state(store)
    assert store.expire(keep=2) == {"states": 3, "folders": 0}  # the folders are new
    assert store.expire(keep=2, older_than=0)["folders"] == 3
    assert store.log.numbers() == [4, 5] and state(store) == before and state(store, 4)["p", "1"][0] == "s3"
    assert registry.build(store, spark.createDataFrame([("p", "1", "s9", True)], SCHEMA)) == 6
