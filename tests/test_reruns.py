import pytest
from pyspark.sql import functions as F

from proofsheet.operators import reruns
from proofsheet.sources.versioned import Log, Store
from proofsheet.tables import shared_dir


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, sha string")


def judged(todo):
    return todo.select("path", F.when(F.col("sha") == "bad", "ERROR").otherwise("PASS").alias("verdict"))


def state(store):
    return {r.path: (r.sha, r.verdict, r.made_in) for r in store.read("findings").collect()}


@pytest.fixture
def store(spark):
    return Store(spark, shared_dir(spark, "runs"), parts=8)


def test_only_changed_parts_are_touched(spark, store):
    rows = [(f"f{i}", f"s{i}") for i in range(60)]
    assert reruns.rerun(store, frame(spark, rows), ["sha"], judged) == (1, {"carried": 0, "compared": 8, "processed": 60})
    first = store.head()[1]["tables"]["findings"]["folders"]
    # nothing changed: nothing is read, nothing is processed
    assert reruns.rerun(store, frame(spark, rows), ["sha"], judged)[1] == {"carried": 8, "compared": 0, "processed": 0}
    assert store.head()[1]["tables"]["findings"]["folders"] == first and len(state(store)) == 60
    rows[7] = ("f7", "changed")
    assert reruns.rerun(store, frame(spark, rows), ["sha"], judged)[1] == {"carried": 7, "compared": 1, "processed": 1}
    found = state(store)
    assert found["f7"] == ("changed", "PASS", 3) and sum(v[2] == 3 for v in found.values()) == 1 and len(found) == 60
    # a path that is gone goes, a new one comes
    _, counts = reruns.rerun(store, frame(spark, rows[1:] + [("new", "n")]), ["sha"], judged)
    assert counts["processed"] == 1 and set(state(store)) == {r[0] for r in rows[1:]} | {"new"}


def test_errors_are_tried_again(spark, store):
    rows = frame(spark, [("a", "bad"), ("b", "x"), ("c", None)])
    reruns.rerun(store, rows, ["sha"], judged)
    _, counts = reruns.rerun(store, rows, ["sha"], judged)
    assert counts["processed"] == 1 and state(store) == {"a": ("bad", "ERROR", 2), "b": ("x", "PASS", 1), "c": (None, "PASS", 1)}


def test_a_killed_run_leaves_the_one_before(spark, store, monkeypatch):
    reruns.rerun(store, frame(spark, [("a", "1")]), ["sha"], judged)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Log, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            reruns.rerun(store, frame(spark, [("a", "2")]), ["sha"], judged)
    assert state(store) == {"a": ("1", "PASS", 1)}
    assert reruns.rerun(store, frame(spark, [("a", "2")]), ["sha"], judged)[0] == 2


def test_unchanged_parts_are_not_scanned(spark, store):
    rows = frame(spark, [(f"f{i}", "s") for i in range(30)])
    reruns.rerun(store, rows, ["sha"], judged)
    part = store.head()[1]["tables"]["findings"]["folders"]["3"]
    files = store.read("findings", parts={3}).inputFiles()
    assert files and all(part.rpartition("/data/")[2] in f for f in files)
