"""Scores of pairs of images."""

from proofsheet.operators import evaluate as E

SCHEMA = """case_id long, class string, verdict string, errored boolean, boxes array<struct<x:int,y:int,w:int,h:int>>, edit_box struct<x:int,y:int,w:int,h:int>,
    old_value string, new_value string, readings array<struct<ref_text:string,mkt_text:string>>"""


def test_edits_are_read_without_a_row_leaving_its_task(spark):
    """Before, the readings were a table of their own that was joined to all cases."""
    box = (0, 0, 10, 10)
    cases = {  # old, new, readings, read
        1: ("20 mg", "50mg", [("Sodium 20mg", "Sodium 50 mg")], True),
        2: ("20 mg", "50mg", [("Sodium 20mg", "x"), ("y", "Sodium 50 mg")], False),  # both, but not in one region
        3: ("20 mg", "50mg", [("z", None), None, ("ＳＯＤＩＵＭ 20 MG", "50mg")], True),
        4: ("20 mg", "50mg", [], False),
        5: ("20 mg", "50mg", None, False),
        6: (None, None, [("a", "b")], True),  # no value has no token that could be missing
        7: ("20 mg", "50mg", [(None, None)], False),
    }
    rows = [(i, "number_edit", "DIFFERENT", False, [box], box, *x[:3]) for i, x in cases.items()]
    rows += [(8, "identical", "IDENTICAL", False, [box], None, "20 mg", "50mg", [("Sodium 20mg", "Sodium 50 mg")]), (1, "number_edit", "DIFFERENT", True, [], box, "1", "2", [("1", "3")])]
    scored = E.scored_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted((r.case_id, r.read) for r in scored.collect())
    assert got == sorted([*((i, x[3]) for i, x in cases.items()), (8, False), (1, False)])
    assert scored.columns == [*(c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")), "score", "localised", "read"]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    summary = {r["class"]: r for r in E.class_summary(scored).collect()}
    assert summary["number_edit"].cases == 8 and summary["number_edit"].read_rate == 3 / 8 and summary["identical"].read_rate is None
