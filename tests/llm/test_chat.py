from collections import Counter

import pytest

from proofsheet.llm import chat


def brute(rows):
    conv = {}
    for r in rows:
        conv.setdefault(r[0], []).append(r[1:])
    none = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, (v or "").encode())
    line = {c: tuple((r[1], r[2]) for r in sorted(t, key=lambda r: (none(r[0]), text(r[1]), text(r[2])))) for c, t in conv.items()}
    out = {}
    for c, t in line.items():
        same = [d for d, u in line.items() if u == t]
        snapshot = any(len(u) > len(t) and u[: len(t)] == t for u in line.values())
        least = min(same, key=lambda d: (d is None, d or 0))
        kept = not snapshot and c == least
        text_ = "".join(f"<|{r or ''}|>\n{x or ''}\n" for r, x in t)
        out[c] = (len(t), len(same), snapshot, kept, text_ if kept else None)
    return out


def rows():
    out = []
    long_ = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "end")]
    for c, n in ((1, 2), (2, 4), (3, 4), (4, 3), (5, 1)):
        out += [(c, t, *long_[t]) for t in range(n)]
    out += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, None, None, None), (7, 1, "user", None), (None, 0, "user", "hi"), (None, 1, "x", "y")]
    out += [(8, 3, "user", "hi"), (8, 3, "user", "hi"), (9, 0, "user", "hi"), (9, 5, "user", "hi"), (10, -2, "", ""), (11, 0, "user", "z" * 50_000)]
    out += [(c, t, ("user", "assistant")[t % 2], f"turn {t}") for c, n in ((20, 300), (21, 299), (22, 70)) for t in range(n)]
    return out


def test_collapse(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").repartition(3)
    from pyspark.sql import functions as F

    wide = df.withColumns({c: F.lit("x") for c in ("b", "place", "h1", "n_turns", "c", "d", "kept")})
    got = {r.conv_id: (r.n_turns, r.copies, r.snapshot, r.kept, r.rendered) for r in chat.format_conversations(wide).collect()}
    assert got == brute(rows())
    assert chat.format_conversations(wide.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_collapse_random(spark, seed):
    import random

    r = random.Random(seed)
    data = [(c, t, r.choice(["user", "assistant"]), r.choice("ab")) for c in range(150) for t in range(r.randint(1, 5))]
    got = {x.conv_id: (x.n_turns, x.copies, x.snapshot, x.kept, x.rendered) for x in chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert got == brute(data)
    assert Counter(v[3] for v in got.values())[True] > 0


def test_a_conversation_without_turn_numbers_is_spread(spark):
    from pyspark.sql import functions as F

    hot = [(None, None, "user", f"t{i % 97}") for i in range(3000)] + [(1, i, "user", "a") for i in range(50)] + [(2, i, "user", "a") for i in range(20)]
    df = spark.createDataFrame(hot, "conv_id long, turn long, role string, text string").repartition(5)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = {r.conv_id: (r.n_turns, r.copies, r.snapshot, r.kept, r.rendered) for r in chat.format_conversations(df).collect()}
        ranges = df.repartitionByRange("conv_id", "turn", "role", "text").withColumn("b", F.spark_partition_id()).filter("conv_id is null")
        assert ranges.select("b").distinct().count() > 1
    finally:
        spark.conf.set(key, before)
    assert got == brute(hot)
