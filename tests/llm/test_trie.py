import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from proofsheet.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    lists = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, line in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = lists.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + line[h:]
    members = defaultdict(list)
    for c, line in rebuilt.items():
        for d in range(len(line) + 1):
            members[tuple(line[:d])].append(c)
    out = Counter()
    for path, m in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(path))))
        out[min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter(map(tuple, trie.prefix_trie(*trie.rebuilt(df)).collect()))


def random_rows(seed, n=60):
    r = random.Random(seed)
    ids = [r.randrange(-40, 200) for _ in range(n)]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "ünï", None])) for c in ids for t in range(r.choice([1, 2, 5, 9, 12]))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_trie(spark, seed):
    rows = random_rows(seed)
    rows += [(None, 0, "user", "x"), (7, None, "user", "first"), (7, 3, None, None), (7, 3, None, None), (11, 0, "user", "z" * 50_000), (2**60, 0, "", "")]
    wide = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("place", "b", "h1", "n", "owner", "depth", "first", "leaf")})
    assert got(wide) == brute(rows)
    assert got(wide.filter("false")) == Counter()


def test_blocks_and_packed_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "RUN_BYTES", 10)
    rows = random_rows(5) + [(500 + i, t, "user", f"same {t}") for i in range(60) for t in range(9)] + [(900, t, "user", str(t)) for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert got(df) == brute(rows)
    finally:
        spark.conf.set(key, before)
