import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from proofsheet.llm import simhash


def plain(text, k=4):
    """Fingerprint by its definition."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps):
    """Component of each place by flood fill over all pairs."""
    left, out = set(range(len(fps))), [0] * len(fps)
    while left:
        front, members = [left.pop()], []
        while front:
            x = front.pop()
            members.append(x)
            near = [y for y in left if (fps[x] ^ fps[y]).bit_count() <= 4]
            left.difference_update(near)
            front += near
        for m in members:
            out[m] = min(members)
    return out


def brute(rows):
    fps = [plain(t) for _, t in rows]
    comp = grouped(fps)
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        least.setdefault(c, []).append(d)
    least = {c: min((d for d in ids if d is not None), default=None) for c, ids in least.items()}
    return Counter((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp, strict=True))


def got(df):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_fingerprints(df).collect())


def test_documents(spark, edge, clashing, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(edge) == brute(rows)
    assert got(clashing) == brute(rows)
    assert simhash.near_fingerprints(empty).count() == 0


def test_near_copies_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = max((t for _, t in rows if t), key=len).split()
    r = random.Random(1)
    for i in range(120):
        words = base[: 150 + i]
        words[r.randrange(150)] = "other"
        rows.append((10_000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)


def test_long_texts_go_by_pieces(monkeypatch):
    text = " ".join(f"W{i % 91}\n\t" for i in range(3000))
    expected = plain(text)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 100)
    assert simhash.fingerprint(text.encode()) == expected
    assert simhash.fingerprint(b"a" * 500 + b" b c d e f") == plain("a" * 500 + " b c d e f")


def families(seed, n):
    """Fingerprints around a few centres, dense and sparse, and others."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    for centre, far in zip([r.getrandbits(64) for _ in range(4)], (2, 4, 6, 9), strict=True):
        for _ in range(n):
            x = centre
            for b in r.sample(range(64), r.randint(1, far)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("level", "large", "small"), [(1, 4096, 64), (2, 4096, 4), (4, 4096, 64), (1, 16, 4), (2, 40, 64)])
def test_no_link_is_lost_at_any_level(spark, monkeypatch, level, large, small):
    fps = families(level + large, 120)
    monkeypatch.setattr(simhash, "level_for", lambda n: level)
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "SMALL", small)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = simhash.edges(df, len(fps)).collect()
    at = {int(np.uint64(x).astype(np.int64)): i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = up(at[a]), up(at[b])
        root[max(x, y)] = min(x, y)
    assert [up(i) for i in range(len(fps))] == grouped(fps)


def test_levels_grow_with_the_fingerprints():
    assert [simhash.level_for(n) for n in (0, 4096, 4097, 2**20, 2**29, 2**40)] == [1, 1, 2, 2, 4, 4]
