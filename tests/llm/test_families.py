"""Families of near copies that are linked each to each."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from proofsheet.llm import neardup
from proofsheet.llm.components import components

from .test_text_ops import brute_components


def test_forest_takes_the_first_pairs_and_no_cycle():
    r = np.random.default_rng(5)
    x, y = r.integers(0, 60, 400), r.integers(0, 60, 400)
    root = np.arange(60)
    root[50:] = 7  # rows that are one component already
    at, new = neardup.forest(x, y, root)
    kruskal, want = root.copy(), []
    for i, (a, b) in enumerate(zip(x, y)):
        a, b = kruskal[a], kruskal[b]
        if a != b:
            kruskal[kruskal == b] = a
            want.append(i)
    assert sorted(at.tolist()) == want
    assert len({*zip(new.tolist(), kruskal.tolist())}) == len(set(kruskal.tolist())) == len(set(new.tolist()))
    assert not len(neardup.forest(x[:0], y[:0], root)[0])


def family(seed: int, n: int, edits: int, first: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(5000)]
    base, rows = [r.choice(vocab) for _ in range(120)], []
    for i in range(n):
        words = list(base)
        for _ in range(edits):
            words[r.randrange(120)] = r.choice(vocab)
        rows.append((first + i, " ".join(words)))
    return rows


def test_exact_join_of_a_family_makes_fewer_pairs_than_its_square(spark):
    """200 texts, all linked: 19,900 links, a few hundred pairs; before, the join gave each pair once for every shingle."""
    rows = family(1, 200, 1, 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes = neardup.stored(neardup.signatures(docs, 5), "classes")
    crowded, labels = classes.select("row"), spark.createDataFrame([], "id long, label long")
    made = neardup.stored(neardup.left_out(crowded, classes, labels, docs, 5, 75)(), "made")
    most = Counter()
    for m in made.collect():
        most[m.shingle, m.block] += 1
    assert max(most.values()) < 200 and made.select("a", "b").distinct().count() < 1000
    assert components(made).agg(F.count_distinct("label"), F.count("*")).first()[:] == (1, 200)


def test_links_beside_pairs_that_only_seem_near(spark, monkeypatch):
    """Forests with pairs that are no links: what they stood for is looked at whole."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BITMAP", 64)  # says little, so that most pairs seem near
    rows = family(2, 60, 4, 0) + family(3, 60, 3, 1000)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {k[0]: k[2] for k in brute_components(rows)}
    assert got == want and len(set(want.values())) > 10
