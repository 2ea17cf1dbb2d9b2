import re
from collections import Counter

import numpy as np

from proofsheet.llm import langid, mixing, pii
from proofsheet.llm.common import stored

from .test_text_ops import brute_components


def test_stages_step_by_step(spark, clashing, tokenizer):
    """Each stage on what the one before it kept, against brute force or the operator's own rules."""
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    docs = clashing
    kept = stored(P.identify_language(spark, docs, ""), "t")
    assert kept.columns == P.COLUMNS
    letters = Counter((r.doc_id, r.text) for r in docs.collect() if langid.has_letter(r.text))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert not got - letters and sum((letters - got).values()) <= 1  # one text has a script of its own

    single = stored(P.drop_near_duplicates(spark, kept, ""), "t")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {k[2] for k in brute_components(rows)}
    assert sorted(str(r.doc_id) for r in single.collect()) == sorted(map(str, groups))

    clean = stored(P.replace_pii(spark, single, ""), "t")
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r.doc_id, pii.replaced(r.text, b"proofsheet surrogates")[0]) for r in single.collect())

    mixed = stored(P.mix_sources(spark, clean, ""), "t")
    want = Counter({(r.doc_id, r.source): r.taken_copies for r in mixing.mix(clean).collect() if r.taken_copies})
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == want

    packed = P.pack_sequences(spark, mixed, "").toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    assert packed["length"].sum() == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_run(spark, sf):
    import corpus_pipeline as P

    out = P.run(spark, sf).toPandas()
    assert len(out) and np.isfinite(out["sequence_id"]).all()


def test_stages_on_hot_keys(spark):
    """A third of all rows from one source, a third copies of one text, a third with a null id."""
    import corpus_pipeline as P

    from .conftest import prose

    rows = [(i if i % 3 else None, prose(7, 60) if i % 3 == 1 else prose(i, 40 + i % 50), ("en", "de")[i % 2], "hot" if i % 3 == 2 else f"s{i % 7}", 1) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    single = stored(P.drop_near_duplicates(spark, docs, ""), "t")
    groups = Counter(k[2] for k in brute_components([(r[0], r[1]) for r in rows]))
    assert single.count() == len({r[1] for r in rows}) and sum(r.text == prose(7, 60) for r in single.collect()) == 1 and len(groups)
    mixed = stored(P.mix_sources(spark, P.replace_pii(spark, single, ""), ""), "t")
    assert mixed.count() and P.pack_sequences(spark, mixed, "").count() >= mixed.count()


def test_run_leaves_only_results(spark, sf):
    import os

    import corpus_pipeline as P

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    P.run(spark, sf)
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(base)) - before} == {n for n, _ in P.STAGES}


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))


def test_stages_on_an_empty_table(spark, empty):
    import corpus_pipeline as P

    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0
