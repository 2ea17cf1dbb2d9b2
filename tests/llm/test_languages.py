import numpy as np
import pytest

from proofsheet.llm import langid


def words(seed):
    r = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ["".join(r.choice(list(letters), r.integers(3, 8))) for _ in range(25)]


def text(lang, n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(words(lang), n))


def test_more_languages_than_one_table_holds(spark):
    rows = [(100 * lang + i, text(lang, 40, 100 * lang + i), f"l{lang:03d}") for lang in range(80) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert {got[d].lang_pred for d, _, _ in rows} == {f"l{i:03d}" for i in range(80)}
    assert sum(got[d].lang_pred == lang for d, _, lang in held) >= 0.97 * len(held) > 100


@pytest.mark.parametrize("n", [3, 70])
def test_factors_score_like_their_product(monkeypatch, n):
    rows = [langid.packed(langid.presence(text(k % n, 30, k))) for k in range(6 * n)]
    langs = [f"l{k % n}" for k in range(6 * n)]
    probes = [text(k, 30, 1000 + k) for k in range(n)]
    one = langid.Model(rows, langs).scores(probes)
    monkeypatch.setattr(langid, "FOLD", 0 if n == 3 else 1000)
    assert np.allclose(one, langid.Model(rows, langs).scores(probes), atol=1e-4)
