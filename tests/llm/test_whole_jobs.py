"""Cases in which an operator once did less than the whole job."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from proofsheet.llm import pii, suffix_tree

from .conftest import edge_rows


def brute_tree(rows):
    """(id, score) of each row by dictionaries over the whole corpus."""
    S = suffix_tree
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    texts = [(d, S.hashes([t or ""])[0].tolist(), held(d)) for d, t in rows]
    end, c = int(S.END), Counter(w for _, t, h in texts if not h for w in t)
    words = set(c) | {w for _, t, _ in texts for w in t}
    sym = {w: w if c[w] >= S.MIN_COUNT or w == end else w & (S.CLASSES - 1) for w in words}
    size, kinds = Counter(), Counter()
    for w in words:
        size[sym[w]] += c[w]
        kinds[sym[w]] += c[w] > 0
    total, m = sum(c.values()), S.CLASSES + len({s for w, s in sym.items() if s == w})
    depth = S.DEPTH
    grams = [defaultdict(Counter) for _ in range(depth)]

    def steps(t):
        """Of each token the contexts of 1 to depth symbols before it, and its symbol."""
        y = [end] * depth + [sym[w] for w in t]
        return [([tuple(y[i - k : i]) for k in range(1, depth + 1)], y[i]) for i in range(depth, len(y))]

    for _, t, h in texts:
        for contexts, y in [] if h else steps(t):
            for level, s in enumerate(contexts):
                grams[level][s][y] += 1
    kept = [{} for _ in range(depth)]
    for level in range(depth):
        for s, ys in grams[level].items():
            up = grams[level - 1][s[1:]] if level else size
            n, nt = sum(ys.values()), sum(up.values())
            if n >= S.MIN_COUNT and sum(k * math.log((k - 1 + S.SMOOTH * up[y] / nt) / (n - 1 + S.SMOOTH) / (up[y] / nt)) for y, k in ys.items()) >= S.DIVERGENCE:
                kept[level][s] = n, {y: k for y, k in ys.items() if k >= 2}

    def probability(contexts, y):
        p = (size[y] + 1) / (total + m)
        for level, s in enumerate(contexts):
            if s in kept[level]:
                n, ys = kept[level][s]
                p = (ys.get(y, 0) + (n - sum(ys.values()) + S.SMOOTH) * p) / (n + S.SMOOTH)
        return p

    out = []
    for d, t, _ in texts:
        score = 0.0
        for w, (contexts, y) in zip(t, steps(t), strict=True):
            score += math.log10(probability(contexts, y)) + (math.log10((c[w] + 1) / (size[y] + kinds[y] + 1)) if y != w else 0)
        out.append((d, score))
    every = set(range(S.CLASSES)) | {s for w, s in sym.items() if s == w}
    for contexts, _ in steps(texts[-1][1]):  # a distribution after any context
        assert abs(sum(probability(contexts, y) for y in every) - 1) < 1e-9
    return out, kept


def test_suffix_tree_equals_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [row[:2] for row in edge_rows()]
    for i in range(600):  # the fourth word depends on all three before it
        a, b, c = r.integers(0, 2, 3).tolist()
        rows.append((100 + i, f"x{a} y{b} v{c} z{a ^ b ^ c} p{a} q{b} s{a ^ b} rare{i}"))
    want, kept = brute_tree(rows)
    assert all(kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, round(r.score, 4)) for r in suffix_tree.score_documents(docs).collect())
    assert got == Counter((d, round(s, 4)) for d, s in want)


def test_suffix_tree_keeps_contexts_on_larger_input(spark):
    """What some 40 occurrences say of the next word must not be lost when other text grows to millions of tokens."""
    r = np.random.default_rng(0)
    known = [(i, "zebra quagga okapi") for i in range(42)]
    filler = [(1000 + i, " ".join(f"w{x}" for x in r.integers(0, 5000, 6000).tolist())) for i in range(420)]
    docs = spark.createDataFrame(known + filler, "doc_id long, text string").repartition(4)
    scores = [r.score for r in suffix_tree.score_documents(docs).filter("doc_id < 42").collect()]
    assert len(scores) == 42 and min(scores) > -6  # 4.8 for the first word, which nothing foretells, and under 0.4 for each further one


def test_suffix_tree_moves_an_answer_once_and_a_share_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"x{i % 2} y{i % 3} z{i}") for i in range(60)], "doc_id long, text string").repartition(3)
    plan = suffix_tree.score_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan  # answers lie beside the texts they are for
    keys = np.random.default_rng(0).integers(0, 1 << 48, 5000)
    ask = lambda share: suffix_tree._sent(1, 1, 7, 12, keys, np.ones(5000, np.int64), share=share)
    shares = [ask(r) for r in range(suffix_tree.ROUNDS)]
    assert max(sum(len(b) for *_, b in rows) for rows in shares) < 0.6 * sum(len(b) for *_, b in ask(None))
    assert sorted(r for rows in shares for r in rows) == ask(None)


@pytest.mark.parametrize("n,top", [(0, 5), (1, 5), (3000, 50), (3000, 1 << 40), (3000, 1 << 62)])
def test_numbers_of_codes(n, top):
    """The packed sort and, where code and place take over 64 bits, the plain one."""
    codes = np.random.default_rng(n).integers(0, top, n)
    every, at, first = suffix_tree._numbered(codes)
    want, where = np.unique(codes, return_inverse=True)
    assert every.tolist() == want.tolist() and at.tolist() == where.tolist() and codes[first].tolist() == want.tolist()


def syllables(seed, of, n):
    """n words of a language with its own syllables, all in the same letters."""
    own, r = np.random.default_rng(of), np.random.default_rng(seed)
    parts = ["".join(own.choice(list("abdefghiklmnoprstuvw"), 3)) for _ in range(30)]
    return " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(n))


def test_texts_in_no_learned_language_go(spark):
    import corpus_pipeline as P

    clean = [(i, syllables(i, i % 3, (3, 40, 400)[i // 3 % 3]), ("aa", "bb", "cc")[i % 3]) for i in range(180)]
    r = np.random.default_rng(1)
    script = [(1000 + i, "".join(map(chr, r.integers(0x4E00, 0x9FFF, n))), None) for i, n in enumerate([1, 5, 80, 300, 2000, 20000])]
    script += [(2000 + i, "".join(chr(x) for x in r.integers(0x430, 0x450, n)), None) for i, n in enumerate([3, 50, 5000])]
    latin = [(3000 + i, syllables(i, 77, n), None) for i, n in enumerate([20, 60, 400, 4000])]
    rows = [(d, t, lang, "s", len(t)) for d, t, lang in clean + script + latin]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {row.doc_id for row in P.identify_language(spark, docs, "").collect()}
    assert not [d for d in kept if d >= 1000] and kept == set(range(180))


def test_surrogates_of_a_full_domain(spark):
    """Every two-letter surname of a pattern occurs, so that none is free."""
    names = [c + v for c in "bcdfghjklmnpqrstvwxyz" for v in "aeiou"]
    found = spark.createDataFrame([(i, "surname", n) for i, n in enumerate(names)], "h long, kind string, norm string")
    moved = {r.norm: r.attempt for r in pii.collisions(found, b"k").collect()}
    new = [pii.surrogate("surname", n, b"k", moved.get(n, 0)) for n in names]
    assert len(set(new)) == len(names) and not set(new) & set(names)
    text = pii.replaced("Mr. Li and Mr. LI", b"k", {("surname", "li"): pii.LONGER_FROM})[0]
    assert len(text) == len("Mr. Li and Mr. LI") + 2 and text[-3:].isupper() and text[4:7].istitle()


def test_a_full_domain_of_digits_gets_marks(spark):
    taken = pii.surrogate("ssn", "111111111", b"k")
    found = spark.createDataFrame([(1, "ssn", "111111111"), (2, "ssn", taken)], "h long, kind string, norm string")
    moved = {r.norm: r.attempt for r in pii.collisions(found, b"k", most_rounds=0).collect()}
    assert moved == {"111111111": pii.FULL}
    text, kinds = pii.applied("ssn 111-11-1111 and 111111111.", [(4, 15, "ssn", "111111111"), (20, 29, "ssn", "111111111")], b"k", {("ssn", "111111111"): pii.FULL})
    first, second = text[4:].split(" and ")
    assert first == second[:-1] and first.startswith("[ssn ") and "1111" not in text and kinds == ["ssn", "ssn"]


@pytest.mark.parametrize("kind,norm", [("surname", "éèü"), ("surname", "łß"), ("secret", "______"), ("secret", "//////"), ("email", "__@mail.example.com")])
def test_nothing_stays_in_clear(spark, kind, norm):
    found = spark.createDataFrame([(1, kind, norm)], "h long, kind string, norm string")
    moved = pii.collisions(found, b"k")
    attempt = moved.first().attempt if moved is not None else 0
    assert pii.surrogate(kind, norm, b"k", attempt).split("@")[0] != norm.split("@")[0]
