import random

import pytest

WORDS = "the of and to in is it on for with that this paper water house tree green river stone light north".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n)) + ".\n"


def edge_rows():
    """(doc_id, text, lang, source, n_chars): nulls in every column, empty and very long texts, ties, repeated rows."""
    base = [prose(i, 40 + 7 * i) for i in range(12)]
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [
        (20, None, "en", "s0", None), (21, "", "en", "s0", 0), (22, "   \n\t ", None, "s1", 6), (23, "word", None, None, 4),
        (None, base[3], "en", "s1", len(base[3])), (None, None, None, None, None),
        (30, prose(99, 30_000), "en", "s0", 1), (31, base[5], "de", "s2", 2), (31, base[5], "de", "s2", 2), (31, base[6], "de", "s2", 2),
        (32, base[5].replace("paper", "papers", 1), "de", None, 3), (33, "1234 !!! ...", "en", "s1", 12), (34, "日本語 テキスト\n\nпривет ἀλήθεια 🙂 x", "ja", "s1", 5),
        (-5, base[7].upper(), "en", "s9", 1), (2**62, base[8] + " tail", "en", "s0", 1),
    ]
    return rows


def id_order(rows):
    """Rows by id, null first, and by Spark's hash of their text."""
    import numpy as np
    import xxhash

    tie = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    return sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], tie(r[1])))


CLASH = ["k", "h", "b", "row", "size", "sig", "label", "p_", "group_", "kind", "norm", "a", "part", "slot", "held_out", "surrogates", "fingerprint"]


@pytest.fixture(scope="session")
def edge(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(edge_rows(), schema).repartition(3)


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F

    return edge.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("false")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
