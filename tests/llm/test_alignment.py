import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from proofsheet.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a ", " ", "\n", "  a  b \n \n c", "a▁b", "<|endoftext|> x <s> </s> <0x41>", "日本語 テキスト 🙂 é ́x", "  x 　 y", "it's 're don't 123  45 \t\t x",
    "x \x1c z  w\r\n q", "'s 'll I'm", "élève naïve Ünder.", "a" * 5000, "word. " * 300, "\x00 \x7f",
]


def whole(texts):
    """Of each text: ids of both sides, shared cuts and groups, by the libraries over whole texts."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = dict(zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)], strict=True))
    chars |= {x: 256 + i for i, x in enumerate(sorted(set(range(256)) - set(chars)))}
    back = {chr(c): x for x, c in chars.items()}
    out = []
    for t in texts:
        x, y = a.encode(" " + (t or ""), add_special_tokens=False), b.encode(t or "")
        xb = [bytes(back[c] for c in p) for p in x.tokens]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or not (b"".join(xb) == b"".join(yb) == (" " + t).encode()):
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(z) for z in xb]).tolist(), np.cumsum([len(z) for z in yb]).tolist()
        groups, links, i, j = [], [], 0, 0
        for c in sorted({*ends_a} & {*ends_b}):
            p, q = ends_a.index(c) + 1, ends_b.index(c) + 1
            groups.append(",".join(map(str, x.ids[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x.ids[p - 1], y[q - 1]))
            i, j = p, q
        out.append((len(x.ids), len(y), ";".join(groups), links))
    return out


def brute(rows):
    found = [(d, f) for (d, *_), f in zip(rows, whole([r[1] for r in rows]), strict=True)]
    count = Counter(x for _, f in found if f for x in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            n = [count[x] for x in f[3]]
            out.append((d, f[0], f[1], len(f[3]), len(f[3]), sum(k == best[b] for k, (_, b) in zip(n, f[3], strict=True)), sum(n), hashlib.sha256(f[2].encode()).hexdigest()))
    return Counter(out)


def scored(df):
    return Counter(tuple(r[c.split()[0]] for c in alignment.SCORED.split(", ")) for r in alignment.score_links(df, A, B).collect())


def short(rows):
    return [r for r in rows if len(r[1] or "") < 20_000] + [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)]


def test_links_of_all_documents(spark, edge, clashing):
    rows = short(map(tuple, edge.collect()))
    df = spark.createDataFrame(rows, edge.schema).repartition(3)
    assert scored(df) == brute(rows)
    wide = clashing.filter("length(text) < 20000 or text is null")
    assert scored(wide) == brute([tuple(r)[:2] for r in wide.collect()])


def test_empty_table(empty):
    assert alignment.score_links(empty, A, B).count() == 0


def test_long_texts_go_by_pieces(spark, monkeypatch):
    text = " ".join(f"word{i % 50}  and\n x{i % 7}." for i in range(600))
    (expected,) = whole([text])
    tool = alignment.aligner(A, B)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 500)
    parts = [*alignment._parts(text)]
    assert len(parts) > 10 and " ".join(parts) == text
    assert ";".join(tool.pieces([p])[0][2].decode() for p in parts) == expected[2]


def test_groups_are_given_as_text(spark):
    got = alignment.alignments(spark.createDataFrame([(1, "élève two words")], "doc_id long, text string"), A, B, groups=True).first()
    assert got.groups == whole(["élève two words"])[0][2]


@pytest.mark.parametrize("seed", range(5))
def test_bitsets_map_cuts_to_tokens(seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(1, 6, 400), r.integers(1, 6, 400)
    n = min(a.sum(), b.sum())
    a, b = (np.diff(np.append(np.cumsum(x)[np.cumsum(x) < n], n), prepend=0) for x in (a, b))
    cuts, a_upto, b_upto = alignment.aligned(a, b)
    assert set(cuts) == {*np.cumsum(a)} & {*np.cumsum(b)}
    assert (np.cumsum(a)[a_upto - 1] == cuts).all() and (np.cumsum(b)[b_upto - 1] == cuts).all()


def test_every_link_has_a_number():
    pairs = alignment.aligner(A, B).pairs
    assert (np.diff(pairs.keys) > 0).all()
    sides = alignment.aligner(A, B).sides
    for k in pairs.keys[::1000].tolist():
        a, b = sides.a_bytes[k // pairs.width], sides.b_bytes[k % pairs.width]
        assert a.endswith(b) or b.endswith(a)
