import random
import time

from proofsheet.llm import fingerprints as M


def patched(p, q, runs):
    out, at = [], 0
    for i, j, k, m in runs:
        out += p[at:i] + q[k:m]
        at = j
    return out + p[at:]


def test_runs_turn_one_side_into_the_other():
    r = random.Random(2)
    for kinds in (3, 30, 10_000):
        for _ in range(60):
            p = [str(r.randrange(kinds)) for _ in range(r.randrange(400))]
            q = list(p)
            for _ in range(r.randrange(6)):
                at = r.randrange(len(q) + 1)
                q[at : at + r.randrange(5)] = [str(r.randrange(kinds)) for _ in range(r.randrange(5))]
            runs = M.differing(p, q)
            assert patched(p, q, runs) == q and all(i < j or k < m for i, j, k, m in runs)


def test_single_edits_in_long_texts_are_located():
    lines = [f"line {i} of a long record" for i in range(20_000)]
    new = lines.copy()
    new[700] = "an edit"
    del new[15_000]
    new.insert(18_000, "an insertion")
    found = M.changed_branches(M.fingerprint("\n".join(lines)), M.fingerprint("\n".join(new)))
    assert found == [("changed", 0, 700), ("removed", 0, 15_000), ("inserted", 0, 18_000)]


def test_repeated_lines_take_time_in_proportion():
    r = random.Random(1)
    lines = [f"entry {i:03d}: " + "status ok " * 3 for i in range(150)]
    text = "\n".join(r.choice(lines) for _ in range(240_000))  # about 10 MB
    k = len(text) // 3
    new = text[: len(text) - k] + text[:k]
    a, b = M.fingerprint(text), M.fingerprint(new)
    start = time.process_time()
    assert M.changed_branches(a, b)
    assert time.process_time() - start < 5
