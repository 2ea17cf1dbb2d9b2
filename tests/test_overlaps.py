import random

from proofsheet.operators import versions as A

BOX = "struct<x:long,y:long,w:long,h:long>"


def drawn(r, n):
    out = []
    for _ in range(n):
        size = 2 ** r.randrange(12)
        out.append((r.randrange(-50, 900), r.randrange(-50, 900), r.randrange(1, size + 1), r.randrange(1, size + 1)))
    return out + out[:3] + [(0, 0, 60_000, 50_000), (8, 8, 8, 8), (16, 8, 8, 8)]


def meet(a, b):
    return max(a[0], b[0]) < min(a[0] + a[2], b[0] + b[2]) and max(a[1], b[1]) < min(a[1] + a[3], b[1] + b[3])


def test_all_overlapping_pairs_once(spark):
    r = random.Random(4)
    left = [(r.randrange(2), i, x) for i, x in enumerate(drawn(r, 150))]
    right = [(r.randrange(2), i, x) for i, x in enumerate(drawn(r, 150))]
    a = spark.createDataFrame(left, f"k int, i int, p {BOX}").repartition(3)
    b = spark.createDataFrame(right, f"k int, j int, q {BOX}").repartition(3)
    got = sorted((x.i, x.j) for x in A.overlapping(a, b, ["k"], "p", "q").collect())
    assert got == sorted((i, j) for k, i, p in left for m, j, q in right if k == m and meet(p, q))
    assert A.overlapping(a.filter("false"), b, ["k"], "p", "q").count() == 0 == A.overlapping(a, b.filter("false"), ["k"], "p", "q").count()


def test_pairs_of_a_large_key_are_counted_alike_and_not_made(spark, monkeypatch):
    r = random.Random(6)
    left = [(r.randrange(3), x) for x in drawn(r, 150) if x[2] < 3000]
    right = [(r.randrange(3), x) for x in drawn(r, 150) if x[2] < 3000] + [(7, (0, 0, 1, 1))]
    left, right = left + [(1, (0, 0, 0, 9)), (3, (0, 0, 60_000, 50_000))], right + [(1, (-128, 127, 129, 1)), (3, (9, 9, 60_000, 50_000))]
    a, b = spark.createDataFrame(left, f"k int, p {BOX}"), spark.createDataFrame(right, f"k int, q {BOX}")
    cut = lambda p, q, i: max(0, min(p[i] + p[i + 2], q[i] + q[i + 2]) - max(p[i], q[i]))
    want = {}
    for k, p in left:
        for m, q in right:
            if k == m and meet(p, q):
                n, area = want.get(k, (0, 0))
                want[k] = (n + 1, area + cut(p, q, 0) * cut(p, q, 1))
    made = []
    pairs = A.overlapping
    monkeypatch.setattr(A, "overlapping", lambda a, b, *x: made.append((a.count(), b.count())) or pairs(a, b, *x))
    for most, counted in ((10**6, 10), (0, 10), (0, 1)):
        monkeypatch.setattr(A, "MANY_PAIRS", most)
        monkeypatch.setattr(A, "COUNTED", counted)
        assert {x.k: (x.pairs, x.area) for x in A.overlap_totals(a, b, ["k"], "p", "q").collect()} == want
    assert made[0][0] == len(left) and made[1] == (1, 2)  # key 3 has boxes of thousands of tiles, key 7 one side only


def test_edits_of_a_large_key_are_matched_alike(spark, monkeypatch):
    r = random.Random(5)
    regions = spark.createDataFrame([(r.randrange(3), i, x) for i, x in enumerate(drawn(r, 120))], f"k int, region_id long, box {BOX}")
    edits = spark.createDataFrame([(r.randrange(3), i, x) for i, x in enumerate(drawn(r, 80))], f"k int, edit_pos long, edit_box {BOX}")
    plain = sorted(map(tuple, A.match_edits(regions, edits, ["k"]).collect()))
    monkeypatch.setattr(A, "MANY_PAIRS", 1000)
    assert sorted(map(tuple, A.match_edits(regions, edits, ["k"]).collect())) == plain and len(plain) > 50


def test_paths_meet_their_hops_only(spark):
    hops = spark.createDataFrame([("p", i, i + 1, 10 * i + n) for i in range(1, 30) for n in range(3)] + [("p", 2, 5, 999)], "product_id string, from_pos long, to_pos long, region_id long")
    findings = spark.createDataFrame([(1, "p", 3, 5), (2, "p", 5, 5), (3, "p", 6, 2), (4, "q", 1, 9), (5, "p", 28, 40)], "finding_id long, product_id string, i long, j long")
    got = {}
    for x in A.path_regions(hops, findings).collect():
        got.setdefault(x.finding_id, []).append(x.region_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: [30, 31, 32, 40, 41, 42], 5: [280, 281, 282, 290, 291, 292]}
