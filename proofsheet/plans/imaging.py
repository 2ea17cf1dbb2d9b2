"""Queries over 8x8 images (embeddings): windows, masks, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.functions import boxes as B
from proofsheet.functions import verdict as V
from proofsheet.kernels import regions as K
from proofsheet.operators import identify as D
from proofsheet.operators import neighbours as N
from proofsheet.operators import pixels as P
from proofsheet.operators import tiles as L

from .registry import query

PX = "px AS (SELECT vec_id AS image, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i))"


@query(f"""WITH {PX} SELECT a.image, a.y, a.x, max(b.v) AS hi, min(b.v) AS lo FROM px a JOIN px b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL""")
def dilate_erode(t):
    """W4."""
    return P.erode(P.dilate(P.pixels(t.embeddings), "v", "hi"), "v", "lo").select("image", "y", "x", "hi", "lo")


@query(f"""WITH {PX} SELECT a.image, a.y, a.x, round(avg(b.v), 6) + 0.0::DOUBLE AS mean FROM px a JOIN px b ON a.image = b.image AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL""")
def box_mean(t):
    """Mean of the window's part inside the image."""
    return P.separable(P.pixels(t.embeddings), F.avg, "v", "mean", 2).select("image", "y", "x", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


@query(f"""WITH {PX}, b AS (SELECT a.image, a.y, a.x, max(b.v) AS hi, min(b.v) AS lo FROM px a JOIN px b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT p.image - 1 AS image, p.y, p.x, greatest(p.v - b.hi, b.lo - p.v, 0.0) AS d FROM px p JOIN b ON b.image = p.image - 1 AND b.y = p.y AND b.x = p.x""")
def tolerance_band(t):
    """Each image against the range of the one before."""
    px = P.pixels(t.embeddings)
    return P.band_difference(px.withColumn("image", F.col("image") - 1), px).select("image", "y", "x", "d")


@query(f"""WITH {PX}, m AS (SELECT image, y, x, CASE WHEN v > 0.02 THEN 1 ELSE 0 END AS m FROM px),
e AS (SELECT a.image, a.y, a.x, min(b.m) AS e FROM m a JOIN m b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
o AS (SELECT a.image, a.y, a.x, max(b.e) AS o FROM e a JOIN e b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT image, sum(o)::BIGINT AS set_pixels, sum(o) / 64.0::DOUBLE AS fraction FROM o GROUP BY 1""")
def open_mask(t):
    """Threshold, opening, changed fraction."""
    m = P.pixels(t.embeddings).withColumn("m", (F.col("v") > 0.02).cast("int"))
    return P.opened(m, "m", "o").groupBy("image").agg(F.sum("o").alias("set_pixels"), F.avg("o").alias("fraction"))


@query("""SELECT vec_id, round(list_avg(list_sort(list_transform(embedding, lambda v: greatest(0.0::DOUBLE, least(v::DOUBLE, 3.0::DOUBLE))), 'DESC')[1:3]), 6) AS signal FROM embeddings""")
def topk_signal(t):
    """I16 O7."""
    return t.embeddings.select("vec_id", F.round(P.top_mean(F.col("embedding"), 0.05, 3.0), 6).alias("signal"))


@query("""SELECT a.vec_id, round(list_max(list_transform(range(1, 33), lambda i: greatest(abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) / 0.2, abs(a.embedding[i + 32]::DOUBLE - b.embedding[i + 32]::DOUBLE) / 0.1))), 6) AS top,
  list_sum(list_transform(range(1, 33), lambda i: CASE WHEN greatest(abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) / 0.2, abs(a.embedding[i + 32]::DOUBLE - b.embedding[i + 32]::DOUBLE) / 0.1) > 1 THEN 1 ELSE 0 END))::BIGINT AS n_changed
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1""")
def diff_score(t):
    """Two channels, each over its own threshold, the greater counts."""
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    pairs = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("e").alias("r")), "vec_id")
    d = F.zip_with("e", "r", lambda a, b: F.abs(a - b))
    score = F.zip_with(F.slice(d, 1, 32), F.slice(d, 33, 32), lambda p, q: F.greatest(p / F.lit(0.2), q / F.lit(0.1)))
    return pairs.withColumn("s", score).select("vec_id", F.round(F.array_max("s"), 6).alias("top"), F.size(F.filter("s", lambda v: v > 1)).cast("long").alias("n_changed"))


@query(f"""WITH {PX}, r AS (SELECT image, y, avg(abs(v - m)) AS dev FROM (SELECT *, median(v) OVER (PARTITION BY image, y) AS m FROM px) GROUP BY ALL), c AS (SELECT image, x, avg(abs(v - m)) AS dev FROM (SELECT *, median(v) OVER (PARTITION BY image, x) AS m FROM px) GROUP BY ALL),
e AS (SELECT r.image, least(coalesce(min(y) FILTER (r.dev > 0.11), 8), 2) AS t, greatest(coalesce(max(y) FILTER (r.dev > 0.11), -1), 5) AS b FROM r GROUP BY 1), f AS (SELECT c.image, least(coalesce(min(x) FILTER (c.dev > 0.11), 8), 2) AS l, greatest(coalesce(max(x) FILTER (c.dev > 0.11), -1), 5) AS q FROM c GROUP BY 1)
SELECT image, l::BIGINT AS x, t::BIGINT AS y, (q - l + 1)::BIGINT AS w, (b - t + 1)::BIGINT AS h FROM e JOIN f USING (image)""")
def border_crop(t):
    """I1 I2 W9."""
    return P.border_crop(P.pixels(t.embeddings), 0.11, 0.3)


@query(f"""WITH RECURSIVE {PX}, m AS (SELECT image, y, x FROM px WHERE v > 0.1), reach AS (
  SELECT image, y, x, y AS cy, x AS cx FROM m UNION SELECT r.image, r.y, r.x, m.y, m.x FROM reach r JOIN m ON m.image = r.image AND abs(m.y - r.cy) <= 1 AND abs(m.x - r.cx) <= 1),
c AS (SELECT image, y, x, min(cy * 8 + cx) AS root FROM reach GROUP BY ALL)
SELECT image, min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x) - min(x) + 1)::BIGINT AS w, (max(y) - min(y) + 1)::BIGINT AS h, count(*)::BIGINT AS pixels FROM c GROUP BY image, root HAVING (max(x) - min(x) + 1) * (max(y) - min(y) + 1) >= 4""")
def components(t):
    """Boxes of 8-connected components."""
    return K.mask_regions(t.embeddings, threshold=0.1, least_box=4)


@query("""WITH RECURSIVE px AS (SELECT label AS image, vec_id // 50 * 8 + (i - 1) // 8 AS y, vec_id % 50 * 8 + (i - 1) % 8 AS x, embedding[i] AS v FROM embeddings, range(1, 65) r(i)), m AS (SELECT image, y, x FROM px WHERE v > 0.1), reach AS (
  SELECT image, y, x, y AS cy, x AS cx FROM m UNION SELECT r.image, r.y, r.x, m.y, m.x FROM reach r JOIN m ON m.image = r.image AND abs(m.y - r.cy) <= 1 AND abs(m.x - r.cx) <= 1),
c AS (SELECT image, y, x, min(cy * 1000000 + cx) AS root FROM reach GROUP BY ALL)
SELECT image::BIGINT AS image, min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x) - min(x) + 1)::BIGINT AS w, (max(y) - min(y) + 1)::BIGINT AS h, count(*)::BIGINT AS pixels FROM c GROUP BY image, root HAVING (max(x) - min(x) + 1) * (max(y) - min(y) + 1) >= 4""")
def tiled_regions(t):
    """Regions of large masks, one of each label's vectors as tiles side by side."""
    mask = F.transform("embedding", lambda v: v > 0.1)
    tiles = t.embeddings.select(F.col("label").cast("long").alias("image"), F.floor(F.col("vec_id") / 50).cast("int").alias("ty"), (F.col("vec_id") % 50).cast("int").alias("tx"), F.lit(8).alias("width"), mask.alias("mask"))
    return L.regions(tiles, 8, 4)


CAND = """c AS (SELECT label AS product_id, vec_id AS candidate_id, embedding FROM embeddings WHERE vec_id % 25 = 0), p AS (SELECT label AS product_id, vec_id AS probe_id, embedding FROM embeddings WHERE vec_id % 25 <> 0),
f AS (SELECT probe_id, candidate_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN abs(p.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) > 0.1 THEN 1 ELSE 0 END)) / 64.0::DOUBLE AS fraction, p.product_id FROM p JOIN c USING (product_id)),
w AS (SELECT probe_id, min(candidate_id) FILTER (fraction < 0.4) AS matched_id, min(fraction) AS fraction FROM f GROUP BY 1 HAVING count(*) FILTER (fraction < 0.4) = 1)"""


def _sides(t):
    vec = F.transform("embedding", lambda v: v.cast("double"))
    e = t.embeddings.select(F.col("label").alias("product_id"), "vec_id", vec.alias("vec"))
    c = e.filter("vec_id % 25 = 0").select("product_id", F.col("vec_id").alias("candidate_id"), F.col("vec_id").cast("string").alias("sha"), F.col("vec").alias("ref"))
    return e.filter("vec_id % 25 <> 0").select("product_id", F.col("vec_id").alias("probe_id"), "vec"), c


@query(f"WITH {CAND} SELECT probe_id, matched_id, 1 - fraction AS confidence FROM w")
def whole_image_screen(t):
    """T2 J6 P7."""
    p, c = _sides(t)
    return D.clean_one(D.nearest(p, c, 0.1, 0.4))


RANKED = """k AS (SELECT probe_id, candidate_id, fraction, row_number() OVER (PARTITION BY probe_id ORDER BY fraction, candidate_id) AS n FROM f),
g AS (SELECT a.probe_id, a.candidate_id AS matched_id, a.fraction AS best, b.fraction AS runner FROM k a JOIN k b ON a.probe_id = b.probe_id AND a.n = 1 AND b.n = 2),
r AS (SELECT probe_id, matched_id, CASE WHEN runner <= 0 THEN CASE WHEN best <= 0 THEN 1.0 ELSE 0.5 END ELSE greatest(0, least(1, 1 - best / runner)) END AS confidence FROM g WHERE best * 1.02 <= runner AND NOT (best = 0 AND runner = 0))"""


@query(f"WITH {CAND}, {RANKED} SELECT probe_id, matched_id, round(confidence, 9)::DOUBLE AS confidence FROM r")
def region_ranking(t):
    """T3 W2 F8 F9 G21."""
    p, c = _sides(t)
    return D.leading(D.nearest(p, c, 0.1, 0.4), 1.02).withColumn("confidence", F.round("confidence", 9))


@query("""WITH c AS (SELECT label AS product_id, min(vec_id) AS cid FROM embeddings GROUP BY 1), f AS (SELECT p.vec_id AS probe_id, c.cid AS matched_id,
  list_sum(list_transform(range(1, 65), lambda i: CASE WHEN abs(p.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) > 0.1 THEN 1 ELSE 0 END)) / 64.0::DOUBLE AS fraction
  FROM embeddings p JOIN c ON c.product_id = p.label JOIN embeddings e ON e.vec_id = c.cid WHERE p.vec_id <> c.cid)
SELECT probe_id, matched_id, 1 - fraction AS confidence FROM f WHERE fraction < 0.45""")
def single_candidate(t):
    """T4."""
    vec = F.transform("embedding", lambda v: v.cast("double"))
    e = t.embeddings.select(F.col("label").alias("product_id"), "vec_id", vec.alias("vec"))
    first = e.groupBy("product_id").agg(F.min_by(F.struct("vec_id", "vec"), "vec_id").alias("c"))
    c = first.select("product_id", F.col("c.vec_id").alias("candidate_id"), F.col("c.vec_id").cast("string").alias("sha"), F.col("c.vec").alias("ref"))
    p = e.select("product_id", F.col("vec_id").alias("probe_id"), "vec").join(c.select(F.col("candidate_id").alias("probe_id")), "probe_id", "left_anti")
    return D.single_candidate(D.fractions(p, c, 0.1), 0.45)


@query(f"""WITH {CAND}, {RANKED}, d AS (SELECT probe_id, matched_id, 1 - fraction AS confidence, 'PIXEL_DIFF' AS method FROM w UNION ALL SELECT probe_id, matched_id, confidence, 'REGION_CHECK' FROM r WHERE probe_id NOT IN (SELECT probe_id FROM w))
SELECT p.probe_id, d.matched_id, round(coalesce(d.confidence, 0), 9)::DOUBLE AS confidence, coalesce(d.method, 'NONE') AS method FROM p LEFT JOIN d USING (probe_id)""")
def identify(t):
    """The cascade of stages; the first that decides wins, refusal is the default."""
    p, c = _sides(t)
    near = D.nearest(p, c, 0.1, 0.4)
    open_ = lambda x: near.join(x.select("probe_id"), "probe_id", "left_semi")
    stages = [("PIXEL_DIFF", lambda x: D.clean_one(open_(x))), ("REGION_CHECK", lambda x: D.leading(open_(x), 1.02))]
    return D.waterfall(p, stages).withColumn("confidence", F.round("confidence", 9))


@query("""WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[64] AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q, b.vec_id AS neighbour, round(array_distance(q.e, b.embedding::DOUBLE[64]), 9) AS distance FROM q JOIN embeddings b ON b.vec_id <> q.q),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, neighbour) AS n FROM d)
SELECT a.q, a.neighbour, a.distance, a.distance < 0.95 * b.distance AS distinct_ FROM k a JOIN k b ON a.q = b.q AND a.n = 1 AND b.n = 2""")
def knn_ratio(t):
    """Two nearest of each query vector and the ratio test."""
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return N.nearest_two(e, e.filter("vec_id % 50 = 0"), 0.95).withColumn("distance", F.round("distance", 9))


@query("""SELECT vec_id, round(sqrt(abs(a * d - b * c)), 9) AS scale, round(degrees(atan2(c, a)), 9) AS rotation, round(least(1.0, n / 60.0::DOUBLE) * greatest(0.0, 1 - er / 3.0) * least(1.0, o / 0.8), 4) AS confidence,
  n >= 15 AND sqrt(abs(a * d - b * c)) BETWEEN 0.25 AND 4 AND o >= 0.3 AS accepted, n < 30 AS degraded
FROM (SELECT vec_id, 1 + embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, 1 + embedding[4]::DOUBLE AS d, vec_id % 64 AS n, abs(embedding[5]::DOUBLE) * 8 AS er, (vec_id % 10) / 10.0::DOUBLE AS o FROM embeddings)""")
def registration_gates(t):
    """F20 F21 I23."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    m = t.embeddings.select("vec_id", (1 + e(1)).alias("a"), e(2).alias("b"), e(3).alias("c"), (1 + e(4)).alias("d"), (F.col("vec_id") % 64).alias("n"), (F.abs(e(5)) * 8).alias("er"), ((F.col("vec_id") % 10) / F.lit(10.0)).alias("o"))
    scale = B.implied_scale(*map(F.col, "abcd"))
    conf = V.registration_confidence("n", 30, "er", 3.0, "o")
    return m.select("vec_id", F.round(scale, 9).alias("scale"), F.round(B.implied_rotation(F.col("a"), F.col("c")), 9).alias("rotation"), conf.alias("confidence"), ((F.col("n") >= 15) & scale.between(0.25, 4) & (F.col("o") >= 0.3)).alias("accepted"), (F.col("n") < 30).alias("degraded"))


@query("""WITH h AS (SELECT vec_id, 1 + embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE * 9 AS c, embedding[4]::DOUBLE AS d, 1 + embedding[5]::DOUBLE AS e, embedding[6]::DOUBLE * 9 AS f, embedding[7]::DOUBLE / 100 AS g, embedding[8]::DOUBLE / 100 AS i FROM embeddings),
k AS (SELECT vec_id, (a * x + b * y + c) / (g * x + i * y + 1) AS px, (d * x + e * y + f) / (g * x + i * y + 1) AS py FROM h, (VALUES (2.0::DOUBLE, 3.0::DOUBLE), (2, 8), (12, 3), (12, 8)) v(x, y))
SELECT vec_id, CASE WHEN ok THEN round(x0, 6) END AS x0, CASE WHEN ok THEN round(y0, 6) END AS y0 FROM (SELECT vec_id, min(px) AS x0, min(py) AS y0, max(px) - min(px) >= 2 AND max(py) - min(py) >= 2 AS ok FROM k GROUP BY 1)""")
def homography_boxes(t):
    """F22."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    h = [1 + e(1), e(2), e(3) * 9, e(4), 1 + e(5), e(6) * 9, e(7) / 100, e(8) / 100, F.lit(1.0)]
    a = B.box(F.lit(2.0), F.lit(3.0), F.lit(10.0), F.lit(5.0))
    out = t.embeddings.withColumn("b", B.through(h, a))
    return out.select("vec_id", F.round("b.x", 6).alias("x0"), F.round("b.y", 6).alias("y0"))


@query("""WITH h AS (SELECT vec_id, 1 + embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE * 9 AS c, embedding[4]::DOUBLE AS d, 1 + embedding[5]::DOUBLE AS e, embedding[6]::DOUBLE * 9 AS f, embedding[7]::DOUBLE / 100 AS g, embedding[8]::DOUBLE / 100 AS i FROM embeddings),
k AS (SELECT vec_id, sqrt(power((a * x + b * y + c) / (g * x + i * y + 1) - x, 2) + power((d * x + e * y + f) / (g * x + i * y + 1) - y, 2)) AS d FROM h, (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (20, 0), (0, 10), (20, 10)) v(x, y))
SELECT vec_id, round(avg(d), 6) AS error FROM k GROUP BY 1""")
def corner_error(t):
    """how far the corners of a 20 by 10 image lie from where they should."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    h = [1 + e(1), e(2), e(3) * 9, e(4), 1 + e(5), e(6) * 9, e(7) / 100, e(8) / 100, F.lit(1.0)]
    same = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    return t.embeddings.select("vec_id", F.round(B.corner_error(h, same, F.lit(20.0), F.lit(10.0)), 6).alias("error"))
