"""Queries of evaluation, calibration, texts and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.functions import boxes as B
from proofsheet.functions import text as X
from proofsheet.functions import verdict as V
from proofsheet.operators import evaluate as E
from proofsheet.operators import reading as D
from proofsheet.operators import review as R
from proofsheet.sources import images as S

from .registry import query

CASES = """cases AS (SELECT d.doc_id, d.lang, d.source, l.quality, d.n_chars // 1000 AS size_k, CASE WHEN d.doc_id % 6 = 5 THEN NULL ELSE d.doc_id % 3 END AS expected, CASE WHEN d.n_chars % 5 = 0 THEN NULL WHEN d.n_chars % 7 = 0 THEN (d.doc_id + 1) % 3 ELSE d.doc_id % 3 END AS matched, d.n_chars % 41 = 0 AS errored, l.quality = 1 AS approved
FROM documents d JOIN labels l USING (doc_id)), outcomes AS (SELECT *, CASE WHEN errored THEN 'ERROR' WHEN matched IS NULL THEN CASE WHEN expected IS NULL THEN 'CORRECT_REFUSAL' ELSE 'REFUSED' END WHEN expected = matched THEN 'CORRECT' ELSE 'WRONG' END AS outcome FROM cases)"""


def cases(t):
    d, f = t.documents.join(t.labels, "doc_id"), F.col
    d = d.withColumns({"size_k": F.floor(f("n_chars") / 1000), "expected": F.when(f("doc_id") % 6 != 5, f("doc_id") % 3), "errored": f("n_chars") % 41 == 0, "approved": f("quality") == 1})
    d = d.withColumn("matched", F.when(f("n_chars") % 5 == 0, None).when(f("n_chars") % 7 == 0, (f("doc_id") + 1) % 3).otherwise(f("doc_id") % 3))
    none = F.lit(None).cast("string")
    return d.withColumn("outcome", V.outcome("expected", "matched", none, none, "errored"))


@query(f"WITH {CASES} SELECT doc_id, outcome FROM outcomes")
def evaluate_outcomes(t):
    """F14 T17 J2."""
    return cases(t).select("doc_id", "outcome")


@query(f"""WITH {CASES}, p AS (SELECT 'lang' AS facet, lang AS value, outcome FROM outcomes UNION ALL SELECT 'quality', quality::VARCHAR, outcome FROM outcomes UNION ALL SELECT 'size_k', size_k::VARCHAR, outcome FROM outcomes)
SELECT facet, value, count(*)::BIGINT AS cases, coalesce(count(*) FILTER (outcome = 'CORRECT') / nullif(count(*) FILTER (outcome IN ('CORRECT', 'WRONG')), 0)::DOUBLE, 0) AS accuracy_when_decided, count(*) FILTER (outcome IN ('CORRECT', 'WRONG')) / count(*)::DOUBLE AS coverage FROM p GROUP BY ALL""")
def accuracy_facets(t):
    """G9 G10 G11 G13."""
    return E.accuracy(E.facet_tally(cases(t), ["lang", "quality", "size_k"]))


@query(f"""WITH {CASES} SELECT count(*)::BIGINT AS approved, count(*) FILTER (outcome = 'WRONG')::BIGINT AS false_alarms, count(*) FILTER (outcome = 'REFUSED')::BIGINT AS refusals, count(*) FILTER (outcome = 'WRONG' AND coalesce(quality >= 75, true))::BIGINT AS false_alarms_good,
count(*) FILTER (outcome = 'REFUSED' AND coalesce(quality >= 75, true))::BIGINT AS refusals_good FROM (SELECT * REPLACE (CASE WHEN n % 4 = 0 THEN NULL ELSE n % 100 END AS quality) FROM (SELECT *, doc_id AS n FROM outcomes)) WHERE approved""")
def false_alarms(t):
    """G12."""
    return E.false_alarms(cases(t).withColumn("quality", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 100)))


@query("""SELECT round(quantile_cont(value, 0.999) FILTER (event_type <> 'purchase'), 6) AS threshold, round(quantile_cont(value, 0.99) FILTER (event_type = 'purchase') - quantile_cont(value, 0.999) FILTER (event_type <> 'purchase'), 6) AS margin FROM events""")
def calibrate(t):
    """G15 G19 G20."""
    out = E.noise_thresholds(t.events.withColumn("moved", F.col("event_type") == "purchase"), "value", "moved")
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("margin", 6).alias("margin"))


@query("""WITH s AS (SELECT l_returnflag = 'R' AS changed, l_extendedprice / l_quantity AS ssim, l_discount * l_quantity AS chroma FROM lineitem)
SELECT round(quantile_cont(ssim, 0.999) FILTER (NOT changed), 6) AS ssim_threshold, round(quantile_cont(ssim, 0.99) FILTER (changed) - quantile_cont(ssim, 0.999) FILTER (NOT changed), 6) AS ssim_margin,
  round(quantile_cont(chroma, 0.999) FILTER (NOT changed), 6) AS chroma_threshold, round(quantile_cont(chroma, 0.99) FILTER (changed) - quantile_cont(chroma, 0.999) FILTER (NOT changed), 6) AS chroma_margin FROM s""")
def calibrate_pairs(t):
    """Both thresholds of pairs, and their margins, from one sort."""
    rows = t.lineitem.select((F.col("l_returnflag") == "R").alias("changed"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("ssim"), (F.col("l_discount") * F.col("l_quantity")).alias("chroma"))
    out = E.pair_thresholds(rows, "changed")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 6) AS low, round(quantile_cont(l_extendedprice, 0.5), 6) AS mid, round(quantile_cont(l_extendedprice, 0.999), 6) AS high, round(quantile_cont(l_tax, 0.9), 6) AS tax FROM lineitem GROUP BY 1""")
def group_percentiles(t):
    """Several percentiles of two columns for each group at once."""
    wanted = {"low": ("l_extendedprice", 0.01), "mid": ("l_extendedprice", 0.5), "high": ("l_extendedprice", 0.999), "tax": ("l_tax", 0.9)}
    out = E.percentiles(t.lineitem, ["l_extendedprice", "l_tax"], wanted, ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in wanted])


@query("""SELECT round(quantile_cont(tail, 0.5), 6) AS p50, round(quantile_cont(tail, 0.95), 6) AS p95, round(quantile_cont(tail, 0.99), 6) AS p99 FROM (SELECT l_partkey, quantile_cont(l_extendedprice, 0.999) AS tail FROM lineitem GROUP BY 1)""")
def per_image_tail(t):
    """G16."""
    out = E.tails(t.lineitem, "l_partkey", "l_extendedprice")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""SELECT l_returnflag, round(greatest(3 * max(l_tax), 1e-5), 6) AS clean, round(greatest(0.005, least(0.5, sqrt(greatest(quantile_cont(l_tax / 100, 0.99), 1e-4) * greatest(quantile_cont(l_discount, 0.05), 1e-3)))), 6)::DOUBLE AS region FROM lineitem GROUP BY 1""")
def separation(t):
    """G17 G18."""
    rows = t.lineitem.withColumn("quiet", F.col("l_tax") / 100)
    return rows.groupBy("l_returnflag").agg(F.round(E.clean_cutoff(F.col("l_tax")), 6).alias("clean"), F.round(E.region_cutoff("quiet", "l_discount"), 6).alias("region"))


@query("""SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE floor(value / 5) + 1 END::BIGINT AS bin, count(*)::BIGINT AS n FROM events WHERE value IS NOT NULL GROUP BY 1""")
def histogram(t):
    """S19."""
    return E.histogram(t.events.filter("value is not null"), "value", 0.0, 100.0, 20)


STAGES = """stages AS (SELECT user_id AS case_id, event_type AS stage, event_id AS ordinal, value AS ms, CASE WHEN event_id % 7 = 0 THEN NULL ELSE floor(value) / 1000 END AS confidence, CASE WHEN user_id % 3 = 0 THEN 'PASS' ELSE 'STALE_VERSION' END AS verdict FROM events)"""


def stages(t):
    f = F.col
    return t.events.select(f("user_id").alias("case_id"), f("event_type").alias("stage"), f("event_id").alias("ordinal"), f("value").alias("ms"), F.when(f("event_id") % 7 != 0, F.floor("value") / 1000).alias("confidence"), F.when(f("user_id") % 3 == 0, "PASS").otherwise("STALE_VERSION").alias("verdict"))


@query(f"WITH {STAGES} SELECT case_id, round_even(coalesce(min(confidence) FILTER (stage <> 'click'), 0), 4) AS confidence FROM stages GROUP BY 1")
def pipeline_confidence(t):
    """G23."""
    return E.pipeline_confidence(stages(t).withColumn("stage", F.when(F.col("stage") == "click", "hash").otherwise(F.col("stage"))))


@query(f"WITH {STAGES} SELECT stage, round(avg(ms), 6) AS mean_ms, round(median(ms), 6) AS median_ms, max(ms) AS max_ms FROM stages GROUP BY 1")
def stage_timing(t):
    """G14."""
    return E.stage_timing(stages(t))


@query(f"""WITH {STAGES} SELECT case_id, verdict, CASE WHEN verdict <> 'PASS' THEN string_agg(stage, '>' ORDER BY ordinal) END AS trace, CASE WHEN verdict <> 'PASS' THEN count(*) END AS n FROM stages GROUP BY 1, 2""")
def trace_rows(t):
    """T14 S12 W10."""
    out = E.trace_rows(stages(t))
    return out.select("case_id", "verdict", F.array_join(F.transform("trace", lambda s: s["stage"]), ">").alias("trace"), F.when(F.col("trace").isNotNull(), F.size("trace")).cast("long").alias("n"))


@query("""WITH d AS (SELECT user_id, count(*) AS done, count(*) / (epoch(max(ts)) - epoch(min(ts)) + 1) AS rate, count(*) FILTER (event_type = 'view') / count(*)::DOUBLE AS cached_share FROM events WHERE event_type <> 'error' GROUP BY 1), t AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1)
SELECT user_id, done::BIGINT AS done, round(rate, 9) AS rate, round(cached_share, 9) AS cached_share, round(CASE WHEN total = coalesce(done, 0) THEN 0 ELSE (total - coalesce(done, 0)) / rate END, 3) AS seconds_left FROM t LEFT JOIN d USING (user_id)""")
def run_rates(t):
    """Rates of each user's run, of which the errors are still to do, and the time that is left."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    totals = t.events.groupBy("user_id").agg(F.count("*").alias("total"))
    out = E.run_rates(t.events.filter("event_type <> 'error'"), "user_id", ts, F.col("event_type") == "view", totals)
    return out.select("user_id", "done", F.round("rate", 9).alias("rate"), F.round("cached_share", 9).alias("cached_share"), F.round("seconds_left", 3).alias("seconds_left"))


@query("""SELECT f.finding_id, f.verdict, s.s_name AS image_name, s.s_nationkey AS image_folder FROM b_findings f LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s ON s.s_suppkey = f.image_id""")
def findings_with_images(t):
    """Findings with their images, also those whose image is gone."""
    images = t.supplier.filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("folder"))
    return E.findings_with_images(t.b_findings, images).select("finding_id", "verdict", "image_name", "image_folder")


@query("""SELECT l_orderkey, round(avg(1 - l_discount), 6) AS mean_confidence, round(min(1 - l_discount), 6) AS min_confidence FROM lineitem GROUP BY 1""")
def token_confidence(t):
    """G22."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(1 - F.col("l_discount")).alias("c"))
    mean = F.aggregate("c", F.lit(0.0), lambda a, v: a + v) / F.size("c")
    return per.select("l_orderkey", F.round(F.when(F.size("c") == 0, 1.0).otherwise(mean), 6).alias("mean_confidence"), F.round(F.coalesce(F.array_min("c"), F.lit(1.0)), 6).alias("min_confidence"))


@query("""SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, ceil(count(*) OVER (PARTITION BY event_type) / 700.0) AS k FROM events) WHERE i % k::BIGINT = 0""")
def subsample_strided(t):
    """G28."""
    return E.strided(t.events, "event_type", ["ts", "event_id"], 700).select("event_id")


PAIRS = """pairs AS (SELECT l_orderkey * 8 + l_linenumber AS case_id, ['identical', 'recompressed', 'recoloured', 'number_edit', 'different_product'][1 + l_orderkey % 5] AS class, CASE l_suppkey % 6 WHEN 0 THEN 'IDENTICAL' WHEN 1 THEN 'MATCH' WHEN 2 THEN 'MATCH_WITH_COSMETIC_DIFFERENCES' WHEN 3 THEN 'NEEDS_REVIEW' WHEN 4 THEN 'DIFFERENT' ELSE 'CANNOT_COMPARE' END AS verdict, l_linenumber = 7 AS errored,
  l_partkey % 90 AS x, l_partkey % 70 AS y, 40 AS w, 30 AS h, l_partkey % 90 + l_suppkey % 50 AS ex, l_partkey % 70 AS ey, 40 AS ew, 30 AS eh, floor(l_quantity)::BIGINT AS q FROM lineitem),
scored AS (SELECT *, CASE class WHEN 'identical' THEN verdict = 'IDENTICAL' WHEN 'recompressed' THEN verdict = 'MATCH' WHEN 'recoloured' THEN verdict IN ('MATCH_WITH_COSMETIC_DIFFERENCES', 'NEEDS_REVIEW') WHEN 'number_edit' THEN verdict IN ('DIFFERENT', 'NEEDS_REVIEW') ELSE verdict = 'CANNOT_COMPARE' END AS accepted,
  greatest(0, 40 - (ex - x)) * 30 AS inter FROM pairs),
s AS (SELECT *, CASE WHEN errored THEN 'failed' WHEN accepted THEN 'correct' WHEN verdict = 'CANNOT_COMPARE' THEN 'refused' WHEN class IN ('identical', 'recompressed', 'recoloured') AND verdict = 'DIFFERENT' THEN 'false_alarm' ELSE 'wrong' END AS score, class = 'number_edit' AND inter / 1200.0::DOUBLE > 0.3 AS localised, class = 'number_edit' AND q % 3 <> 0 AS read_ FROM scored)"""


def pair_cases(t):
    f = F.col
    rows = t.lineitem.select(
        (f("l_orderkey") * 8 + f("l_linenumber")).alias("case_id"), _by(f("l_orderkey") % 5, [F.lit(x) for x in ("identical", "recompressed", "recoloured", "number_edit", "different_product")]).alias("class"),
        _by(f("l_suppkey") % 6, [F.lit(x) for x in ("IDENTICAL", "MATCH", "MATCH_WITH_COSMETIC_DIFFERENCES", "NEEDS_REVIEW", "DIFFERENT", "CANNOT_COMPARE")]).alias("verdict"), (f("l_linenumber") == 7).alias("errored"),
        (f("l_partkey") % 90).alias("x"), (f("l_partkey") % 70).alias("y"), (f("l_partkey") % 90 + f("l_suppkey") % 50).alias("ex"), F.floor("l_quantity").alias("q"),
    )
    edit = f("class") == "number_edit"
    old, new = F.concat(f("q").cast("string"), F.lit(" mg")), F.concat((f("q") + 30).cast("string"), F.lit("mg"))
    side = lambda x: F.when(f("q") % 3 == 0, F.lit("sugar free")).otherwise(F.concat(F.lit("Sodium "), x))
    boxes = F.array(B.box("x", "y", F.lit(40), F.lit(30)))
    rows = rows.withColumns({"edit_box": F.when(edit, B.box("ex", "y", F.lit(40), F.lit(30))), "boxes": boxes, "old_value": F.when(edit, old), "new_value": F.when(edit, new), "readings": F.array(F.struct(side(old).alias("ref_text"), side(new).alias("mkt_text")))})
    return E.scored_pairs(rows)


@query(f"WITH {PAIRS} SELECT case_id, score, localised FROM s")
def case_scores(t):
    """Pairs scored by the verdicts that their class accepts, and whether an edit was found where it is."""
    return pair_cases(t).select("case_id", "score", "localised")


@query(f"WITH {PAIRS} SELECT case_id, read_ AS read FROM s")
def read_correctness(t):
    """The old value read on one side and the new on the other, in one region."""
    return pair_cases(t).select("case_id", "read")


@query(f"""WITH {PAIRS} SELECT class, count(*)::BIGINT AS cases, round(count(*) FILTER (score = 'correct') / count(*)::DOUBLE, 9) AS accuracy, count(*) FILTER (score = 'false_alarm')::BIGINT AS false_alarms, count(*) FILTER (score = 'refused')::BIGINT AS refused,
  round(count(*) FILTER (localised) / nullif(count(*) FILTER (class = 'number_edit'), 0)::DOUBLE, 9) AS localisation_rate, round(count(*) FILTER (read_) / nullif(count(*) FILTER (class = 'number_edit'), 0)::DOUBLE, 9) AS read_rate FROM s GROUP BY 1""")
def class_summary(t):
    """Accuracy, false alarms, localisation and read rates of each class of pairs."""
    out = E.class_summary(pair_cases(t))
    return out.select("class", "cases", *[F.round(c, 9).alias(c) for c in ("accuracy",)], "false_alarms", "refused", *[F.round(c, 9).alias(c) for c in ("localisation_rate", "read_rate")])


@query("""WITH i AS (SELECT l_orderkey AS product_id, l_linenumber AS image, 100 AS width, 100 + (l_suppkey % 3 = 0)::INTEGER * 20 AS height, 100 - l_linenumber AS w, 100 + (l_suppkey % 3 = 0)::INTEGER * 20 - l_partkey % 5 AS h FROM lineitem),
a AS (SELECT *, w / h::DOUBLE AS aspect FROM i)
SELECT product_id, image, round(1 - w * h / (width * height)::DOUBLE, 9) AS cropped, 1 - w * h / (width * height)::DOUBLE > 0.02 AS much_border, (SELECT count(DISTINCT height) FROM i x WHERE x.product_id = a.product_id) > 1 AS mixed_sizes, abs(aspect / median(aspect) OVER (PARTITION BY product_id) - 1) > 0.01 AS odd_aspect FROM a""")
def quality_checks(t):
    """how much border an image has, mixed sizes and odd shapes of a product's images."""
    tall = F.when(F.col("l_suppkey") % 3 == 0, 120).otherwise(100)
    rows = t.lineitem.select(F.col("l_orderkey").alias("product_id"), F.col("l_linenumber").alias("image"), F.lit(100).alias("width"), tall.alias("height"), (100 - F.col("l_linenumber")).alias("w"), (tall - F.col("l_partkey") % 5).alias("h"))
    return R.preflight(rows).select("product_id", "image", F.round("cropped", 9).alias("cropped"), "much_border", "mixed_sizes", "odd_aspect")


@query("""WITH r AS (SELECT l_orderkey AS product_id, l_linenumber AS version, l_linenumber % 3 AS n_regions, l_discount AS fraction FROM lineitem)
SELECT product_id, count(*) FILTER (n_regions = 0)::BIGINT AS without_regions, count(*) FILTER (fraction >= 0.05)::BIGINT AS over_cutoff, count(*) FILTER (n_regions = 0 OR fraction >= 0.05)::BIGINT AS warned FROM r GROUP BY 1""")
def reference_checks(t):
    """transitions of versions that show no region, and those not told apart from noise."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("product_id"), (F.col("l_linenumber") % 3).alias("n_regions"), F.col("l_discount").alias("fraction"))
    return R.reference_checks(rows, 0.05)


@query("""SELECT q.quality::INTEGER AS quality, s.size::INTEGER AS size, p.padding, f.format, e.extra FROM (VALUES (95), (85), (75), (60)) q(quality), (VALUES (1500), (1200), (1000), (800)) s(size), (VALUES ('none'), ('white'), ('transparent')) p(padding), (VALUES ('jpeg'), ('webp')) f(format), (VALUES ('strip'), ('exif'), ('srgb')) e(extra)""")
def variant_cross_product(t):
    """All 288 transforms."""
    return E.variant_cross_product(t.spark)


@query("""SELECT q.quality::INTEGER AS quality, s.size::INTEGER AS size, 3::BIGINT AS variants, true AS drawn FROM (VALUES (95), (85), (75), (60)) q(quality), (VALUES (1500), (1200), (1000), (800)) s(size)""")
def variant_grid(t):
    """Each quality and size, with three seeded draws of the other axes."""
    got = E.variant_grid(t.spark, seed=7, per_cell=3)
    known = F.col("padding").isin("none", "white", "transparent") & F.col("format").isin("jpeg", "webp") & F.col("extra").isin("strip", "exif", "srgb")
    return got.groupBy("quality", "size").agg(F.count("*").alias("variants"), F.every(known).alias("drawn"))


@query("""WITH w AS (SELECT source AS class, count(*) AS weight FROM documents GROUP BY 1), m AS (SELECT class, greatest(1, round_even(weight * 60 / (SELECT sum(weight) FROM w)::DOUBLE, 0))::INTEGER AS m FROM w)
SELECT class, unnest(range(1, m + 1))::INTEGER AS n FROM m""")
def stratified_plan(t):
    """D7."""
    return E.stratified_plan(t.documents.groupBy(F.col("source").alias("class")).agg(F.count("*").alias("weight")), 60)


@query("""SELECT doc_id, len(list_filter(string_split(text, ' '), lambda t: regexp_matches(t, '[A-Za-z0-9]')))::BIGINT AS readable FROM documents""")
def token_filter(t):
    """P8."""
    return t.documents.select("doc_id", F.size(X.readable_tokens(F.split("text", " "))).cast("long").alias("readable"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_suppkey % 90 AS y, l_partkey % 300 AS x, l_quantity AS h FROM lineitem), m AS (SELECT *, greatest(1, 0.6 * median(h) OVER (PARTITION BY l_orderkey)) AS band FROM b)
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(y / band, 0), x, l_linenumber)::BIGINT AS place FROM m""")
def reading_order(t):
    """Boxes of tokens from their corners, in lines of about their height, from left to right."""
    f = F.col
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = f("l_partkey") % 300, f("l_suppkey") % 90
    quad = F.array(corner(x + 5, y), corner(x, y + f("l_quantity")), corner(x + 5, y + f("l_quantity")), corner(x, y))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", D.quad_box(quad).alias("b")).select("l_orderkey", "l_linenumber", "b.*")
    return E.reading_order(rows, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "place")


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_brand), '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(length(ltrim(p, '0'))::VARCHAR, 6, '0') || ltrim(p, '0') ELSE p END), '') AS key FROM part""")
def natural_sort(t):
    """O8 S6."""
    return t.part.select("p_partkey", X.natural_key(F.col("p_brand")).alias("key"))


@query("""WITH p AS (SELECT page_id, CASE WHEN length(html) % 5 < 2 THEN 'ref' ELSE 'mkt' END AS side, (page_id // 3)::VARCHAR AS key FROM pages)
SELECT coalesce(r.key, m.key) AS key, r.page_id AS ref_id, m.page_id AS mkt_id, CASE WHEN m.key IS NULL THEN 'mkt' WHEN r.key IS NULL THEN 'ref' END AS missing FROM (SELECT key, min(page_id) AS page_id FROM p WHERE side = 'ref' GROUP BY 1) r FULL JOIN (SELECT key, min(page_id) AS page_id FROM p WHERE side = 'mkt' GROUP BY 1) m ON r.key = m.key""")
def pair_files(t):
    """Files paired by name, and what has no partner."""
    name = F.concat(F.when(F.length("html") % 5 < 2, "ref").otherwise("mkt"), F.lit("__"), F.floor(F.col("page_id") / 3).cast("string"), F.lit(".png"))
    return S.paired(t.pages.select(F.col("page_id").alias("id"), name.alias("name"))).withColumnsRenamed({"ref": "ref_id", "mkt": "mkt_id"})


@query("""SELECT key, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' ELSE 'right' END AS side FROM (SELECT doc_id // 2 AS key, bool_or(n_chars % 2 = 0) AS a, bool_or(n_chars % 3 = 0) AS b FROM documents GROUP BY 1) WHERE a OR b""")
def key_sets(t):
    """Intersection and both differences of two sets of keys."""
    k = t.documents.withColumn("key", F.floor(F.col("doc_id") / 2))
    return E.key_sets(k.filter("n_chars % 2 = 0").select("key"), k.filter("n_chars % 3 = 0").select("key"))


@query("""SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN split_part(url, '/', 3) WHEN page_id % 2 = 0 THEN 'p' || page_id END AS product_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE '/files/' || page_id || '.png' END AS static_url FROM pages""")
def run_inputs(t):
    """Product by manifest, else by name, and addresses below the served root."""
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("__x.png"))).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".png")))
    listed = t.pages.withColumn("name", name).withColumn("path", F.concat(F.when(F.col("page_id") % 3 == 0, "/elsewhere/").otherwise("/data/files/"), F.col("page_id").cast("string"), F.lit(".png")))
    manifest = listed.filter("page_id % 5 <> 0").select(F.col("name").alias("file"), F.split_part("url", F.lit("/"), F.lit(3)).alias("product_id"))
    return S.run_inputs(listed, manifest).select("page_id", "product_id", S.served_url(F.col("path"), {"/data/files": "/files"}).alias("static_url"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN levenshtein(a.p_name, b.p_name) > 4 THEN 5 ELSE levenshtein(a.p_name, b.p_name) END::BIGINT AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def edit_distance_capped(t):
    """X8."""
    p = t.part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("na"))
    q = t.part.select(F.col("p_partkey").alias("b"), (F.col("p_partkey") - 1).alias("a"), F.col("p_name").alias("nb"))
    return p.join(q, "a").select("a", "b", X.capped_distance(F.col("na"), F.col("nb"), 4).cast("long").alias("distance"))


@query("""SELECT p_partkey, length(s) - length(replace(s, '0', '')) = 1 AS swapped, length(s) - length(replace(s, '0', '')) IN (1, 2) AS swapped2, p_name LIKE '%rn%' AS run, CASE WHEN p_partkey % 4 = 3 THEN false ELSE p_partkey % 4 <> 0 END AS pair
FROM (SELECT *, p_partkey::VARCHAR AS s FROM part)""")
def confusable(t):
    """Zeros read as O, rn as m, and pairs of characters that are or aren't taken for one another."""
    s = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 4
    old = F.when(k == 0, "380").when(k == 1, "1l").when(k == 2, "5S").otherwise("8A")
    new = F.when(k == 0, "480").when(k == 1, "11").when(k == 2, "55").otherwise("BA0")
    zeros = F.replace(s, F.lit("0"), F.lit("O"))
    return t.part.select("p_partkey", X.confusable(s, zeros).alias("swapped"), X.confusable(s, zeros, 2).alias("swapped2"), X.confusable(F.col("p_name"), F.replace("p_name", F.lit("rn"), F.lit("m"))).alias("run"), X.confusable(old, new).alias("pair"))


@query()
def text_normalize(t):
    """X1 X2 X3 X4 X6."""
    return t.conversations.select("conv_id", "turn", X.normalized(F.col("text")).alias("normal"))


def _by(key, cases):
    """cases[key], a column for each place."""
    return F.element_at(F.array(*cases), (key + 1).cast("int"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, floor(l_quantity)::BIGINT::VARCHAR AS q, l_extendedprice AS p, l_orderkey % 9 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN q || 'mg' WHEN 1 THEN q || 'mg' WHEN 2 THEN q || 'g' WHEN 3 THEN q || '.5l' WHEN 4 THEN q || '250' WHEN 5 THEN 'net weight ' || q WHEN 6 THEN 'net ' || q || '-7 kg'
  WHEN 7 THEN 'x ' || q || 'kcal g' ELSE CASE WHEN p = floor(p) THEN p::BIGINT::VARCHAR ELSE format('{:g}', p) END END AS normal FROM l""")
def text_normalize_cases(t):
    """Spellings of quantities, punctuation, compatibility forms, and prices to six digits."""
    q, d = F.floor("l_quantity").cast("string"), lambda c: c.cast("string")
    texts = [F.concat(q, F.lit(" mg")), F.concat(q, F.lit("  MG.")), F.concat(q, F.lit(".0 grams")), F.concat(q, F.lit(",5 litre")), F.concat(q, F.lit(",250")), F.concat(F.lit("(Net) weight: "), q), F.concat(F.lit("ｎｅｔ\u00a0"), q, F.lit("–7 Kgs")), F.concat(F.lit("X "), q, F.lit(" calories, gm")), d(F.col("l_extendedprice"))]
    return t.lineitem.select("l_orderkey", "l_linenumber", X.normalized(_by(F.col("l_orderkey") % 9, texts)).alias("normal"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS value, CASE WHEN l_linenumber = 7 THEN NULL ELSE ['mg', 'g', 'kcal', '', '%', 'ug', 'l', 'kj', 'ml', 'kg', 'oz'][1 + l_orderkey % 11] END AS unit FROM lineitem""")
def parse_number(t):
    """Quantities with units in several spellings, and words."""
    spelling = _by(F.col("l_orderkey") % 11, [F.lit(x) for x in ("milligrams", "GM", " calories", "", "pct", "mcg", " Litres", "kilojoule", "millilitre", "kgs", "oz")])
    token = F.when(F.col("l_linenumber") == 7, "protein").otherwise(F.concat(F.col("l_quantity").cast("string"), spelling))
    return t.lineitem.select("l_orderkey", "l_linenumber", X.quantity(token).alias("n")).select("l_orderkey", "l_linenumber", "n.value", "n.unit")


def turns(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.withColumn("before", F.lag("text").over(w)).filter("before is not null")


@query()
def text_compare(t):
    """Consecutive turns compared."""
    return X.with_comparison(turns(t), "before", "text", "c", alike_too=False).select("conv_id", "turn", "c.kind", "c.severity", "c.n_differences")


#: Old and new readings by number of the case; {q} and {r} are two different numbers.
READINGS = [
    ("sodium {q} mg", "sodium {q}.0 mg"), ("sodium {q} mg", "sodium {r} mg"), ("sodium {q} mg", "sodium {q} g"), ("sodium {q}0 mg", "sodium {q}O mg"), ("no added sugar {q}", "no sugar {q}"), ("no sugar {q}", "no added sugar {q}"),
    ("added sugar {q}", "added suga r {q}"), ("coffee cocoa {q}", "coffee cocooa {q}"), ("high , vegan {q}", "high ; vegan {q}"), ("rnodern art {q}", "modern art {q}"), ("fat {q} g salt {q} g", "fat {q} g salt {r} kg"), ("red wine {q}", "blue wine {q}"), ("a {q} b c", "a {r} b d"),
]


def readings(t):
    q, r = F.floor("l_quantity").cast("string"), (F.floor("l_quantity") + 60).cast("string")

    def text(pattern):
        return F.replace(F.replace(F.lit(pattern), F.lit("{q}"), q), F.lit("{r}"), r)

    k = F.col("l_orderkey") % len(READINGS)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", _by(k, [text(a) for a, _ in READINGS]).alias("old"), _by(k, [text(b) for _, b in READINGS]).alias("new"))


KINDS = """k AS (SELECT l_orderkey, l_linenumber, l_discount, floor(l_quantity)::BIGINT AS q, l_orderkey % 13 AS k FROM lineitem),
c AS (SELECT *, CASE WHEN k IN (0, 6) THEN 'NO_DIFFERENCE' WHEN k IN (1, 12) THEN 'NUMBER_CHANGED' WHEN k IN (2, 10) THEN 'NUMBER_AND_UNIT_CHANGED' WHEN k IN (3, 7, 9) THEN 'CONFUSABLE_CHARACTERS' WHEN k = 4 THEN 'TEXT_REMOVED' WHEN k = 5 THEN 'TEXT_ADDED' WHEN k = 8 THEN 'PUNCTUATION_ONLY' ELSE 'TEXT_CHANGED' END AS kind FROM k),
s AS (SELECT *, CASE kind WHEN 'NO_DIFFERENCE' THEN 'NONE' WHEN 'CONFUSABLE_CHARACTERS' THEN 'UNCERTAIN' WHEN 'PUNCTUATION_ONLY' THEN 'COSMETIC' ELSE 'MATERIAL' END AS severity FROM c)"""


@query(f"""WITH {KINDS} SELECT l_orderkey, l_linenumber, kind, severity, CASE WHEN kind = 'NO_DIFFERENCE' THEN 0 WHEN k = 12 THEN 2 ELSE 1 END::INTEGER AS n_differences FROM s""")
def text_compare_cases(t):
    """Every kind of change, with numbers and units."""
    return X.once(readings(t), "old", "new", lambda d, a, b: X.with_comparison(d, a, b, "c", alike_too=False)).select("l_orderkey", "l_linenumber", "c.kind", "c.severity", "c.n_differences")


@query()
def word_diff(t):
    """The words that consecutive turns share and don't."""
    return turns(t).select("conv_id", "turn", F.explode(X.diff_words("before", "text")).alias("r")).select("conv_id", "turn", "r.tag", "r.words")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, floor(l_quantity)::BIGINT::VARCHAR AS q FROM lineitem),
r AS (SELECT *, unnest([{'tag': 'equal', 'words': 'a ' || q}, {'tag': 'delete', 'words': 'b c'}, {'tag': 'insert', 'words': 'x' || q || ' y'}, {'tag': 'equal', 'words': 'd ' || q}, {'tag': 'insert', 'words': 'z'}]) AS r, unnest(range(1, 6)) AS n FROM q)
SELECT l_orderkey, l_linenumber, (n - 1)::INTEGER AS place, r.tag AS tag, r.words AS words FROM r""")
def word_diff_cases(t):
    """Shared words, a replaced run and an addition."""
    q = F.floor("l_quantity").cast("string")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("a "), q, F.lit(" b c d "), q).alias("old"), F.concat(F.lit("a "), q, F.lit(" x"), q, F.lit(" y  d "), q, F.lit(" z")).alias("new"))
    found = X.once(rows, "old", "new", lambda d, a, b: d.withColumn("runs", X.diff_words(a, b)))
    return found.select("l_orderkey", "l_linenumber", F.posexplode("runs").alias("place", "r")).select("l_orderkey", "l_linenumber", "place", "r.tag", "r.words")


def _route(rows, palette, ink, reliable, a, b, repeated=False):
    c = X.once(rows, a, b, lambda d, a, b: X.with_comparison(d, a, b, "c")) if repeated else X.with_comparison(rows, a, b, "c")
    gone = F.exists("c.differences", lambda d: d["kind"].isin("TEXT_REMOVED", "TEXT_ADDED"))
    return c.withColumn("s", X.region_route(palette, F.length(b) > 0, F.col("c.severity"), ink, reliable, F.col("c.alike"), gone))


@query()
def text_route(t):
    """The severity of regions by how they were read, and each conversation's confidence."""
    rows = _route(turns(t), F.col("turn") % 9 == 8, F.col("turn") % 7 == 6, F.col("turn") % 2 == 0, "before", "text")
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("severities"))
    return per.withColumn("confidence", F.round(X.stage_confidence(F.col("severities")), 6))


@query(f"""WITH {KINDS}, r AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'COSMETIC' WHEN severity = 'NONE' OR l_discount > 0.085 THEN 'NONE' WHEN l_discount >= 0.02 THEN severity
  WHEN k IN (4, 5) THEN 'UNCERTAIN' WHEN k = 11 THEN CASE WHEN q < 10 THEN 'UNCERTAIN' ELSE '?' END ELSE '?' END AS s, k, q FROM s)
SELECT l_orderkey, count(*) FILTER (s = 'MATERIAL')::BIGINT AS material, count(*) FILTER (s = 'NONE')::BIGINT AS none, count(*) FILTER (s = 'COSMETIC')::BIGINT AS cosmetic FROM (SELECT * FROM r WHERE k IN (0, 4, 5, 6)) GROUP BY 1""")
def text_route_cases(t):
    """How regions are routed by palette, ink, reliability and lost words; readings whose likeness doesn't matter."""
    f = F.col
    rows = _route(readings(t), f("l_linenumber") == 7, f("l_discount") > 0.085, f("l_discount") >= 0.02, "old", "new", repeated=True).filter(f("l_orderkey") % len(READINGS) < 7).filter((f("l_orderkey") % len(READINGS)).isin(0, 4, 5, 6))
    return rows.groupBy("l_orderkey").agg(*[F.count_if(f("s") == s.upper()).alias(s) for s in ("material", "none", "cosmetic")])


@query("""SELECT l_orderkey, l_linenumber, round(2 * least(a, b) / (a + b)::DOUBLE, 9) AS alike, CASE WHEN a = b OR 2 * least(a, b) / (a + b)::DOUBLE >= 0.75 THEN 'NONE' ELSE 'UNCERTAIN' END AS severity
FROM (SELECT l_orderkey, l_linenumber, l_linenumber + 3 AS a, l_suppkey % 7 + 3 AS b FROM lineitem)""")
def similarity_cases(t):
    """Likeness of two runs of one letter, read unreliably."""
    run = lambda n: F.repeat(F.lit("w"), n.cast("int"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", run(F.col("l_linenumber") + 3).alias("old"), run(F.col("l_suppkey") % 7 + 3).alias("new"))
    out = _route(rows, F.lit(False), F.lit(False), F.lit(False), "old", "new", repeated=True)
    return out.select("l_orderkey", "l_linenumber", F.round("c.alike", 9).alias("alike"), F.col("s").alias("severity"))


@query("""SELECT l_orderkey, round(1 - coalesce(count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag <> 'N'), 0)::DOUBLE, 0), 9) AS confidence FROM lineitem GROUP BY 1""")
def stage_confidence(t):
    """X19."""
    s = F.when(F.col("l_returnflag") == "A", "UNCERTAIN").when(F.col("l_returnflag") == "R", "MATERIAL").otherwise("NONE")
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list(s).alias("s")).select("l_orderkey", F.round(X.stage_confidence(F.col("s")), 9).alias("confidence"))
