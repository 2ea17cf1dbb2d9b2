"""Queries of the review screens over bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet import schema
from proofsheet.functions import verdict as V
from proofsheet.operators import review as R

from .registry import query

SRANK = "CASE {0} WHEN 'MATERIAL' THEN 3 WHEN 'UNCERTAIN' THEN 2 WHEN 'COSMETIC' THEN 1 ELSE 0 END"
VRANK = "CASE {0} WHEN 'STALE_VERSION' THEN 3 WHEN 'ERROR' THEN 2 WHEN 'UNKNOWN_IMAGE' THEN 1 ELSE 0 END"
SIG = "sha256(concat_ws('|', {p}product_id, round_even({p}x, -1)::BIGINT, round_even({p}y, -1)::BIGINT, round_even({p}w, -1)::BIGINT, round_even({p}h, -1)::BIGINT, coalesce({p}field_key, '')))"
ACKED = f"""acked AS (
  SELECT r.finding_id, count(*) AS region_count, bool_and(a.sig IS NOT NULL) AS acknowledged
  FROM (SELECT *, {SIG.format(p="")} AS sig FROM b_regions) r
  LEFT JOIN (SELECT DISTINCT product_id, version_id, {SIG.format(p="")} AS sig FROM b_acks WHERE decision = 'ACKNOWLEDGED') a
    ON a.product_id = r.product_id AND a.sig = r.sig AND a.version_id = r.version_id
  GROUP BY 1)"""


@query(f"""WITH {ACKED}, q AS (
  SELECT f.finding_id, f.run_id, f.product_id, p.name, f.verdict, f.severity, f.match_method, f.confidence, coalesce(k.region_count, 0)::BIGINT AS region_count, coalesce(k.acknowledged, false) AS acknowledged
  FROM b_findings f LEFT JOIN acked k USING (finding_id) LEFT JOIN b_products p USING (product_id)
  WHERE f.verdict IN ('STALE_VERSION', 'ERROR') AND NOT coalesce(k.acknowledged, false))
SELECT *, row_number() OVER (ORDER BY {SRANK.format("severity")} DESC, {VRANK.format("verdict")} DESC, product_id, finding_id)::BIGINT AS place, count(*) OVER ()::BIGINT AS total FROM q
ORDER BY place OFFSET 40 LIMIT 50""")
def review_queue_page(t):
    """A page of the queue with the total."""
    rows = R.queue_filter(t.b_findings, verdicts=["STALE_VERSION", "ERROR"])
    rows = R.queue_filter(R.with_acknowledgement(rows, t.b_regions, t.b_acks), acknowledged=False)
    rows = rows.join(t.b_products.select("product_id", "name"), "product_id", "left")
    top = R.page(rows, R.queue_order(), 40, 50)
    return top.select("finding_id", "run_id", "product_id", "name", "verdict", "severity", "match_method", "confidence", "region_count", "acknowledged", "place", "total")


@query(f"""WITH {ACKED}
SELECT f.finding_id, f.product_id FROM b_findings f JOIN acked k USING (finding_id)
WHERE f.verdict = 'STALE_VERSION' AND f.severity = 'MATERIAL' AND NOT k.acknowledged
UNION ALL SELECT f.finding_id, f.product_id FROM b_findings f WHERE f.verdict = 'STALE_VERSION' AND f.severity = 'MATERIAL' AND f.finding_id NOT IN (SELECT finding_id FROM acked)""")
def default_queue(t):
    """Stale, material and not signed off."""
    rows = R.queue_filter(t.b_findings, verdicts=["STALE_VERSION"], severities=["MATERIAL"])
    return R.queue_filter(R.with_acknowledgement(rows, t.b_regions, t.b_acks), acknowledged=False).select("finding_id", "product_id")


@query("""SELECT run_id, verdict, severity, count(*)::BIGINT AS n FROM b_findings GROUP BY ALL""")
def run_summary(t):
    """G1: counts by verdict and severity (the maps of R.run_summary as rows)."""
    return t.b_findings.groupBy("run_id", "verdict", "severity").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT run_id, verdict, count(*) AS n FROM b_findings GROUP BY ALL), s AS (SELECT run_id, severity, count(*) AS n FROM b_findings GROUP BY ALL)
SELECT v.run_id, string_agg(verdict || '=' || v.n, ',' ORDER BY verdict) AS verdicts, any_value(x.severities) AS severities FROM v
JOIN (SELECT run_id, string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities FROM s GROUP BY 1) x USING (run_id) GROUP BY 1""")
def run_summary_maps(t):
    """G1: the same as maps, written out."""

    def text(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    return R.run_summary(t.b_findings).select("run_id", text("by_verdict").alias("verdicts"), text("by_severity").alias("severities"))


@query("""SELECT run_id, coalesce(passed, 0)::BIGINT AS passed, coalesce(stale, 0)::BIGINT AS stale, coalesce(unknown, 0)::BIGINT AS unknown, coalesce(errors, 0)::BIGINT AS errors, coalesce(material, 0)::BIGINT AS material
FROM (SELECT run_id FROM b_runs WHERE status = 'COMPLETE' ORDER BY run_id DESC LIMIT 6) r LEFT JOIN (
  SELECT run_id, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'STALE_VERSION') AS stale, count(*) FILTER (verdict = 'UNKNOWN_IMAGE') AS unknown,
         count(*) FILTER (verdict = 'ERROR') AS errors, count(*) FILTER (severity = 'MATERIAL') AS material FROM b_findings GROUP BY 1) f USING (run_id)""")
def trend_last6(t):
    """The last six complete runs."""
    return R.trend(t.b_findings, t.b_runs)


@query(f"""WITH {ACKED} SELECT f.run_id, count(*)::BIGINT AS awaiting FROM b_findings f LEFT JOIN acked k USING (finding_id)
WHERE f.verdict <> 'PASS' AND NOT coalesce(k.acknowledged, false) AND f.run_id = (SELECT max(run_id) FROM b_runs WHERE status = 'COMPLETE') GROUP BY 1""")
def awaiting_review(t):
    """What is left to review in the latest run; findings without regions always count."""
    latest = t.b_runs.filter("status = 'COMPLETE'").agg(F.max("run_id").alias("run_id"))
    rows = R.with_acknowledgement(t.b_findings.filter("verdict <> 'PASS'").join(latest, "run_id"), t.b_regions, t.b_acks)
    return rows.filter("not acknowledged").groupBy("run_id").agg(F.count("*").alias("awaiting"))


@query("""SELECT (SELECT count(*) FROM b_products)::BIGINT AS products, (SELECT count(*) FROM b_versions)::BIGINT AS versions, (SELECT max(run_id) FROM b_runs)::BIGINT AS latest_run""")
def global_counts(t):
    """G2 G5."""
    parts = [t.b_products.agg(F.count("*").alias("n")).withColumn("k", F.lit("p")), t.b_versions.agg(F.count("*").alias("n")).withColumn("k", F.lit("v")), t.b_runs.agg(F.max("run_id").cast("long").alias("n")).withColumn("k", F.lit("r"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(a) for k, a in (("p", "products"), ("v", "versions"), ("r", "latest_run"))])


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {SRANK.format("severity")} DESC, finding_id) AS n, count(*) OVER (PARTITION BY product_id) AS c
  FROM b_findings WHERE verdict <> 'PASS' AND run_id = (SELECT max(run_id) FROM b_runs WHERE status = 'COMPLETE'))
SELECT p.product_id, p.name, coalesce(o.c, 0)::BIGINT AS open_findings, o.finding_id AS worst_finding, o.severity AS worst_severity FROM b_products p LEFT JOIN o ON o.product_id = p.product_id AND o.n = 1""")
def products_latest(t):
    """Open and worst findings of each product in the latest complete run."""
    latest = t.b_runs.filter("status = 'COMPLETE'").agg(F.max("run_id").alias("run_id"))
    return R.open_by_product(t.b_findings.join(latest, "run_id", "left_semi"), t.b_products)


@query("""SELECT product_id, name, brand FROM b_products WHERE name ILIKE '%re%' OR CAST(product_id AS VARCHAR) ILIKE '%re%' OR brand ILIKE '%re%' ORDER BY product_id LIMIT 500""")
def product_search(t):
    """P3 O10."""
    return R.search(t.b_products, "re").select("product_id", "name", "brand")


@query(f"""SELECT finding_id, count(*)::BIGINT AS regions, CASE max({SRANK.format("severity")}) WHEN 3 THEN 'MATERIAL' WHEN 2 THEN 'UNCERTAIN' WHEN 1 THEN 'COSMETIC' ELSE 'NONE' END AS worst FROM b_regions GROUP BY 1""")
def region_counts(t):
    """G7 G8."""
    return R.region_counts(t.b_regions)


@query(f"""SELECT product_id, CASE coalesce(max(CASE WHEN severity = 'COSMETIC' THEN 1 WHEN severity = 'NONE' THEN 0 WHEN severity = 'MATERIAL' THEN 3 ELSE 2 END), 0) WHEN 3 THEN 'MATERIAL' WHEN 2 THEN 'UNCERTAIN' WHEN 1 THEN 'COSMETIC' ELSE 'NONE' END AS worst
FROM (SELECT product_id, CASE WHEN finding_id % 11 = 0 THEN 'STRANGE' ELSE severity END AS severity FROM b_findings) GROUP BY 1""")
def severity_rollup(t):
    """Unlisted severities count as uncertain."""
    odd = t.b_findings.withColumn("severity", F.when(F.col("finding_id") % 11 == 0, "STRANGE").otherwise(F.col("severity")))
    return odd.groupBy("product_id").agg(V.worst_severity("severity").alias("worst"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN e THEN 'ERROR' WHEN m IS NULL THEN 'UNKNOWN_IMAGE' WHEN m = c OR sm = sc THEN 'PASS' ELSE 'STALE_VERSION' END AS verdict,
  CASE WHEN e OR m IS NULL THEN 'UNCERTAIN' WHEN m = c OR sm = sc THEN 'NONE' WHEN l_quantity > 30 THEN 'MATERIAL' WHEN l_quantity > 15 THEN 'UNCERTAIN' WHEN l_quantity > 5 THEN 'COSMETIC' ELSE 'NONE' END AS severity
FROM (SELECT *, l_linenumber = 7 AS e, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_partkey % 5 END AS m, l_suppkey % 5 AS c, l_partkey % 3 AS sm, l_suppkey % 3 AS sc FROM lineitem)""")
def verdict_decide(t):
    """F7 P11."""
    q = F.col("l_quantity")
    deltas = F.filter(F.array(F.when(q > 5, "COSMETIC"), F.when(q > 15, "STRANGE"), F.when(q > 30, "MATERIAL")), lambda s: s.isNotNull())
    rows = t.lineitem.withColumn("m", F.when(F.col("l_returnflag") != "A", F.col("l_partkey") % 5)).withColumn("c", F.col("l_suppkey") % 5)
    d = V.decide("m", "c", F.col("l_partkey") % 3, F.col("l_suppkey") % 3, deltas, F.col("l_linenumber") == 7)
    return rows.withColumn("d", d).select("l_orderkey", "l_linenumber", "d.verdict", "d.severity")


@query("""SELECT l_orderkey, CASE WHEN h = 1 THEN 'IDENTICAL' WHEN h = 2 THEN 'CANNOT_COMPARE' WHEN m > 0 THEN 'DIFFERENT' WHEN u > 0 THEN 'NEEDS_REVIEW' WHEN c > 0 THEN 'MATCH_WITH_COSMETIC_DIFFERENCES' ELSE 'MATCH' END AS verdict
FROM (SELECT l_orderkey, l_orderkey % 9 AS h, count(*) FILTER (l_quantity > 45) AS m, count(*) FILTER (l_discount > 0.08) AS u, count(*) FILTER (l_tax > 0.06) AS c FROM lineitem GROUP BY l_orderkey)""")
def pair_verdict(t):
    """F19."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 45).alias("m"), F.count_if(F.col("l_discount") > 0.08).alias("u"), F.count_if(F.col("l_tax") > 0.06).alias("c"))
    halt = F.when(F.col("l_orderkey") % 9 == 1, "IDENTICAL").when(F.col("l_orderkey") % 9 == 2, "CANNOT_COMPARE")
    return per.select("l_orderkey", V.pair_verdict(halt, "m", "u", "c").alias("verdict"))


@query("""SELECT finding_id, field_key, old_value, severity, count(*)::BIGINT AS areas, min(ordinal)::INTEGER AS first, CASE WHEN count(*) > 1 THEN count(*) || ' areas' END AS note
FROM (SELECT *, CASE WHEN y % 2 = 0 THEN 'a' END AS old_value FROM b_regions) GROUP BY 1, 2, 3, 4""")
def finding_groups(t):
    """By all that is said of a region."""
    says = t.b_regions.withColumns({"old_value": F.when(F.col("y") % 2 == 0, "a"), "new_value": F.lit("b"), "edit_type": F.lit("TEXT"), "from_id": F.lit(1), "to_id": F.lit(2)})
    return R.finding_groups(says).select("finding_id", "field_key", "old_value", "severity", "areas", "first", "note")


@query("""SELECT verdict, count(*)::BIGINT AS n FROM b_findings WHERE run_id = (SELECT max(run_id) FROM b_runs WHERE run_id < (SELECT max(run_id) FROM b_runs) AND status = 'COMPLETE') GROUP BY 1""")
def cli_counts(t):
    """Verdicts of the complete run before the last."""
    last = t.b_runs.agg(F.max("run_id").alias("last"))
    before = t.b_runs.join(F.broadcast(last)).filter("run_id < last and status = 'COMPLETE'").agg(F.max("run_id").alias("run_id"))  # one row
    return t.b_findings.join(before, "run_id", "left_semi").groupBy("verdict").agg(F.count("*").alias("n"))


@query("""SELECT finding_id, product_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY run_id DESC, finding_id DESC) AS n FROM b_findings) WHERE n <= 300""")
def history_page(t):
    """The newest findings of each product."""
    return R.history(t.b_findings).select("finding_id", "product_id", "run_id")


@query(f"""WITH l AS (SELECT l_partkey AS product_id, l_suppkey % 4 AS slot, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_returnflag = 'N' THEN 'ACKNOWLEDGED' ELSE 'WITHDRAWN' END AS decision FROM lineitem)
SELECT product_id, slot, decision, id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, slot ORDER BY ts DESC, id DESC) AS n FROM l) WHERE n = 1""")
def acknowledge_upsert(t):
    """append-only sign-offs, the latest wins."""
    log = t.lineitem.select(F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 4).alias("slot"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_returnflag") == "N", "ACKNOWLEDGED").otherwise("WITHDRAWN").alias("decision"))
    return R.latest_wins(log, ["product_id", "slot"], [F.desc("ts"), F.desc("id")]).select("product_id", "slot", "decision", "id")


@query(f"""WITH r AS (SELECT *, {SIG.format(p="")} AS signature FROM b_regions),
one AS (SELECT product_id, signature, version_id FROM r WHERE finding_id % 3 = 0), two AS (SELECT product_id, signature, version_id FROM r WHERE finding_id % 5 = 0), gone AS (SELECT product_id, signature, version_id FROM r WHERE finding_id % 7 = 0)
SELECT DISTINCT product_id, signature, version_id, CASE WHEN (product_id, signature, version_id) IN (SELECT product_id, signature, version_id FROM two) THEN 'ESCALATED' ELSE 'ACKNOWLEDGED' END AS decision
FROM (SELECT * FROM one UNION SELECT * FROM two) k WHERE (product_id, signature, version_id) NOT IN (SELECT product_id, signature, version_id FROM gone)""")
def acknowledge_cycle(t):
    """findings signed off, others escalated over them, some taken back."""
    regions = t.b_regions
    ids = lambda k: regions.filter(F.col("finding_id") % k == 0).select("finding_id").distinct()
    none = R.signed(regions).select("product_id", "signature", "version_id").withColumn("decision", F.lit("")).filter("false")
    acks = R.acknowledged(R.acknowledged(none, regions, ids(3)), regions, ids(5), "ESCALATED")
    return R.unacknowledged(acks, regions, ids(7)).select("product_id", "signature", "version_id", "decision")


@query("""SELECT DISTINCT verdict, severity, match_method,
  CASE verdict WHEN 'PASS' THEN 'Current' WHEN 'STALE_VERSION' THEN 'Stale artwork' WHEN 'UNKNOWN_IMAGE' THEN 'Not identified' ELSE 'Failed' END AS verdict_label,
  CASE severity WHEN 'NONE' THEN 'None' WHEN 'COSMETIC' THEN 'Cosmetic' WHEN 'UNCERTAIN' THEN 'Uncertain' ELSE 'Material' END AS severity_label,
  CASE match_method WHEN 'HASH_EXACT' THEN 'Exact file match' WHEN 'PIXEL_DIFF' THEN 'Pixel difference' WHEN 'REGION_CHECK' THEN 'Region check' ELSE 'No match' END AS method_label FROM b_findings""")
def display_labels(t):
    """F24."""
    rows = t.b_findings.select("verdict", "severity", "match_method").distinct()
    return rows.withColumns({"verdict_label": V.label("verdict", schema.VERDICT_LABEL), "severity_label": V.label("severity", schema.SEVERITY_LABEL), "method_label": V.label("match_method", schema.METHOD_LABEL)})


@query("""SELECT DISTINCT field_key, CASE WHEN field_key IS NULL THEN 'Unmapped region' ELSE 'Field ' || split_part(field_key, '_', 2) || ' (mg)' END AS label FROM b_regions""")
def field_labels(t):
    """X22."""
    return t.b_regions.select("field_key").distinct().withColumn("label", V.field_label("field_key"))


@query(f"""SELECT finding_id, ordinal, {SIG.format(p="")} AS signature FROM b_regions""")
def region_signature(t):
    """F1."""
    return R.signed(t.b_regions).select("finding_id", "ordinal", "signature")


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A')::BIGINT AS n, printf('%d%%', (floor(100.0 * count(*) FILTER (l_returnflag = 'A') / count(*) + 0.5))::BIGINT) AS share, CASE WHEN min(l_quantity) > 45 THEN '—' WHEN sum(l_quantity) < 60 THEN floor(sum(l_quantity) + 0.5)::BIGINT || 's' ELSE floor(sum(l_quantity) / 60)::BIGINT || 'm ' || lpad((floor(sum(l_quantity) % 60 + 0.5))::BIGINT::VARCHAR, 2, '0') || 's' END AS took
FROM lineitem GROUP BY 1""")
def report_labels(t):
    """shares and durations as they are shown."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("n"), F.count("*").alias("m"), F.when(F.min("l_quantity") <= 45, F.sum("l_quantity")).alias("s"))
    return per.select("l_orderkey", "n", V.percent("n", "m").alias("share"), V.duration("s").alias("took"))


def _cases(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(f"""SELECT method, {_cases("method", schema.METHOD_LABEL)} AS label, {_cases("method", schema.METHOD_HINT)} AS hint, count(*)::BIGINT AS n
FROM (SELECT CASE WHEN finding_id % 9 = 0 THEN 'CACHED' ELSE match_method END AS method FROM b_findings) GROUP BY 1""")
def method_labels(t):
    """methods with their hints; carried findings are unchanged."""
    method = F.when(F.col("finding_id") % 9 == 0, "CACHED").otherwise(F.col("match_method"))
    per = t.b_findings.groupBy(method.alias("method")).agg(F.count("*").alias("n"))
    return per.select("method", V.label("method", schema.METHOD_LABEL).alias("label"), V.label("method", schema.METHOD_HINT).alias("hint"), "n")


@query(f"""WITH {ACKED} SELECT f.finding_id, f.verdict, f.severity, p.name, coalesce(k.acknowledged, false) AS acknowledged, coalesce(k.region_count, 0)::BIGINT AS region_count, r.status AS run_status, coalesce(x.fields, '') AS fields
FROM b_findings f LEFT JOIN acked k USING (finding_id) LEFT JOIN b_products p USING (product_id) LEFT JOIN b_runs r USING (run_id)
LEFT JOIN (SELECT finding_id, string_agg(coalesce(field_key, '-'), ',' ORDER BY ordinal) AS fields FROM b_regions GROUP BY 1) x USING (finding_id)""")
def finding_details(t):
    """Each finding with its product, run, sign-off and regions."""
    out = R.finding_details(t.b_findings, t.b_regions, t.b_acks, t.b_products, t.b_runs)
    fields = F.array_join(F.transform("regions", lambda r: F.coalesce(r["field_key"], F.lit("-"))), ",")
    return out.select("finding_id", "verdict", "severity", "name", "acknowledged", "region_count", "run_status", fields.alias("fields"))
