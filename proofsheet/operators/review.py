"""The review screens: queue, acknowledgements, run summaries, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions.verdict import region_signature, severity_rank, verdict_rank, worst_severity


def signature() -> Column:
    return region_signature("product_id", "x", "y", "w", "h", "field_key")


def _place() -> list[Column]:
    """What a signature is made of, and the version: boxes to tens, half to even."""
    tens = [F.bround(F.col(c).cast("long"), -1).cast("long").alias(f"{c}10") for c in "xywh"]
    return ["product_id", "version_id", *tens, F.coalesce("field_key", F.lit("")).alias("field")]


def signed(regions: DataFrame) -> DataFrame:
    return regions.withColumn("signature", signature())


def with_acknowledgement(findings: DataFrame, regions: DataFrame, acks: DataFrame) -> DataFrame:
    """findings with region_count and acknowledged, resolved when read.

    A region is signed off only for the version that is current; a finding counts as
    acknowledged if it has regions and all of them are.
    """
    # only the findings' own regions and their products' decisions; both sides meet on the numbers that signatures hash
    mine = regions.join(findings.select("finding_id"), "finding_id", "left_semi").select("finding_id", *_place())
    valid = acks.filter("decision = 'ACKNOWLEDGED'").select(*_place()).distinct().withColumn("ok", F.lit(True))
    marked = mine.join(valid, [c for c in valid.columns if c != "ok"], "left")
    per = marked.groupBy("finding_id").agg(F.count("*").alias("region_count"), F.every(F.coalesce("ok", F.lit(False))).alias("acknowledged"))
    return findings.join(per, "finding_id", "left").fillna({"region_count": 0, "acknowledged": False})


#: The verdicts a queue can be filtered by.
VERDICTS = ("PASS", "STALE_VERSION", "UNKNOWN_IMAGE", "ERROR")


def queue_filter(findings: DataFrame, verdicts=None, severities=None, product=None, method=None, acknowledged=None) -> DataFrame:
    """All filters given hold together; the one on acknowledged needs that column. An unknown verdict is an error."""
    if unknown := set(verdicts or ()) - set(VERDICTS):
        raise ValueError(f"no such verdict: {', '.join(sorted(unknown))}")
    for c, values in (("verdict", verdicts), ("severity", severities)):
        if values:
            findings = findings.filter(F.col(c).isin(list(values)))
    for c, value in (("product_id", product), ("match_method", method), ("acknowledged", acknowledged)):
        if value is not None:
            findings = findings.filter(F.col(c) == value)
    return findings


def queue_order(sort: str = "severity", descending: bool = True) -> list[Column]:
    """The key in the direction asked for, then always product and id ascending; an unknown key is severity."""
    keys = {
        "severity": [severity_rank("severity"), verdict_rank("verdict")],
        "verdict": [verdict_rank("verdict")],
        "product": [F.col("product_id")],
        "confidence": [F.col("confidence")],
        "regions": [F.col("region_count")],
        "id": [F.col("finding_id")],
    }
    lead = keys.get(sort, keys["severity"])
    return [k.desc() if descending else k.asc() for k in lead] + [F.col("product_id").asc(), F.col("finding_id").asc()]


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page, with the place of each row and the total of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(*order).offset(offset).limit(limit)
    # the page is small; its places are numbered after the limit
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long") + offset).join(F.broadcast(total))  # one row


def run_summary(findings: DataFrame) -> DataFrame:
    """Counts by verdict and severity in each run, as maps."""

    def counts(c: str) -> DataFrame:
        n = findings.groupBy("run_id", c).agg(F.count("*").alias("n"))
        return n.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))

    return counts("verdict").join(counts("severity"), "run_id")


def trend(findings: DataFrame, runs: DataFrame, last: int = 6) -> DataFrame:
    """The last complete runs, oldest first, with five counts."""
    recent = runs.filter("status = 'COMPLETE'").orderBy(F.col("run_id").desc()).limit(last).select("run_id")
    n = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    v = F.col("verdict")
    per = findings.join(F.broadcast(recent), "run_id").groupBy("run_id").agg(  # `last` rows
        n(v == "PASS").alias("passed"), n(v == "STALE_VERSION").alias("stale"), n(v == "UNKNOWN_IMAGE").alias("unknown"), n(v == "ERROR").alias("errors"), n(F.col("severity") == "MATERIAL").alias("material")
    )
    return recent.join(per, "run_id", "left").fillna(0).orderBy("run_id")


def open_by_product(findings: DataFrame, products: DataFrame) -> DataFrame:
    """Products with the number of open findings and the worst one of a run's findings (the first of equals)."""
    latest = findings.filter(F.col("verdict") != "PASS")
    worst = F.max_by(F.struct("finding_id", "verdict", "severity"), F.struct(severity_rank("severity"), -F.col("finding_id")))
    per = latest.groupBy("product_id").agg(F.count("*").alias("open_findings"), worst.alias("worst"))
    out = products.join(per, "product_id", "left")
    return out.select("product_id", "name", F.coalesce("open_findings", F.lit(0)).alias("open_findings"), F.col("worst.finding_id").alias("worst_finding"), F.col("worst.severity").alias("worst_severity"))


#: Findings that a product's history and a run's page show at most.
HISTORY_LIMIT = 300


def history(findings: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The newest findings of each product, `limit` of them."""
    w = Window.partitionBy("product_id").orderBy(F.desc("run_id"), F.desc("finding_id"))
    return findings.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= limit).drop("n_")


def search(products: DataFrame, text: str, limit: int = 500) -> DataFrame:
    """Case-insensitive search in name, id and brand; % and _ keep their meaning in patterns."""
    hit = F.lit(False)
    for c in ("name", "product_id", "brand"):
        hit = hit | F.col(c).cast("string").ilike(f"%{text}%")
    return products.filter(hit).orderBy("product_id").limit(limit)


def finding_groups(regions: DataFrame) -> DataFrame:
    """Regions of a finding that say the same, with their number, in order of first sight."""
    per = regions.groupBy("finding_id", "field_key", "old_value", "new_value", "severity", "edit_type", "from_id", "to_id").agg(F.count("*").alias("areas"), F.min("ordinal").alias("first"))
    return per.withColumn("note", F.when(F.col("areas") > 1, F.concat(F.col("areas").cast("string"), F.lit(" areas"))))


def latest_wins(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Append-only decisions: the last one of each key holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def region_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("finding_id").agg(F.count("*").alias("regions"), worst_severity("severity").alias("worst"))


DECISIONS = ("ACKNOWLEDGED", "ESCALATED")


def acknowledged(acks: DataFrame, regions: DataFrame, finding_ids: DataFrame, decision: str = "ACKNOWLEDGED", note: str = "", created_by: str = "reviewer") -> DataFrame:
    """acks with a decision on every region of the findings: known keys are overwritten, new ones added; findings without regions add none."""
    if decision not in DECISIONS:
        raise ValueError(f"decision must be one of {', '.join(DECISIONS)}")
    key = ["product_id", "signature", "version_id"]
    new = signed(regions.join(finding_ids, "finding_id", "left_semi")).select(*key).distinct()
    new = new.withColumns({"decision": F.lit(decision), "note": F.lit(note), "created_by": F.lit(created_by)})
    return acks.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def unacknowledged(acks: DataFrame, regions: DataFrame, finding_ids: DataFrame) -> DataFrame:
    """acks without those on the findings' regions."""
    gone = signed(regions.join(finding_ids, "finding_id", "left_semi")).select("product_id", "signature", "version_id").distinct()
    return acks.join(gone, ["product_id", "signature", "version_id"], "left_anti")


def reaped(runs: DataFrame, active: list[int] | None = None) -> DataFrame:
    """Runs left RUNNING by a process that is gone count as FAILED."""
    stale = (F.col("status") == "RUNNING") & ~F.col("run_id").isin(active or [])
    return runs.withColumn("status", F.when(stale, "FAILED").otherwise(F.col("status")))


def upload_checks(listed: DataFrame, most_bytes: int = 40 << 20) -> DataFrame:
    """Uploads with a reason of refusal, null if there is none: kind of file, size, emptiness."""
    known = F.lower("name").rlike(r"\.(png|jpe?g|webp|bmp|gif|tiff)$")
    return listed.withColumn("refused", F.when(~known, "suffix").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large"))


def preflight(images: DataFrame, crop_warn: float = 0.02, aspect_warn: float = 0.01) -> DataFrame:
    """Warnings on images (product_id, width, height, x, y, w, h of the content): much border, mixed sizes, odd aspect."""
    from pyspark.sql import Window

    w = Window.partitionBy("product_id")
    cropped = 1 - F.col("w") * F.col("h") / (F.col("width") * F.col("height"))
    sizes = F.size(F.collect_set(F.struct("width", "height")).over(w))
    aspect = F.col("w") / F.col("h")
    off = F.abs(aspect / F.median(aspect).over(w) - 1)
    return images.withColumns({"cropped": F.greatest(F.lit(0.0), cropped), "much_border": cropped > crop_warn, "mixed_sizes": sizes > 1, "odd_aspect": off > aspect_warn})


def reference_checks(transitions: DataFrame, clean_fraction: float) -> DataFrame:
    """Per product, of its transitions (product_id, n_regions, fraction): how many show no region, how many unchanged images lie over the clean cutoff, how many are warned of."""
    bare, noisy = F.col("n_regions") == 0, F.col("fraction") >= clean_fraction
    return transitions.groupBy("product_id").agg(F.count_if(bare).alias("without_regions"), F.count_if(noisy).alias("over_cutoff"), F.count_if(bare | noisy).alias("warned"))


def finding_details(findings: DataFrame, regions: DataFrame, acks: DataFrame, products: DataFrame, runs: DataFrame) -> DataFrame:
    """findings with product, run status, sign-off and their regions in order: what a finding's page shows."""
    per = regions.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "x", "y", "w", "h", "field_key", "severity"))).alias("regions"))
    rows = with_acknowledgement(findings, regions, acks).join(per, "finding_id", "left")
    rows = rows.join(products.select("product_id", "name"), "product_id", "left").join(runs.select("run_id", F.col("status").alias("run_status")), "run_id", "left")
    return rows.withColumn("regions", F.coalesce("regions", F.array().cast(per.schema["regions"].dataType)))


def started(runs: DataFrame, run_id: int) -> DataFrame:
    """runs with a new one that is RUNNING; an error if one is running already."""
    busy = [r.run_id for r in runs.filter("status = 'RUNNING'").select("run_id").limit(1).collect()]
    if busy:
        raise RuntimeError(f"run {busy[0]} is still running")
    new = runs.sparkSession.createDataFrame([(run_id, "RUNNING")], "run_id long, status string")
    return runs.unionByName(new, allowMissingColumns=True)


def labelled(findings: DataFrame, labels: dict[int, str], key: str = "product_id") -> DataFrame:
    """findings with a label given by hand, null where there is none."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<bigint,string>")
    return findings.withColumn("label", F.try_element_at(names, F.col(key)))
