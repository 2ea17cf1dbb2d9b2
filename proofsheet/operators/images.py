"""Jobs over decoded images: reference regions, identification of listings, calibration.

Listings and versions of a product meet in sorted partitions and go by one at a time: a task holds the versions
of one product beside one batch of listings. Products with many listings are salted. What is decoded is decoded
once: comparisons are a stored table, and decisions one aggregate over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.config import Identify
from proofsheet.functions.boxes import box, map_to_probe
from proofsheet.functions.verdict import decide, margin_confidence, margin_gate
from proofsheet.kernels import compare as K
from proofsheet.kernels import geometry as G
from proofsheet.kernels import pictures as P
from proofsheet.kernels import regions as R
from proofsheet.sources.versioned import Store
from proofsheet.tables import stored

from .versions import consecutive, match_edits, path_regions

PER_GROUP = 64
REGIONS = "product_id string, from_id long, to_id long, x int, y int, w int, h int, area_fraction double"
COMPARED = "probe_id long, product_id string, candidate_id long, fraction double, error string, signals array<double>"


def _rgb(image: dict) -> np.ndarray:
    return G.to_rgb(image["height"], image["width"], image["nChannels"], image["data"])


def _content(image: dict, s: Identify) -> np.ndarray:
    rgb = _rgb(image)
    return G.extract(rgb, G.content_rect(rgb, s.border_uniform_tolerance, s.max_border_crop_fraction))


def reference_regions(versions: DataFrame, settings: Identify | None = None) -> DataFrame:
    """Regions in which consecutive versions of a product differ (REGIONS), coarse changes as one.

    versions: product_id, version_id, image. Each pair of versions is one row of an Arrow batch.
    """
    s = settings or Identify()
    pairs = consecutive(versions, "image").select("product_id", "from_id", "to_id", "from_image", "to_image")

    def regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in REGIONS.split(", ")]
        for f in frames:
            rows = []
            for r in f.itertuples():
                a, b = _rgb(r.from_image), _rgb(r.to_image)
                b, a, _ = G.prepared(b, a) if a.shape != b.shape else (b, a, 1.0)
                score = K.score(a, b, s.reference_luma_threshold, s.reference_chroma_threshold, 0)
                mask = R.closed(K.changed(score, 1.0, s.region_morph_open), (s.morph_close,) * 2)
                total = mask.size
                found = R.boxes(mask, s.min_region_area_fraction * total)
                if len(found) >= s.global_change_min_regions:
                    x0, y0 = min(b[0] for b in found), min(b[1] for b in found)
                    x1, y1 = max(b[0] + b[2] for b in found), max(b[1] + b[3] for b in found)
                    if (x1 - x0) * (y1 - y0) / total >= s.global_change_area_fraction:
                        found = [(x0, y0, x1 - x0, y1 - y0, 0)]
                rows += [(r.product_id, r.from_id, r.to_id, x, y, w, h, w * h / total) for x, y, w, h, _ in found]
            yield pd.DataFrame(rows, columns=names)

    return pairs.mapInPandas(regions, REGIONS)


def with_edits(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions with what the known edit they belong to says; MATERIAL, without a field, if none does.

    edits: product_id, from_id, to_id, edit_pos, x, y, w, h, field_key, old_value, new_value, edit_type, severity.
    """
    keys = ["product_id", "from_id", "to_id"]
    w = Window.partitionBy(*keys).orderBy("y", "x", "w", "h")
    numbered = regions.withColumn("ordinal", F.row_number().over(w))
    ident = F.xxhash64(*keys, "ordinal")
    boxed = numbered.select(*keys, ident.alias("region_id"), box("x", "y", "w", "h").alias("box"))
    known = edits.select(*keys, "edit_pos", box("x", "y", "w", "h").alias("edit_box"))
    best = match_edits(boxed, known, keys)
    says = edits.select(*keys, "edit_pos", "field_key", "old_value", "new_value", "edit_type", "severity")
    out = numbered.withColumn("region_id", ident).join(best, "region_id", "left").join(says, [*keys, "edit_pos"], "left")
    return out.withColumn("severity", F.coalesce("severity", F.lit("MATERIAL")))


def compared(probes: DataFrame, versions: DataFrame, regions: DataFrame, settings: Identify | None = None) -> DataFrame:
    """Changed fraction of each probe against one version of each content, and the signal in each region (COMPARED).

    probes: probe_id, product_id, image; versions: product_id, version_id, sha, image; regions: product_id, x, y, w, h.
    """
    s = settings or Identify()
    n = probes.groupBy("product_id").agg(F.ceil(F.count("*") / PER_GROUP).cast("int").alias("salts"))
    first = versions.groupBy("product_id", "sha").agg(F.min_by(F.struct("version_id", "image"), "version_id").alias("v"))
    boxes = regions.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "w", "h"))).alias("boxes"))
    left = probes.join(n, "product_id").select("product_id", F.pmod(F.xxhash64("probe_id"), "salts").cast("int").alias("salt"), F.lit(1).alias("part"), F.col("probe_id").alias("id"), "image", F.lit(None).cast("array<struct<y:int,x:int,w:int,h:int>>").alias("boxes"))
    right = first.select("product_id", "v.*").join(n, "product_id").join(boxes, "product_id", "left").select("product_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"), F.col("version_id").alias("id"), "image", F.col("boxes").cast("array<struct<y:int,x:int,w:int,h:int>>").alias("boxes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COMPARED.split(", ")]
        group, refs, held = None, {}, []
        for f in frames:
            rows = []
            for r in f.itertuples():
                if (r.product_id, r.salt) != group:
                    group, refs, held = (r.product_id, r.salt), {}, []
                if r.part == 0:
                    refs[r.id] = G.Sized(_content(r.image, s))
                    held = [] if r.boxes is None else list(r.boxes)
                    continue
                try:
                    probe = G.Sized(_content(r.image, s))
                    for vid, ref in refs.items():
                        score, scale = K.score_of(probe, ref, s.luma_threshold, s.chroma_threshold, s.tolerance_radius)
                        scaled = [tuple(int(round(b[c] * scale)) for c in ("x", "y", "w", "h")) for b in held]
                        rows.append((r.id, r.product_id, vid, float(K.changed(score, 1.0, s.morph_open).mean()), None, [K.signal(score, b, s.region_signal_cap, s.region_signal_top_fraction) for b in scaled]))
                except Exception as e:  # an image that can't be read is an ERROR finding, not the end of the run
                    rows.append((r.id, r.product_id, None, None, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=names).astype({"candidate_id": "Int64"})

    both = left.unionByName(right).repartition("product_id", "salt").sortWithinPartitions("product_id", "salt", "part", "image.height", "image.width", "id")  # one size after the other
    return both.mapInPandas(run, COMPARED)


#: Images in one Arrow batch, while they are decoded.
BATCH_IMAGES = "16"


def measured(df: DataFrame, name: str) -> DataFrame:
    """df, whose plan decodes images, computed once with few images in a batch, as a table in the shared folder."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, BATCH_IMAGES)
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def decided(seen: DataFrame, s: Identify) -> DataFrame:
    """probe_id, matched_id, confidence, method of each probe in `seen` (COMPARED), in one aggregate.

    In this order: an image that can't be read is an ERROR; one version alone under the clean limit; the version that
    leads in the regions' signals, among the clean ones if there are several; the only version, if it is near enough.
    """
    limit = s.single_candidate_accept_below or s.clean_fraction
    total = F.aggregate("signals", F.lit(0.0), lambda a, v: a + v)
    one = F.struct("fraction", "candidate_id", F.when(F.size("signals") > 0, total).alias("total"))
    per = seen.groupBy("probe_id").agg(F.max("error").alias("error"), F.sort_array(F.collect_list(F.when(F.col("error").isNull(), one))).alias("c"))
    clean = F.filter("c", lambda c: c["fraction"] < s.clean_fraction)
    per = per.withColumns({"clean": clean, "pool": F.when(F.size(clean) > 1, clean).otherwise(F.col("c"))})
    line = F.array_sort(F.transform(F.filter("pool", lambda c: c["total"].isNotNull()), lambda c: F.struct(c["total"].alias("total"), c["candidate_id"].alias("candidate_id"))))
    per = per.withColumn("line", line)
    first, second = F.get("line", F.lit(0)), F.get("line", F.lit(1))
    only = F.get("c", F.lit(0))

    def says(match: Column | None, confidence: Column, method: str) -> Column:
        return F.struct((F.lit(None) if match is None else match).cast("long").alias("matched_id"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"))

    found = (
        F.when(F.col("error").isNotNull(), says(None, F.lit(0.0), "ERROR"))
        .when(F.size("clean") == 1, says(F.get("clean", F.lit(0))["candidate_id"], 1 - only["fraction"], "PIXEL_DIFF"))
        .when(F.coalesce(margin_gate(first["total"], second["total"], s.region_margin_ratio), F.lit(False)), says(first["candidate_id"], margin_confidence(first["total"], second["total"]), "REGION_CHECK"))
        .when((F.size("c") == 1) & (only["fraction"] < limit), says(only["candidate_id"], 1 - only["fraction"], "PIXEL_DIFF"))
        .otherwise(says(None, F.lit(0.0), "NONE"))
    )
    return per.select("probe_id", found.alias("f")).select("probe_id", "f.*")


def identify(probes: DataFrame, versions: DataFrame, regions: DataFrame, settings: Identify | None = None) -> DataFrame:
    """Matched version of each probe by hash, whole image, regions or lone candidate; refused if none decides.

    probes: probe_id, product_id, sha, image. Decoding starts after the hash stage, and each image is decoded once.
    """
    s = settings or Identify()
    exact = probes.join(versions.groupBy("product_id", "sha").agg(F.min("version_id").alias("matched_id")), ["product_id", "sha"])
    exact = stored(exact.select("probe_id", "matched_id", F.lit(1.0).alias("confidence"), F.lit("HASH_EXACT").alias("method")), "exact")
    rest = probes.join(exact.select("probe_id"), "probe_id", "left_anti")
    seen = measured(compared(rest, versions, regions, s), "compared")
    decided_ = decided(seen, s)
    # products without versions leave nothing to compare with
    lost = rest.select("probe_id").join(seen.select("probe_id"), "probe_id", "left_anti").selectExpr("probe_id", "cast(null as bigint) as matched_id", "0.0D as confidence", "'NONE' as method")
    return exact.unionByName(decided_).unionByName(lost)


BOX = "struct<x:int,y:int,w:int,h:int>"
#: The fields of a delta.
DELTA = f"struct<region_id:bigint,from_id:bigint,to_id:bigint,field_key:string,old_value:string,new_value:string,edit_type:string,severity:string,area_fraction:double,box:{BOX},scraped_box:{BOX}>"


def listing_findings(identified: DataFrame, probes: DataFrame, versions: DataFrame, regions: DataFrame) -> DataFrame:
    """What a run finds of each listing: probe_id, product_id, verdict, severity, matched_id, current_id, confidence, method, deltas.

    versions: product_id, version_id, sha, is_current, pos; regions: those of consecutive versions with their edits
    (with_edits); probes: probe_id, product_id and the content's rectangle in the listing (cx, cy, cw, ch) and the size of its
    reference (rw, rh). A stale listing gets the deltas (DELTA) on its way from the matched to the current version, each
    with the box in the listing; versions with the same bytes as the current one are current.
    """
    v = versions.select("product_id", F.col("version_id").alias("id_"), "sha", "pos")
    current = versions.filter("is_current").select("product_id", F.col("version_id").alias("current_id"), F.col("sha").alias("current_sha"), F.col("pos").alias("j"))
    rows = identified.join(probes.select("probe_id", "product_id", "cx", "cy", "cw", "ch", "rw", "rh"), "probe_id").join(current, "product_id", "left")
    rows = rows.join(v.withColumnsRenamed({"id_": "matched_id", "sha": "matched_sha", "pos": "i"}), ["product_id", "matched_id"], "left")
    same = (F.col("matched_id") == F.col("current_id")) | (F.col("matched_sha") == F.col("current_sha"))
    stale = rows.filter(F.col("matched_id").isNotNull() & ~F.coalesce(same, F.lit(False)))
    places = v.select("product_id", "id_", "pos")
    hops = regions.join(places.withColumnsRenamed({"id_": "from_id", "pos": "from_pos"}), ["product_id", "from_id"]).join(places.withColumnsRenamed({"id_": "to_id", "pos": "to_pos"}), ["product_id", "to_id"])
    met = path_regions(hops, stale.withColumnRenamed("probe_id", "finding_id"))
    here, there = box("x", "y", "w", "h"), map_to_probe(box("x", "y", "w", "h"), box("cx", "cy", "cw", "ch"), F.col("rw"), F.col("rh"))
    delta = F.struct("region_id", "from_id", "to_id", "field_key", "old_value", "new_value", "edit_type", F.col("severity"), "area_fraction", here.cast(BOX).alias("box"), there.cast(BOX).alias("scraped_box")).cast(DELTA)
    deltas = met.withColumn("d", delta).groupBy(F.col("finding_id").alias("probe_id")).agg(F.array_sort(F.collect_list(F.struct("from_pos", "y", "x", "d"))).alias("l"))
    deltas = deltas.select("probe_id", F.transform("l", lambda x: x["d"]).alias("deltas"))
    out = rows.join(deltas, "probe_id", "left").withColumn("deltas", F.coalesce("deltas", F.array().cast(f"array<{DELTA}>")))
    says = decide("matched_id", "current_id", "matched_sha", "current_sha", F.transform("deltas", lambda d: d["severity"]), F.col("method") == "ERROR")
    return out.withColumn("says", says).select("probe_id", "product_id", "says.verdict", "says.severity", "matched_id", "current_id", "confidence", "method", "deltas")


def noise_samples(pairs: DataFrame, settings: Identify | None = None) -> DataFrame:
    """Luma and colour differences of unchanged and changed pixels: pair_id, changed, luma, chroma.

    pairs: pair_id, probe, reference, boxes (known edits, in reference pixels). One row a pixel:
    percentiles over them are exact aggregates (operators.evaluate).
    """
    s = settings or Identify()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                p, q, scale = G.prepared(_content(r.probe, s), _content(r.reference, s))
                d = K.band(G.ycrcb(p), G.ycrcb(q), s.tolerance_radius)
                inside = np.zeros(d.shape[:2], bool)
                for b in r.boxes if r.boxes is not None else []:
                    x, y, w, h = (int(round(v * scale)) for v in b)
                    inside[y : y + h, x : x + w] = True
                yield pd.DataFrame({"pair_id": r.pair_id, "changed": inside.ravel(), "luma": d[..., 0].ravel().astype(float), "chroma": d[..., 1:].max(-1).ravel().astype(float)})

    return pairs.select("pair_id", "probe", "reference", "boxes").mapInPandas(run, "pair_id long, changed boolean, luma double, chroma double")


def index_corpus(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of each product the listings that aren't byte copies of its artwork: product_id, files (name, path, true label).

    listed: name, path; manifest: name, product_id, label, variant ('copy' for a byte copy).
    """
    rows = manifest.filter("variant <> 'copy'").join(listed.select("name", "path"), "name")
    return rows.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("name", "path", "label"))).alias("files"))


def fraction_report(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """Changed fractions against the true and the other versions by quality and size, and in all (null keys).

    seen: COMPARED; labels: probe_id, true_id, quality, size.
    """
    rows = seen.filter("error is null").join(labels, "probe_id")
    own, other = F.col("candidate_id") == F.col("true_id"), F.col("candidate_id") != F.col("true_id")
    return rows.groupingSets([["quality", "size"], []], "quality", "size").agg(F.count_if(own).alias("images"), F.max(F.when(own, F.col("fraction"))).alias("own_most"), F.min(F.when(other, F.col("fraction"))).alias("other_least"))


def overlays(findings: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, path (overlays/<probe_id>.jpg) and picture (a JPEG file) of each stale listing with its deltas' boxes.

    findings: as listing_findings gives them; probes: probe_id, image.
    """
    rows = findings.filter(F.size("deltas") > 0).select("probe_id", overlay_boxes(F.transform("deltas", lambda d: F.struct(d["scraped_box"]["x"].alias("x"), d["scraped_box"]["y"].alias("y"), d["scraped_box"]["w"].alias("w"), d["scraped_box"]["h"].alias("h"), d["severity"].alias("severity")))).alias("boxes"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"probe_id": f["probe_id"], "path": "overlays/" + f["probe_id"].astype(str) + ".jpg", "picture": [P.overlay(_rgb(i), list(b)) for i, b in zip(f["image"], f["boxes"], strict=True)]})

    return rows.join(probes.select("probe_id", "image"), "probe_id").mapInPandas(draw, "probe_id long, path string, picture binary")


def thumbnails(versions: DataFrame, side: int = 320) -> DataFrame:
    """path (thumbs/<product>/<version>.jpg) and picture (a JPEG file, `side` pixels at most) of each version (product_id, version_id, image)."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": [f"thumbs/{p}/{v}.jpg" for p, v in zip(f["product_id"], f["version_id"], strict=True)], "picture": [P.thumbnail(_rgb(i), side) for i in f["image"]]})

    return versions.select("product_id", "version_id", "image").mapInPandas(draw, "path string, picture binary")


def save_artefacts(store: Store, artefacts: DataFrame, run_id: int) -> int:
    """Put a run's pictures (path, picture) into the store's table `artefacts`, beside those of other runs: the number of the state.

    Paths are relative, so that the table can be moved; Store.expire deletes what only old states name.
    """
    number, document = store.head()
    rows = artefacts.select(store.part_of("path").alias("part"), F.lit(run_id).cast("long").alias("run_id"), "path", "picture")
    schema, folders = store.write(rows, "part")
    before = document["tables"].get("artefacts", {"folders": {}})["folders"]
    named = {f"{p}@{run_id}": f for p, f in folders.items()}
    store.log.publish(number + 1, document | {"tables": document["tables"] | {"artefacts": {"schema": schema, "folders": before | named}}})
    return number + 1


def overlay_boxes(deltas: Column) -> Column:
    """The boxes that a reviewer's overlay shows, with their colour."""
    return F.transform(deltas, lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), d["w"].alias("w"), d["h"].alias("h"), F.when(d["severity"] == "MATERIAL", "red").otherwise("amber").alias("colour")))
