"""Artwork and listing directories as tables, and the tables that results go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsheet.functions.text import natural_key

SUFFIXES = "{png,jpg,jpeg,webp,bmp,gif,tiff,PNG,JPG,JPEG,WEBP,BMP,GIF,TIFF}"
MANIFEST = "file string, product_id string"
TRUTH = "versions:array<string>,current:string,files:map<string,string>,approved_at:map<string,string>,transitions:map<string,array<struct<type:string,field:string,old:string,new:string,box:array<int>,severity:string>>>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a folder: path, name, sha, length, modified, content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{SUFFIXES}").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"), "length", F.col("modificationTime").alias("modified"), "content")


def run_inputs(listed: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Listing files with their product: by the manifest, else by the part of the name before `__`."""
    product = F.when(F.col("name").contains("__"), F.split_part("name", F.lit("__"), F.lit(1)))
    if manifest is None:
        return listed.withColumn("product_id", product)
    named = manifest.select(F.col("file").alias("name"), F.col("product_id").alias("m_"))
    return listed.join(named, "name", "left").withColumn("product_id", F.coalesce("m_", product)).drop("m_")


def image_size(content: Column) -> Column:
    """Width and height (a struct) from a file's first bytes, without decoding: PNG, GIF and BMP by place, JPEG by its frame header; null for others."""

    def number(at: int, n: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")

    def little(at: int, n: int) -> Column:
        return sum((F.conv(F.hex(F.substring(content, at + i, 1)), 16, 10).cast("int") * 256**i for i in range(1, n)), F.conv(F.hex(F.substring(content, at, 1)), 16, 10).cast("int"))

    def both(w: Column, h: Column) -> Column:
        return F.struct(w.alias("width"), h.alias("height"))

    head = F.hex(F.substring(content, 1, 8))
    # segments before the frame header hold no marker of one outside their length; the first match after a whole marker is it
    frame = F.regexp_extract(F.hex(F.substring(content, 1, 1 << 16)), "^FFD8(?:..)*?FFC[012]0[0-9A-F]{3}08([0-9A-F]{4})([0-9A-F]{4})", 1)
    wide = F.regexp_extract(F.hex(F.substring(content, 1, 1 << 16)), "^FFD8(?:..)*?FFC[012]0[0-9A-F]{3}08([0-9A-F]{4})([0-9A-F]{4})", 2)
    jpeg = F.when(frame != "", both(F.conv(wide, 16, 10).cast("int"), F.conv(frame, 16, 10).cast("int")))
    return F.when(head == "89504E470D0A1A0A", both(number(17, 4), number(21, 4))).when(head.startswith("47494638"), both(little(7, 2), little(9, 2))).when(head.startswith("424D"), both(little(19, 4), F.abs(little(23, 4)))).when(head.startswith("FFD8"), jpeg)


def save_table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Write one of the model's tables (runs, findings, regions, acknowledgements, stages); with a partition column only its values are replaced."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def save_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def paired(listed: DataFrame) -> DataFrame:
    """Files (id, name) named `ref__<key>.<suffix>` and `mkt__<key>.<suffix>`: key, ref, mkt (the first id of each side), the side that is missing."""
    pattern = r"^(ref|mkt)__(.+)\.\w+$"
    named = listed.select("id", F.regexp_extract("name", pattern, 1).alias("side"), F.regexp_extract("name", pattern, 2).alias("key")).filter("side <> ''")
    both = named.groupBy("key").agg(*[F.min(F.when(F.col("side") == s, F.col("id"))).alias(s) for s in ("ref", "mkt")])
    return both.withColumn("missing", F.when(F.col("mkt").isNull(), "mkt").when(F.col("ref").isNull(), "ref"))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: path and the struct of Spark's image source."""
    raw = spark.read.format("image").option("pathGlobFilter", f"*.{SUFFIXES}").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(path)
    return raw.select(F.col("image.origin").alias("path"), "image")


def artwork_versions(listed: DataFrame) -> DataFrame:
    """Versions of products from `<product>/<label>.<suffix>`, in natural order; the last label is current."""
    parts = F.split("path", "/")
    rows = listed.select("*", F.element_at(parts, -2).alias("product_id"), F.regexp_extract("name", r"^(.+)\.\w+$", 1).alias("version_label"))
    w = Window.partitionBy("product_id").orderBy(natural_key(F.col("version_label")), "version_label")
    last = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("position", F.row_number().over(w)).withColumn("is_current", F.last("version_label").over(last) == F.col("version_label"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A document of products by SKU as rows (sku and the fields of TRUTH)."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", f"map<string,struct<{TRUTH}>>")).alias("sku", "t"))
    return pairs.select("sku", "t.*")


def served_url(path: Column, roots: dict[str, str]) -> Column:
    """The address of a file below one of the served roots; null outside them."""
    out = F.lit(None).cast("string")
    for root, prefix in roots.items():
        out = F.when(path.startswith(root.rstrip("/") + "/"), F.concat(F.lit(prefix.rstrip("/")), F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path)))).otherwise(out)
    return out


def save_findings(findings: DataFrame, path: str) -> None:
    """Append a run's findings; a run written again replaces its own rows only."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def without(tables: dict[str, DataFrame], comparison_ids: DataFrame) -> dict[str, DataFrame]:
    """Comparisons and their stages and regions without the given ones."""
    return {name: df.join(comparison_ids, "comparison_id", "left_anti") for name, df in tables.items()}


def versions_template(versions: DataFrame) -> DataFrame:
    """What an override file of each product would say: labels in order, current, approval by file time; write it with `write.json`."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("position", "version_label"))), lambda v: v["version_label"])
    approved = F.map_from_entries(F.collect_list(F.struct("version_label", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))))
    return versions.groupBy("product_id").agg(line.alias("versions"), F.max(F.when(F.col("is_current"), F.col("version_label"))).alias("current"), approved.alias("approved_at"))


def overridden(versions: DataFrame, overrides: DataFrame) -> DataFrame:
    """versions with order and current label by an override (product_id, versions, current); labels it doesn't list are dropped."""
    o = overrides.select("product_id", F.posexplode("versions").alias("p_", "version_label"), F.col("current").alias("c_"))
    listed = overrides.select("product_id").distinct()
    new = versions.drop("position", "is_current").join(o, ["product_id", "version_label"]).withColumn("position", F.col("p_") + 1).withColumn("is_current", F.col("version_label") == F.coalesce("c_", F.lit(""))).drop("p_", "c_")
    return versions.join(listed, "product_id", "left_anti").unionByName(new)
