"""The data model's tables, bound to the driver's tables.

Each binding is one SELECT in the part of SQL that Spark and DuckDB share, so that queries
and their checks start from the same rows: findings are line items, runs are months of
orders, products are parts, artwork versions are documents, regions are boxes of findings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BINDINGS = {
    "b_runs": """
        SELECT CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS BIGINT) AS run_id,
               CASE WHEN ((year(o_orderdate) - 1992) * 12 + month(o_orderdate)) % 9 = 4 THEN 'FAILED' ELSE 'COMPLETE' END AS status,
               count(*) AS images_total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS images_cached
        FROM orders GROUP BY 1, 2""",
    "b_findings": """
        SELECT l_orderkey * 8 + l_linenumber AS finding_id, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS BIGINT) AS run_id,
               l_partkey AS product_id, l_suppkey AS image_id,
               CASE WHEN l_returnflag = 'R' THEN 'STALE_VERSION' WHEN l_returnflag = 'A' THEN 'UNKNOWN_IMAGE'
                    WHEN l_linenumber = 7 THEN 'ERROR' ELSE 'PASS' END AS verdict,
               CASE WHEN l_returnflag = 'A' OR (l_returnflag <> 'R' AND l_linenumber = 7) THEN 'UNCERTAIN' WHEN l_returnflag <> 'R' THEN 'NONE'
                    WHEN l_linenumber < 3 THEN 'MATERIAL' WHEN l_linenumber = 3 THEN 'UNCERTAIN' WHEN l_linenumber = 4 THEN 'COSMETIC' ELSE 'NONE' END AS severity,
               CASE WHEN l_returnflag = 'A' THEN 'NONE' WHEN l_linestatus = 'F' THEN 'REGION_CHECK' WHEN l_linenumber % 2 = 0 THEN 'PIXEL_DIFF' ELSE 'HASH_EXACT' END AS match_method,
               round(1 - l_discount, 2) AS confidence, l_linenumber % 3 + 1 AS current_version_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "b_products": "SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size FROM part",
    "b_regions": """
        SELECT l_orderkey * 8 + l_linenumber AS finding_id, l_partkey AS product_id, l_linenumber % 3 + 1 AS version_id, k AS ordinal,
               CAST(floor(l_quantity) AS BIGINT) * 20 + k * 37 AS x, l_suppkey * 7 % 900 + k * 11 AS y,
               CAST(floor(l_extendedprice) AS BIGINT) % 180 + 12 AS w, l_partkey % 70 + 9 + k AS h,
               CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat('field_', CAST(l_linenumber + k AS VARCHAR(9)), '_mg') END AS field_key,
               CASE WHEN (l_linenumber + k) % 3 = 0 THEN 'MATERIAL' WHEN (l_linenumber + k) % 3 = 1 THEN 'COSMETIC' ELSE 'UNCERTAIN' END AS severity
        FROM lineitem JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks ON k < l_linenumber % 3 + 1
        WHERE l_returnflag = 'R'""",
    "b_acks": """
        SELECT DISTINCT product_id, x, y, w, h, field_key, version_id, CASE WHEN product_id % 5 = 0 THEN 'REJECTED' ELSE 'ACKNOWLEDGED' END AS decision
        FROM (SELECT l_partkey AS product_id, CAST(floor(l_quantity) AS BIGINT) * 20 + k * 37 AS x, l_suppkey * 7 % 900 + k * 11 AS y,
                     CAST(floor(l_extendedprice) AS BIGINT) % 180 + 12 AS w, l_partkey % 70 + 9 + k AS h,
                     CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat('field_', CAST(l_linenumber + k AS VARCHAR(9)), '_mg') END AS field_key,
                     l_linenumber % 3 + 1 AS version_id
              FROM lineitem JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks ON k < l_linenumber % 3 + 1
              WHERE l_returnflag = 'R' AND l_orderkey % 4 <> 1) a""",
    "b_versions": "SELECT doc_id AS version_id, concat(source, '/', lang) AS product_id, text, n_chars, n_chars % 7 = 0 AS flagged FROM documents",
}


def _needs(name: str) -> list[str]:
    return [t for t in TABLES if t in BINDINGS[name].replace(",", " ").replace(")", " ").split()]


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The bound table, or the driver's table of that name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    frames = {t: bound(spark, sf_dir, t) for t in _needs(name)}
    text = BINDINGS[name].replace("VARCHAR(9)", "STRING")
    for t in frames:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def oracle(text: str) -> str:
    """DuckDB SQL with the bindings it names put before it."""
    used = [n for n in BINDINGS if n in text]
    if not used:
        return text
    ctes = ", ".join(f"{n} AS ({BINDINGS[n]})" for n in used)
    body = text.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
