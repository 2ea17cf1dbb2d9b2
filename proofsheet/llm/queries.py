"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_probe

    return edit_probe(table(spark, sf_dir, "documents"))


@query
def op2_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_planes import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flac import text_media_features

    return text_media_features(table(spark, sf_dir, "documents"))


@query
def op6_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    return format_conversations(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op10_snapshot_collapse"] = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), p AS (
  SELECT conv_id, place, n_turns, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM t
), whole AS (
  SELECT conv_id, n_turns, so_far, md5(so_far) AS h FROM p WHERE place = n_turns
), inner_ AS (
  SELECT DISTINCT place AS n_turns, md5(so_far) AS h FROM p WHERE place < n_turns
), every AS (
  SELECT w.conv_id, w.n_turns, w.so_far, count(*) OVER (PARTITION BY w.n_turns, w.h) AS copies,
         i.h IS NOT NULL AS snapshot, w.conv_id = min(w.conv_id) OVER (PARTITION BY w.n_turns, w.h) AS least
  FROM whole w LEFT JOIN inner_ i ON i.n_turns = w.n_turns AND i.h = w.h
)
SELECT conv_id, n_turns::BIGINT AS n_turns, copies::BIGINT AS copies, snapshot, (least AND NOT snapshot) AS kept,
       CASE WHEN least AND NOT snapshot THEN so_far END AS rendered
FROM every
"""


@query
def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query
def op8_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import TYPES, key_of, with_surrogates

    out = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    kinds = F.col("surrogates.kinds")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, t))).alias(f"n_{t}") for t in TYPES]
    return out.select("doc_id", F.col("surrogates.text").alias("text"), F.size(kinds).alias("n_entities"), *counts)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import score_links

    return score_links(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_fingerprints

    return near_fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie, rebuilt

    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


ORACLE_SQL["op12_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS own,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(conv_id::VARCHAR, '')])::BIGINT[]),
             lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)) % 9 AS h
  FROM t GROUP BY conv_id
), e AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base
), r AS (
  SELECT e.conv_id, t.i AS d, role, text FROM e JOIN t ON t.conv_id = e.base AND t.i <= e.h
  UNION ALL
  SELECT e.conv_id, t.i - e.h + e.head, role, text FROM e JOIN t ON t.conv_id = e.conv_id AND t.i > e.h
), o AS (
  SELECT conv_id, d, strlen(text) AS bytes, count(*) OVER (PARTITION BY conv_id) AS n,
         md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k
  FROM r
  UNION ALL
  SELECT e.conv_id, 0, 0, (SELECT count(*) FROM r WHERE r.conv_id = e.conv_id), '' FROM e
), n AS (
  SELECT d, k, min(conv_id) AS owner, count(*) AS n_convs, max(n) AS deepest, min(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM o GROUP BY d, k
), s AS (
  SELECT v, count(*) FILTER (n.deepest = n.d) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM (SELECT DISTINCT a.k AS v, b.k AS u FROM o a JOIN o b USING (conv_id) WHERE b.d >= a.d) JOIN n ON n.k = u GROUP BY v
), p AS (
  SELECT DISTINCT b.k AS child, a.k AS parent FROM o a JOIN o b ON b.conv_id = a.conv_id AND b.d = a.d + 1
)
SELECT n.owner AS conv_id, n.d::BIGINT AS depth, (SELECT q.owner FROM p JOIN n q ON q.k = p.parent WHERE p.child = n.k) AS parent_conv_id,
       n.n_convs::BIGINT AS n_convs, (SELECT count(*) FROM p WHERE p.parent = n.k)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.v = n.k
"""
