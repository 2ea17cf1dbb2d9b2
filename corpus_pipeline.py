"""A training-corpus pipeline: language identification, near-duplicates, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of `documents`.

Defined results of all stages: further columns, whatever their names, are dropped; an empty
table gives no rows; very long texts are read whole, a slice of the rows at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.llm import langid, mixing, neardup, packing, pii
from proofsheet.llm.common import order_key
from proofsheet.llm.queries import tokenizer_path
from proofsheet.tables import scratch, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without a letter or unlike every learned language go.

    Null and empty texts go; a null lang or id says nothing and is no reason to go; equal texts and repeated rows fare alike.
    """
    model = langid.train(docs.filter(~langid.held_out()), guarded=True)
    seen = langid.predict(docs.select(COLUMNS), model)
    kept = seen.filter((F.col("p_.lang_pred") != "und") & F.col("p_.learned"))
    return kept.withColumn("lang", F.col("p_.lang_pred")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id.

    Texts without words are no duplicates and all stay, but for rows repeated in id and text, of which one stays; a null
    id comes after all others; of rows with the least id and different texts one stays.
    """
    first = neardup.near_duplicates(docs).filter("first").select(F.col("k").alias("k_"), F.col("h").alias("h_")).distinct()
    keyed = docs.select(COLUMNS).withColumn("k_", order_key()).withColumn("h_", F.xxhash64("text"))
    return keyed.join(first, ["k_", "h_"], "left_semi").dropDuplicates(["k_", "h_"]).select(COLUMNS)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of detected entities, and their new length.

    Null texts stay null with length 0; no row goes; equal texts and repeated rows get equal results.
    """
    out = pii.with_surrogates(docs.select(COLUMNS), pii.key_of(spark)).withColumn("text", F.col("surrogates.text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own; null and empty texts have no words and come in whole copies only; repeated rows
    are drawn each for itself and come as often as all of them are taken; ties don't occur, as rows are told apart by their text.
    """
    key = ["k_", "h_", "s_", "z_"]
    named = {"s_": F.coalesce("source", F.lit("")), "z_": F.col("source").isNull()}
    drawn = mixing.mix(docs).select(order_key().alias("k_"), F.col("h").alias("h_"), *[c.alias(n) for n, c in named.items()], "taken_copies")
    drawn = drawn.groupBy(key).agg(F.sum("taken_copies").cast("int").alias("copies")).filter("copies > 0")
    keyed = docs.select(COLUMNS).withColumns({"k_": order_key(), "h_": F.xxhash64("text"), **named}).dropDuplicates(key)
    return keyed.join(drawn, key).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their places in sequences of 1024 tokens.

    A null text is empty and is the end id alone; a null id is kept; repeated rows and ties of length are packed each for itself.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage stores on its way goes when its result is written."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        with scratch(spark):
            stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return out
