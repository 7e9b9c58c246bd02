"""The corpus pipeline: toxic documents out, near duplicates out, repeated passages out,
sources mixed to their targets, documents packed into training sequences.

A stage is a function of (session, documents, folder of the tables). Its result is written
and read again as the documents of the next one; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salesloom.llm import jaccard, mixing, packing, substrings, toxicity
from salesloom.llm.common import ship, stage, table, text_key
from salesloom.staging import materialise_alone as stage_alone


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with keys that tell texts and ids apart and are never null."""
    return docs.withColumn("_dk", F.xxhash64("doc_id", F.lit(1))).withColumn("_th", text_key())


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from ``labels``."""
    ship(spark)
    return toxicity.keep_ordinary(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id.

    Documents without words are near nothing and all stay.
    """
    ship(spark)
    stays = jaccard.join(docs).where("kept").select(
        F.col("dk").alias("_dk"), F.col("th").alias("_th")
    )
    worded = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    first = _keyed(docs).where(worded).join(stays.distinct(), ["_dk", "_th"]).dropDuplicates(
        ["_dk", "_th"]
    ).select(*docs.columns)
    return first.unionByName(docs.where(~worded))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of passages that repeat; n_chars follows the text."""
    ship(spark)
    # The search's own tables go before the whole texts are shuffled once more.
    cut = stage_alone(
        spark, lambda: substrings.repeats(docs).where("kept_text is not null").select(
            F.col("dk").alias("_dk"), F.col("th").alias("_th"), F.col("kept_text").alias("_kept")
        ), "cut",
    ).dropDuplicates(["_dk", "_th"])
    text = F.coalesce("_kept", "text")
    joined = _keyed(docs).join(cut, ["_dk", "_th"], "left")
    if "n_chars" in docs.columns:
        length = F.length(F.col("_kept")).cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return joined.withColumn("text", text).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in training order.

    The document at which a source's quota ends is taken whole.
    """
    # Rows with one key are equal in all columns, so one of them stands for their takes.
    key = F.concat_ws(
        "-", F.md5(F.coalesce(F.col("text"), F.lit(""))), F.xxhash64(*docs.columns).cast("string")
    )
    plan = stage(mixing.mix(docs, text_key=key).where("copies > 0"), "mix").select(
        F.col("text_key").alias("_key"),
        *[F.col(c).alias(f"_{c}") for c in ("at", "copies", "source_size", "quota", "tilt")],
    )
    # The texts are dealt by key once, for both the choice and the join, then by position.
    rows = docs.withColumn("_key", key).dropDuplicates(["_key"])
    joined = rows.join(plan, "_key").withColumn(
        "_take", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    )
    share = (F.col("_take") * F.col("_source_size") + F.col("_at")).cast("double") / F.greatest(
        F.col("_quota"), F.lit(1)
    )
    time = mixing.training_time(F.least(share, F.lit(1.0)), F.col("_tilt"))
    return joined.withColumn("_time", time).orderBy("_time", "source", "doc_id", "_take").select(
        *docs.columns
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("repeated_passages", unrepeated),
    ("mixing", mixed),
    ("packing", packed),
]

#: Dictionaries, minwise trees and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
