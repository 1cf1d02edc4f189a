"""A corpus pipeline over documents: filter, deduplicate, mask, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet to the shared folder and reads it back as the next
stage's documents, so a lost executor costs a stage's running tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.llm import bpe, mixing, near_dedup, pii, toxicity
from gridtally.llm.common import row_hash, stored, table, unused

#: Blocks of the mix: a training context, so most documents stay whole.
BLOCK_WORDS = 512


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores under the threshold.  Labels are the table's."""
    labels = table(spark, sf_dir, "labels")
    score = unused(docs, "toxicity")
    scored = toxicity.toxicity_scores(docs, toxicity.train(docs, labels), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id, one row of it.

    Of several rows of that doc_id the one with the least text, by its hash, stays,
    and of these the one with the least hash of all columns.
    Documents without a doc_id are in no class and stay.
    """
    classes = near_dedup.near_classes(docs)
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    known = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    least = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), row_hash(docs)))
    one = known.groupBy("doc_id").agg(least.alias("one"))
    one = one.select("one.*")
    return one.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars follows the text."""
    masked = pii.pseudonymise(docs, found_col=None)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.length("text").cast(kind))
    return masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each time a document, or a part of it, is taken."""
    return mixing.mixed_documents(docs, BLOCK_WORDS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids and n_tokens, checked against their decoded text's digest."""
    coded = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.withColumns(
        {
            "n_tokens": F.size("token_ids").cast("long"),
            "decoded_sha256": F.sha2(F.col("decoded"), 256),
        }
    ).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: A recurrent network and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
