"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns the
documents for the next one, which reads them back from Parquet.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayscape.llm import neardup, packing, secrets, substrings, toxicity
from rayscape.llm.arrowio import uncarried
from rayscape.llm.registry import table, vocabulary
from rayscape.llm.scratch import Scratch

TOXIC = 0.5  # documents that score this or more are rejected
#: SQL can't express the trained classifier, nor the tokenizer.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier rejects; it learns from the labels of the documents at hand.

    Null and empty texts score by the classifier's bias, repeated rows and ties alike; very long texts are scored whole. Other columns
    come along whatever their names, and an empty table stays empty. Nothing is learned from rows with null ids.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return uncarried(docs, toxicity.score(docs, model, carry=True).filter(F.col("score") < TOXIC), "text", F.col("__text"), measure=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id.

    Documents without words are all kept. Where ids repeat or are null, rows are told apart by a key of their own, so that
    unlike texts that share an id both stay; of rows with equal texts and ids one stays, and a row with an id goes before one without.
    Very long texts count whole; other columns come along whatever their names; an empty table stays empty.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        found = neardup.cluster(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("__kept"))
        return docs.join(found.hint("merge"), docs["doc_id"] == F.col("__kept"), "left_semi")
    scratch = Scratch(spark, "rows")
    keyed = scratch.save(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), "keyed")
    found = neardup.cluster(keyed.select("key", F.col("row.text").alias("text")), "key").select("key", F.col("component_id").alias("group"))
    first = keyed.select("key", F.col("row.doc_id").alias("id")).join(found, "key").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least"))
    kept = keyed.join(first.select(F.col("least.key").alias("key")).hint("merge"), "key", "left_semi")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur more than once out of the texts, so that a repeated row may lose its whole text; ``n_chars`` follows.

    Null texts stay null, and texts that lose nothing stay as they are, byte for byte. Very long texts are searched whole, ids are never
    looked at, other columns come along whatever their names, and an empty table stays empty.
    """
    return uncarried(docs, substrings.dedup(docs, carry=True), "text", F.col("kept_text"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a placeholder; ``n_chars`` follows.

    Null texts stay null and texts without secrets as they are; very long texts are scanned whole. Rows are independent of one
    another, other columns come along whatever their names, and an empty table stays empty.
    """
    return uncarried(docs, secrets.scan(docs, carry=True, redacted=True), "text", F.col("redacted"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: a row for each piece, with its token ids (little-endian, 32 bits) and its place.

    Null and empty texts are the end token alone; very long texts are many pieces; repeated rows and ids give pieces of their own; an empty table gives no rows.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secrets", secret_redaction),
    ("packing", best_fit_packing),
]


def run_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cleaned documents, packed pieces); each stage's result is written and read again, and these two stay in the shared folder."""
    docs, scratch, before, cleaned = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None, None
    for k, (name, stage) in enumerate(STAGES):
        folder = re.sub(r"\W+", "-", name)
        cleaned, docs = docs, scratch.save(stage(spark, docs, sf_dir), folder)
        if before and k < len(STAGES) - 1:
            scratch.drop(before)
        before = folder
    return cleaned, docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces of the cleaned texts. The texts themselves are in ``run_all``'s first result."""
    return run_all(spark, sf_dir)[1]
