"""Pipeline over ``documents``: quality, near duplicates, benchmark passages, secrets, token ids.

Each stage works on all rows that the stage before it kept, and its result is written as Parquet in the
shared folder and read again.  The first four return the columns of ``documents``:

1. ``quality_classifier`` drops documents with a score below 0.5,
2. ``jaccard_join`` keeps the document with the smallest id of each group of near duplicates (word 5-grams,
   similarity 0.8 or more, where the registered op6 query has its own 4 and 0.85; rows without words are no
   group and stay),
3. ``decontamination`` drops documents that hold a window of a benchmark item,
4. ``secret_scan`` replaces every found secret by a mark and sets ``n_chars`` to the new length,
5. ``bpe_codec`` encodes the texts: one row per document with its ids, their number and digest, the digest
   of the decoded bytes, and whether decoding gives the text back.

Null texts pass as empty ones; empty tables give empty results.  The first four stages carry further columns along;
the last returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import bpe, common, decontaminate, jaccard_join, quality, secrets

NEAR_WORDS, NEAR_PERCENT = 5, 80  # the near-duplicate stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.length(common.text_or_empty("text")).cast(docs.schema["n_chars"].dataType))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, bpe.default_ranks(), bpe.default_pattern(), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_codec", bpe_codec),
]

# The classifier, the guess costs and the encoder cannot be written as SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
