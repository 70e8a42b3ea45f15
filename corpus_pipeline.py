"""The corpus pipeline: stages over the documents table, each a step of one operator of flagstone.llm.

Each stage takes the documents that its predecessor kept, decides over all of them, and returns the rows it keeps with
the columns of `documents`; the last returns packed pieces. Decisions fall on rows, not on doc_id, which may be null or
repeated: a struct of all that a row holds is the operators' key inside a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flagstone.llm.common import kept_once, stored, unused, with_row_key, without
from flagstone.llm.exact_dedup import exact_groups
from flagstone.llm.minhash import near_duplicates
from flagstone.llm.mixing import apply_copies, mix
from flagstone.llm.packing import packed_digest
from flagstone.llm.quality import score_quality
from flagstone.llm.queries import domain_labels, table, tokenizer_file

# Wanted shares of tokens. Poor documents are gone by then, so domains are toxic and other texts.
MIXTURE = {"plain": 0.99, "toxic": 0.01}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    row = unused(docs, "_row_key")
    keyed = with_row_key(docs, row)
    return without(keyed, score_quality(keyed, table(spark, sf_dir, "labels"), row=row).filter("not kept"), row).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    row = unused(docs, "_row_key")
    keyed = with_row_key(docs, row)
    return kept_once(keyed, exact_groups(keyed, key=row).filter("group_size > 1"), row).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays."""
    row = unused(docs, "_row_key")
    keyed = with_row_key(docs, row)
    # Texts without words link with nothing, not even with themselves.
    return kept_once(keyed, near_duplicates(keyed, key=row).filter("n_shingles > 0"), row).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay or go as their rate says, which is one at most: a text that is labelled plain, or unlabelled and as
    likely plain as not, always stays, and toxic ones as far as the mixture wants them. Where toxic texts are scarce, their share falls short."""
    domain = F.when(F.col("domain") == "toxic", "toxic").when(F.col("domain").isNotNull(), "plain")
    labels = domain_labels(spark, sf_dir).withColumn("domain", domain)
    row = unused(docs, "_row_key")
    keyed = with_row_key(docs, row)
    return apply_copies(keyed, mix(keyed, labels, MIXTURE, whole_domain="plain", row=row), row).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 2048 tokens."""
    return packed_digest(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Trained models and a tokenizer cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
