"""A training-data pipeline of the operators: each stage takes the documents that its predecessor kept.

All stages but the last return rows of documents with all their columns, clashing
names included; the last returns the packed pieces. A null or empty text has no
words: it is drawn or not by the empty model's weight, is no copy of another,
holds no item and no secret, and packs as the end id alone. Rows of one doc_id
stay or go together in the join, those of a null doc_id stay. Texts are read
whole, whatever their length. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamworks.llm import decontamination, jaccard, packing, quality, secrets
from loamworks.llm.common import kept, table
from loamworks.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id stays; documents without words or doc_id stay. Linked are those that share 0.8 of their shingles of five words."""
    return jaccard.one_of_each(spark, docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    return secrets.mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 ids."""
    return packing.pack_documents(spark, docs, tokenizer("word_bpe_49k.json"))


STAGES = [(f.__name__, f) for f in (quality_classifier, ngram_jaccard_join, benchmark_decontamination, secret_scans, best_fit_packing)]

#: Importance resampling and inferred automata are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept(spark, docs)
    return docs
