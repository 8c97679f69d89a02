"""The registered queries of the operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, decontamination, jaccard, language, packing, pseudolikelihood, quality, secrets, sharding, tokenfiles, topk, urls
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_format", "formats")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(spark, table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), lasting=True)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_files(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return tokenfiles.read_files(spark, files)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolikelihood.score_documents(spark, table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.digests(spark, rows, conversations.damaged(rows))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.Alignment(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).scores()


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(spark, pages, urls.outcomes_of(pages, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_language_id,
        op3_jaccard_join,
        op4_best_fit_packing,
        op5_token_files,
        op6_sharding,
        op7_importance_resampling,
        op8_decontamination,
        op9_exact_top_k,
        op10_pseudo_likelihood,
        op11_conversation_repair,
        op12_tokenizer_alignment,
        op13_url_filter,
    )
}
