"""Registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from usagelens.llm import (
    decontaminate,
    exact_dedup,
    katz,
    line_dedup,
    pieces,
    prefix_trie,
    quality,
    secrets,
    simhash,
    substrings,
    toxicity,
    url_filter,
    whitening,
)
from usagelens.llm.common import table


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.filter_urls(pages, url_filter.campaign_keys(pages))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def op3_quality_grades(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.graded(docs, quality.train(docs, quality.grades_of(table(spark, folder, "labels"))))


def op4_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("stays")


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    ids = pieces.encode(table(spark, folder, "documents"))
    digest = F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256")
    return ids.select("doc_id", "n_tokens", digest, "lossless")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_report(table(spark, folder, "documents"))
    return out.withColumn("removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ","))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op11_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    return katz.katz_scores(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, folder, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.branched(turns))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_secret_scan,
        op3_quality_grades,
        op4_benchmark_leaks,
        op5_substring_dedup,
        op6_toxicity,
        op7_simhash,
        op8_pieces,
        op9_line_dedup,
        op10_exact_dedup,
        op11_katz_scores,
        op12_prefix_trie,
        op13_embedding_whitening,
        pipeline,
    )
}
