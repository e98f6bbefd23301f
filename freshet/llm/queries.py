"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import decontamination, html_text, katz, license_scan, mixing, near_dedup, periodic_runs, quality, token_counts, token_output, topk_search, url_filter, whitening
from freshet.llm.common import read, ship
from freshet.llm.expected import SQL

Query = Callable[[SparkSession, str], DataFrame]


#: Vocabulary file of the token output; every worker has the package that holds it.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_output.write_tokens(read(spark, sf_dir, "documents"), TOKENIZER)
    return token_output.read_summary(files)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.classify(documents, labels, fold(F.col("doc_id"), 4) == 2)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("copies")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_filter.outcomes_of(read(spark, sf_dir, "labels"))
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), outcomes)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), TOKENIZER, limit=1024)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(read(spark, sf_dir, "embeddings"), components=16)


def repeated_tails(documents: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every tenth document, by hash of its id, go on with a period
    from some word on. Rows without id stay as they are."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    tail = F.col("n") - F.col("a")
    placed = (
        chosen.withColumn("g", F.floor(F.col("h") / 10))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
        .withColumn("p", (1 + F.floor(tail / (3 + F.col("g") % 8))).cast("int"))
    )
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(tail / F.col("p")).cast("int"))), F.lit(1), tail)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(repeated_tails(read(spark, sf_dir, "documents"))))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (op1_token_output, op2_topk_search, op3_decontamination, op4_license_scan, op5_html_text, op6_katz_scores, op7_quality, op8_mix_sources, op9_near_dedup, op10_url_filter, op11_token_counts, op12_whitening, op13_periodic_runs)
}
__all__ = ["QUERIES", "SQL"]
