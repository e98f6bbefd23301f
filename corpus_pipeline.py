"""From raw documents to token files: five stages over everything the stage before kept.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import decontamination, mixing, near_dedup, quality, token_output
from freshet.llm.common import read
from freshet.llm.queries import TOKENIZER
from freshet.operators.sizing import attach, summarised
from freshet.sources.workspace import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a lower score are rejected: those more likely of low quality than not.
LEAST_SCORE = 0.5
KEY = "_row"
#: Words of a shingle in near duplicates, as in the operator's own query: of five words, a copy with a few
#: edits spread over it keeps too few (0.73 of planted near copies were caught).
NEAR_WORDS = 2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier, learnt from all labels, does not reject."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, quality.train(labels, docs), LEAST_SCORE)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The five columns and a row key made of ``columns``: never null, the same for rows equal in them, apart for others that share an id."""
    nulls = F.concat(*(F.col(c).isNull().cast("string") for c in columns))
    return docs.select(*COLUMNS, F.xxhash64(nulls, *columns).alias(KEY))


def by_key(rows: DataFrame) -> DataFrame:
    """What an operator sees of keyed rows: the key in place of the id."""
    return rows.select(F.col(KEY).alias("doc_id"), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, a null id being the last, and of
    rows alike in all columns one. Rows without words are in no group."""
    rows = keyed(docs, *COLUMNS)
    ids = stored(rows.groupBy(KEY).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "near-ids")
    twice = summarised(ids.where("n > 1").select(KEY), "twice")
    single = attach(rows, twice, [KEY], "left_anti").unionByName(attach(rows, twice, [KEY], "left_semi").dropDuplicates())
    groups = near_dedup.near_duplicates(by_key(single), words=NEAR_WORDS).select(F.col("doc_id").alias(KEY), "component_id")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col(KEY))).alias("first")
    kept = groups.join(ids, KEY).groupBy("component_id").agg(first).select(f"first.{KEY}")
    return attach(single, summarised(kept, "near-kept"), [KEY], "left_semi").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, each judged by its own text."""
    rows = keyed(docs, "text")
    found = decontamination.decontaminate(by_key(rows), read(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias(KEY)).distinct()
    return attach(rows, summarised(hit, "gone"), [KEY], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, with or without an id."""
    taken = mixing.mix(docs.select(*COLUMNS), carried=COLUMNS).where("copies > 0")
    return taken.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("carried.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document."""
    return token_output.read_summary(token_output.write_tokens(docs, TOKENIZER))


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix_sources),
    ("token output", write_tokens),
]
#: Learnt weights and a vocabulary are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
