"""Quality classifier: logistic regression on hashed word n-grams, learnt by FTRL-proximal.

A text's features are its words and word pairs, and the same of the words' shapes
(runs of capitals, small letters and digits, other characters as they are), hashed
to 2^18 places; a word that repeats the one before it counts as such in the pair.
A feature's value is its share of the text's words, so a score is the logistic of a
sparse dot product of shares and weights, whatever the text's length.

Learning: a bounded sample of the labelled rows (``sample``, 20,000) is dealt by a hash to
shards of about 2,500 rows; each shard runs follow-the-regularised-leader
updates over its rows, and the shards' weights are averaged. The sample's ids and labels
are small by that bound and go to the text by broadcast; the weights are at most
2^18 numbers and go the same way to the tasks that score.

Defined cases: a null or empty text has no features and the bias's score; rows with a
null id are scored but never learnt from; null labels are no labels; an id labelled
twice is learnt once per row; repeated rows are scored each; without labels of both
kinds every score is one half or the bias the labels there are give.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import only, records, ship

BITS = 18
SAMPLE = 20_000
#: Rows a shard learns from, about.
SHARD_ROWS = 2_500
PASSES = 8
ACCEPT = 0.7

SCORES = "doc_id long, score double"
RUNS = ((re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "9"))
EDGES = re.compile(r"^[^\w]+|[^\w]+$")
SAME = np.uint64(0x2545F4914F6CDD1D)


def shape_of(word: str) -> str:
    for pattern, mark in RUNS:
        word = pattern.sub(mark, word)
    return word


class Hasher:
    """Places of texts' features. What is known of a word is remembered, up to a number of words."""

    def __init__(self, remembered: int = 300_000):
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.cores = np.zeros(1024, np.uint64)
        self.shapes = np.zeros(1024, np.uint64)

    def learn(self, word: str) -> int:
        n = len(self.number)
        if n == len(self.cores):
            self.cores, self.shapes = np.concatenate([self.cores] * 2), np.concatenate([self.shapes] * 2)
        self.number[word] = n
        self.cores[n] = xxhash.xxh3_64_intdigest(EDGES.sub("", word).lower() or word, 1)
        self.shapes[n] = xxhash.xxh3_64_intdigest(shape_of(word), 2)
        return n

    def features(self, text: str | None) -> np.ndarray:
        """Places of the text's features, one row of four per word: word, pair, shape, pair of shapes."""
        words = (text or "").split()
        if len(self.number) > self.remembered:
            self.forget()
        number = self.number
        known = np.array([n if (n := number.get(w)) is not None else self.learn(w) for w in words], np.int64)
        core, shape = self.cores[known], self.shapes[known]
        before, shaped = np.empty_like(core), np.empty_like(shape)
        before[1:], before[:1], shaped[1:], shaped[:1] = core[:-1], 0, shape[:-1], 0
        pair = np.where(before == core, SAME, core ^ (before * np.uint64(0x9E3779B97F4A7C15)))
        both = shape ^ (shaped * np.uint64(0xD1B54A32D192ED03))
        rows = np.stack([core, pair, shape, both], axis=1) * np.uint64(0x9E3779B97F4A7C15)
        return (rows >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Updates:
    """Follow-the-regularised-leader, proximal form, per coordinate."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int) -> np.ndarray:
        """Weights of all places; the last is the bias. ``rows``: places, shares, label."""
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        for _ in range(passes):
            for places, shares, label in rows:
                zz, nn = z[places], n[places]
                w = self.weights(zz, nn)
                p = 1 / (1 + np.exp(-np.clip(w @ shares, -35, 35)))
                g = (p - label) * shares
                z[places] = zz + g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / self.alpha * w
                n[places] = nn + g * g
        return self.weights(z, n)


def as_row(hasher: Hasher, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their shares, with the bias's place at share 1."""
    found = hasher.features(text)
    places, counts = np.unique(found, return_counts=True)
    return np.append(places, 1 << BITS).astype(np.int64), np.append(counts / max(1, len(found)), 1.0)


def _learn_shard(rows: pd.DataFrame) -> pd.DataFrame:
    hasher = Hasher()
    rows = rows.sort_values("place")
    seen = [(*as_row(hasher, t), float(y)) for t, y in zip(rows["text"], rows["label"], strict=True)]
    weights = Updates().learn(seen, PASSES)
    places = np.flatnonzero(weights)
    return pd.DataFrame({"feature": places, "weight": weights[places]})


def train(labelled: DataFrame, documents: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from ``labelled`` (doc_id, label 0 or 1) rows and the texts of ``documents``."""
    ship(documents.sparkSession)
    rows = only(labelled, "doc_id", "label").where("doc_id IS NOT NULL AND label IS NOT NULL")
    labels = rows.count()
    share = min(1.0, sample / max(1, labels))
    shards = max(1, round(min(labels, sample) / SHARD_ROWS))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    # a share of a hash: about ``sample`` rows, the same ones in every run
    chosen = rows.withColumn("place", place).where(F.col("place") < F.lit(int(share * (1 << 30))))
    texts = only(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("place", "text"), F.lit(shards)))
    learnt = dealt.groupBy("shard").applyInPandas(_learn_shard, "feature long, weight double")
    found = learnt.groupBy("feature").agg((F.sum("weight") / F.lit(float(shards))).alias("weight")).collect()  # at most 2^18 + 1
    weights = np.zeros((1 << BITS) + 1)
    for feature, weight in found:
        weights[feature] = weight
    return weights


@dataclass(frozen=True)
class _Score:
    weights: object

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hasher, ids, scores = self.weights.value, Hasher(), [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

        for doc_id, text in records(batches, "doc_id", "text", step=64):
            found = hasher.features(text)
            total = weights[-1] + (weights[found].sum() / len(found) if len(found) else 0.0)
            ids.append(doc_id)
            scores.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            if len(ids) == 8192:
                yield batch()
                ids, scores = [], []
        if ids:
            yield batch()


class _ScoreRows:
    """Keeps the rows' own columns and appends the score of column ``text``."""

    def __init__(self, weights):
        self.weights = weights

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hasher = self.weights.value, Hasher()
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for k, (text,) in enumerate(records([batch], "text", step=64)):
                found = hasher.features(text)
                total = weights[-1] + (weights[found].sum() / len(found) if len(found) else 0.0)
                scores[k] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every document."""
    spark = documents.sparkSession
    ship(spark)
    return only(documents, "doc_id", "text").mapInArrow(_Score(spark.sparkContext.broadcast(weights)), SCORES)


def accepted(documents: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """The documents with a score of ``least`` or more, with their five columns."""
    spark = documents.sparkSession
    ship(spark)
    rows = only(documents, "doc_id", "text", "lang", "source", "n_chars")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    scored = rows.mapInArrow(_ScoreRows(spark.sparkContext.broadcast(weights)), f"{schema}, score double")
    return scored.where(F.col("score") >= least).drop("score")


def classify(documents: DataFrame, labels: DataFrame, held_out: Column, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; learns from labels.quality of ids not held out."""
    labelled = only(labels, "doc_id", "quality").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    weights = train(labelled, documents, sample)
    return score(documents, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
