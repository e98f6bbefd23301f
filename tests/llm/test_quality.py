"""The classifier against a dictionary of plain numbers: features, updates, averaging of shards, scores."""

import math

import pytest
import xxhash
from pyspark.sql import functions as F

from freshet.llm import quality

M64 = (1 << 64) - 1
ROWS = [(k, text, k % 2) for k, text in enumerate(["good clear words here", "BUY now!!! buy NOW", "the quiet river, the quiet town", "click $$$ click", "a", "", "Éa 12 x", "x9 !!! win win"] * 4)]


def plain_places(text):
    """Place of each feature (word, pair, shape, pair of shapes) and how often it comes per word."""
    words = text.split()
    core = [xxhash.xxh3_64_intdigest(quality.EDGES.sub("", w).lower() or w, 1) for w in words]
    shape = [xxhash.xxh3_64_intdigest(quality.shape_of(w), 2) for w in words]
    found = {}
    for k in range(len(words)):
        before, shaped = (core[k - 1], shape[k - 1]) if k else (0, 0)
        pair = int(quality.SAME) if before == core[k] else core[k] ^ (before * 0x9E3779B97F4A7C15 & M64)
        both = shape[k] ^ (shaped * 0xD1B54A32D192ED03 & M64)
        for value in (core[k], pair, shape[k], both):
            at = (value * 0x9E3779B97F4A7C15 & M64) >> (64 - quality.BITS)
            found[at] = found.get(at, 0) + 1
    return {at: n / len(words) for at, n in found.items()} | {"bias": 1.0}


def plain_weight(z, n, u):
    if abs(z) <= u.l1:
        return 0.0
    return -(z - math.copysign(u.l1, z)) / ((u.beta + math.sqrt(n)) / u.alpha + u.l2)


def plain_learn(rows):
    """Follow-the-regularised-leader over (text, label), one coordinate at a time."""
    u, z, n = quality.Updates(), {}, {}
    for _ in range(quality.PASSES):
        for text, label in rows:
            shares = plain_places(text)
            w = {f: plain_weight(z.get(f, 0.0), n.get(f, 0.0), u) for f in shares}
            p = 1 / (1 + math.exp(-sum(w[f] * s for f, s in shares.items())))
            for f, s in shares.items():
                g = (p - label) * s
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / u.alpha * w[f]
                n[f] = n.get(f, 0.0) + g * g
    return {f: w for f in z if (w := plain_weight(z[f], n[f], u))}


@pytest.mark.parametrize("shards", [1, 2])
def test_weights_and_scores_against_plain_numbers(spark, monkeypatch, shards):
    monkeypatch.setattr(quality, "SHARD_ROWS", len(ROWS) / shards)
    docs = spark.createDataFrame([(i, t) for i, t, _ in ROWS], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in ROWS], "doc_id long, label int")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    dealt = docs.withColumn("place", place).withColumn("shard", F.pmod(F.xxhash64("place", "text"), F.lit(shards))).collect()
    label = {i: y for i, _, y in ROWS}
    want = {}
    for shard in range(shards):
        own = sorted((r for r in dealt if r.shard == shard), key=lambda r: r.place)
        assert own
        for f, w in plain_learn([(r.text, label[r.doc_id]) for r in own]).items():
            want[f] = want.get(f, 0.0) + w / shards
    weights = quality.train(labels, docs)
    got = {("bias" if at == 1 << quality.BITS else at): w for at, w in enumerate(weights) if w}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], rel=1e-9) for f in want)
    scores = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    for i, text, _ in ROWS:
        total = sum(want.get(f, 0.0) * s for f, s in plain_places(text).items())
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
