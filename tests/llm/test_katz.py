"""The model against a plain evaluation of its definition, and its sums against one."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import katz

TEXTS = [
    "the cat sat on the mat", "the dog sat on the log", "The cat  saw the dog\tand the dog saw the cat", None, "", "a b a b a b a b a b a b",
    "the the the the the", "on the mat sat the cat and the dog", "entirely new words here", "the cat sat on the mat", "ÉTÉ été",
]
SCHEMA = "doc_id long, text string, score double"


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


class Plain:
    """Counts in dictionaries, evaluated by the recursion of the definition."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [None] + [Counter() for _ in range(order)]
        self.after = [None] + [defaultdict(set) for _ in range(order)]
        for t in texts:
            words = ["start", *tokens(t)]
            for i in range(1, len(words)):
                for k in range(1, order + 1):
                    h = tuple(words[max(0, i - k + 1) : i])
                    if len(h) == k - 1 or i - k + 1 < 0:
                        self.counts[k][h, words[i]] += 1
                        self.after[k][h].add(words[i])
        self.n = sum(self.counts[1].values())
        self.d = [None]
        for k in range(1, order + 1):
            spectrum = Counter(self.counts[k].values())
            self.d.append(katz.good_turing(spectrum).kept)

    def kept(self, k, c):
        return c * (self.d[k][c - 1] if c <= len(self.d[k]) else 1.0)

    def p(self, k, h, w):
        if k == 1:
            c = self.counts[1][(), w]
            left = 1 - sum(self.kept(1, c) for c in self.counts[1].values()) / self.n
            return self.kept(1, c) / self.n if c else left
        words = self.after[k].get(h)
        lower = lambda x: self.p(k - 1, h[1:] if len(h) == k - 1 else h, x)
        if not words:
            return lower(w)
        seen, kept = sum(self.counts[k][h, x] for x in words), sum(self.kept(k, self.counts[k][h, x]) for x in words)
        base = seen if seen - kept > 1e-9 * seen else seen + 1
        if w in words:
            return self.kept(k, self.counts[k][h, w]) / base
        return (1 - kept / base) / (1 - sum(lower(x) for x in words)) * lower(w)

    def score(self, text):
        words = ["start", *tokens(text)]
        return sum(math.log10(self.p(self.order, tuple(words[max(0, i - self.order + 1) : i]), words[i])) for i in range(1, len(words)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_follow_the_definition(spark, monkeypatch, order):
    rows = [(i, t, 0.5) for i, t in enumerate(TEXTS)] + [(None, "the cat", 0.1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = katz.score_documents(df, F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False)), order).collect()
    train = [t for i, t, _ in rows if i is None or i % 4 != 2]
    plain = Plain(train, order)
    texts = {i: t for i, t, _ in rows}
    assert len(found) == len(rows)
    for r in found:
        want = tokens(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.train_tokens == plain.n
        assert r.n_known == sum(plain.counts[1][(), w] > 0 for w in want)
        v = len(plain.counts[1])
        assert r.base_score == pytest.approx(sum(math.log10((plain.counts[1][(), w] + 1) / (plain.n + v + 1)) for w in want))
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), rel=1e-9)
        assert r.held_out == (r.doc_id is not None and r.doc_id % 4 == 2)


def test_context_sums_to_one():
    plain = Plain(TEXTS, 2)
    words = [w for (_, w) in plain.counts[1]]
    for h in [("the",), ("start",), (b"the",), (b"b",), (b"never",)]:
        assert sum(plain.p(2, h, w) for w in words) + plain.p(2, h, "unknown") == pytest.approx(1.0)


def test_good_turing_and_its_fallback():
    kept = katz.good_turing({1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 45}).kept
    assert all(0 < d < 1 for d in kept) and list(kept) == sorted(kept)
    assert katz.good_turing({1: 5}).kept[0] == 0.5


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", 0.0)], SCHEMA)
    (row,) = katz.score_documents(df, F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert katz.score_documents(df.limit(0), F.lit(True)).count() == 0


def test_chunk_and_bucket_sizes_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(TEXTS)], SCHEMA).repartition(2)
    held = F.col("doc_id") % 4 == 2
    whole = {r.doc_id: r.score for r in katz.score_documents(df, held).collect()}
    monkeypatch.setattr(katz, "BUCKET_KEYS", 5)
    small = {r.doc_id: r.score for r in katz.score_documents(df, held).collect()}
    assert small == pytest.approx(whole)


def test_chunks_stay_where_they_are_stored(spark):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = katz.train(df, F.lit(False)).chunks._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 3  # one for each kind of answer, none for the chunks


def test_table_holds_the_counts(spark):
    trained = katz.train(spark.createDataFrame([(1, "a b a", 0.0), (2, "a b", 0.0)], SCHEMA), F.lit(False))
    rows = katz.ngram_table(trained).collect()
    assert sorted((r.order, r["count"]) for r in rows) == [(1, 2), (1, 2), (1, 3), (2, 1), (2, 1), (2, 1), (2, 2), (2, 2)]
