"""Runs of repeated words against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from freshet.llm import periodic_runs as runs
from freshet.llm.queries import QUERIES
from tests.conftest import SF


def scanned(words, least_words=24, least_periods=3):
    """Every maximal stretch by trying every period from the smallest on."""
    n, found = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= 2 * q and i > start:
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least_words, least_periods * q)), key=lambda r: (r[0], r[2]))


def drawn(draw):
    n, k = draw.randint(0, 90), draw.choice([1, 2, 3, 5])
    words = [draw.randrange(k) for _ in range(n)]
    for _ in range(draw.randint(0, 3) if n > 10 else 0):
        p, a, size = draw.randint(1, 9), draw.randrange(n), draw.randint(1, n)
        for i in range(a + p, min(n, a + size)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least", [(24, 3), (2, 2), (6, 3)])
def test_random_texts(least):
    draw = random.Random(11)
    for _ in range(500):
        words = drawn(draw)
        assert runs.periodic_runs(np.array(words, np.int64), *least) == scanned(words, *least)


def test_texts_sorted_together_are_judged_apart():
    draw = random.Random(12)
    texts = [np.array(drawn(draw) or [0], np.int64) for _ in range(300)]
    for text, found in zip(texts, runs.repeats_a_passage(texts).tolist(), strict=True):
        passages = [tuple(text[k : k + runs.PASSAGE]) for k in range(len(text) - runs.PASSAGE + 1)]
        assert found == (len(set(passages)) < len(passages))
        assert found or not scanned(text.tolist())


def test_suffix_order_and_common_prefixes():
    codes = np.array([1, 0, 1, 0, 1, 2, 0, 1])
    suffixes, place = runs.sorted_suffixes(codes)
    assert suffixes.tolist() == sorted(range(8), key=lambda k: codes[k:].tolist())
    shared = runs.common_prefixes(codes.tolist(), suffixes.tolist(), place.tolist())
    assert shared == [0, 2, 2, 0, 1, 3, 1, 0]


def test_long_periodic_texts_stay_cheap():
    assert runs.periodic_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert runs.periodic_runs(np.arange(90_000) % 29_000) == [(0, 90_000, 29_000)]


def test_strongest_compares_fractions_exactly():
    big = 10**17
    assert runs.strongest([(5, 3 * big + 1, big), (0, 3 * big, big), (9, 3 * big + 1, big)]) == (5, 3 * big + 1, big)
    assert runs.strongest([(4, 30, 3), (2, 60, 6), (2, 30, 3)]) == (2, 30, 3) and runs.strongest([]) is None


def found_in(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string")
    return sorted(runs.find_runs(docs).collect(), key=str)


def test_odd_rows(spark):
    rows = [(None, "a " * 30), (1, None), (1, ""), (2, " \t\n "), (3, "x\x0by\x1cz w"), (4, "a b " * 20), (4, "a b " * 20), (5, "w " * 24), (6, "w " * 23)]
    got = {(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found_in(spark, rows)}
    assert got == {
        (None, 30, ((0, 30, 1),), "a"), (1, 0, (), ""), (2, 0, (), ""), (3, 2, (), "x y\x1cz w"),
        (4, 40, ((0, 40, 2),), "a b"), (5, 24, ((0, 24, 1),), "w"), (6, 23, (), " ".join("w" * 23)),
    }
    assert len(found_in(spark, rows)) == len(rows) and found_in(spark, []) == []


def test_batches_do_not_matter(spark, monkeypatch):
    rows = [(k, f"p q {k} " * 12) for k in range(50)]
    want = found_in(spark, rows)
    monkeypatch.setattr(runs, "WORDS_TOGETHER", 100)
    assert found_in(spark, rows) == want and all(r.runs[0].period == 3 for r in want)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_query_on_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(got) == len(texts)
    with_runs = 0
    for r in got:
        words = planted(r.doc_id, texts[r.doc_id])
        found = [tuple(run) for run in scanned(words)] if len(words) < 3000 else runs.periodic_runs(runs.numbered([w.encode() for w in words]))
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        dropped = {k for s, m, q in found for k in range(s + q, s + m)}
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        with_runs += bool(found)
    assert with_runs > 10
