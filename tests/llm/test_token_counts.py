"""Prefix token counts against the library on every prefix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freshet.llm import token_counts
from freshet.llm.queries import QUERIES, TOKENIZER
from tests.conftest import SF

LETTERS = ["a", "b", "'", "l", "r", "e", "s", " ", "  ", "\n", "\t", "é", "日", "🙂", "1", "23", "!", "==", "<|endoftext|>", "the", " ing", "\x1c", "\x85", "×", "　"]
TEXTS = ["", "a", "I'll  go\n\n there 're <|endoftext|> x<|endoftext|>", "  \n a\t b  ", "日本語テキスト é à ü", "''ll !'ve 've", " " * 300 + "a", "<|endof <|endoftext|", "a  <|endoftext|>  b", "=" * 130, "x" * 90]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def plain_count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_as_the_library_counts_it(library):
    draw = random.Random(7)
    texts = TEXTS + ["".join(draw.choice(LETTERS) for _ in range(draw.randint(1, 40))) for _ in range(400)]
    counter = token_counts.PrefixCounter(TOKENIZER)
    for text, changes in zip(texts, counter.changes(texts), strict=True):
        want = [plain_count(library, text[: i + 1]) for i in range(len(text))]
        assert np.cumsum(changes, dtype=np.int64).tolist() == want, text


def test_full_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCHES", 3)
    monkeypatch.setattr(token_counts, "WORDS", 3)
    counter = token_counts.PrefixCounter(TOKENIZER)
    for text in ["one two  three 're four", "five six", "one two  three 're four's  \n x", "a  b  c  d"] * 2:
        assert int(counter.changes([text])[0].sum()) == plain_count(library, text)


def test_pairs_that_share_a_slot_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PAIRS", 4)
    counter = token_counts.PrefixCounter(TOKENIZER)
    texts = ["unbelievable antidisestablishmentarianism " * 3, "xyzzyqwrt plmokn bvcxz"]
    assert [int(c.sum()) for c in counter.changes(texts)] == [plain_count(library, t) for t in texts]


@pytest.fixture(scope="module")
def rows():
    long = "lorem ipsum dolor's  sit\n\namet " * 600
    return [(1, "one two three"), (2, None), (2, ""), (None, "no id"), (3, long), (3, long), (4, "naïve 日本 " * 5)]


@pytest.fixture(scope="module")
def index(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_tokens int, segments int")
    return token_counts.index_prefixes(docs, TOKENIZER)


def test_index_has_a_row_per_document(index, rows, library):
    got = sorted(((r.doc_id, r.n_bytes, r.n_chars, r.n_tokens) for r in index.collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(t or ""), plain_count(library, t or "")) for i, t in rows), key=str)


@pytest.mark.parametrize("budget", [-1, 0, 1, 5, 1024, 3000, 10**9])
def test_longest_prefix(index, rows, library, budget):
    got = {(r.doc_id, r.n_chars): r.fits_chars for r in token_counts.longest_prefix(index, F.lit(budget)).collect()}
    for i, text in rows:
        text = text or ""
        found = got[i, len(text)]
        if budget < 0:
            assert found is None
            continue
        assert plain_count(library, text[:found]) <= budget
        upto = range(found + 1, min(len(text), found + 40) + 1)
        assert all(plain_count(library, text[:n]) > budget for n in upto)


@pytest.mark.parametrize("chars", [-1, 0, 1, 4, 4096, 4097, 5000])
def test_tokens_of_a_prefix(index, rows, library, chars):
    got = {(r.doc_id, r.n_chars): r.prefix_tokens for r in token_counts.tokens_of_prefix(index, F.lit(chars)).collect()}
    for i, text in rows:
        text = text or ""
        assert got[i, len(text)] == (plain_count(library, text[:chars]) if 0 <= chars <= len(text) else None)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, TOKENIZER).collect() == []


def test_other_vocabularies_are_refused():
    from freshet.llm.queries import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_query_counts_as_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), plain_count(library, text))
        assert r.over_limit == (r.n_tokens > 1024) and plain_count(library, text[: r.fits_chars]) <= 1024
