"""Exact token counts of every prefix of every text, stored once.

Byte-level BPE is counted by dynamic programming over prefixes. The encoding of a prefix
ends in exactly one token: the one token ``t`` ending there whose neighbour, the last token
of the prefix before ``t``, stays beside ``t`` when the two are encoded together. So

    count[i] = count[i - len(t)] + 1

and no prefix is encoded anew. The library's word rule cuts a text into words first; the
last word of a prefix may be cut otherwise than in the whole text in two places (inside a
run of white space, and in contractions of three characters), and those prefixes are
counted by the cut that they have themselves. A special token's name counts one; a prefix
that ends inside such a name counts what is there as ordinary text, as the library does.

``index_prefixes`` stores, per document, the change of the count at each code point, in
segments of 4,096 code points that also carry the count before them and their least count.
``longest_prefix`` (truncation to a budget) and ``tokens_of_prefix`` read one segment of a
document and never encode. Work is per row: nothing is shuffled, and a lost task costs its
own input.

Defined cases: a null text is an empty one; an empty text has no tokens; rows that share
an id, or have none, are answered one by one; an empty table gives no rows. A budget below
0 has no prefix (null), a position outside a text no count (null).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import only, records, ship
from freshet.sources.workspace import stored

#: Code points of one stored segment.
SEGMENT = 4096
#: Stretches and words whose counts a worker remembers (emptied when full), and slots for pairs of tokens.
STRETCHES, WORDS, PAIRS = 400_000, 300_000, 1 << 20
#: Longer stretches are not remembered; longer words are counted one by one.
LONG_STRETCH, LONG_WORD = 64, 40
#: Words counted side by side, at most.
TOGETHER = 1 << 15
#: No word of the word rule goes over such a place, nor does a run of white space.
CUTS = re.compile(r"(?<=\S)(?= [!-~À-ÿ])")
AT_CUT = re.compile(r" [!-~À-ÿ]")
#: What makes a prefix cut its last word otherwise than the text does.
UNEVEN = re.compile(r"\s\s|'re|'ve|'ll")
# Unicode's white space, and the contractions of three characters the word rule keeps whole.
WHITE = frozenset(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LONG_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
CHANGE = np.dtype("<i2")


def byte_of_letter() -> np.ndarray:
    """The byte a vocabulary letter stands for: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(own))
    table = np.zeros(256 + len(others), np.uint8)
    table[own] = own
    table[256:] = others
    return table


class PrefixCounter:
    """Prefix counts of whole texts for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        words = tokenizer.pre_tokenizer
        if not isinstance(words, pre_tokenizers.ByteLevel) or words.add_prefix_space or not words.use_regex or tokenizer.normalizer:
            raise ValueError("prefix counts need a byte-level vocabulary with its usual word rule")
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("an added token that takes in its surroundings has no prefix counts")
        self.rule, self.model = words, tokenizer.model
        names = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        ids = {t: i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if i not in added}
        self.names = {i: t for t, i in ids.items()}
        self.bytes = byte_of_letter()
        self._grow_trie(ids)
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _grow_trie(self, ids: dict[str, int]) -> None:
        """Steps from a state by a byte (state 0: no token goes on so), and the token of a state (-1: none)."""
        steps, tokens = [{}, {}], [-1, -1]
        for name, token in ids.items():
            at = 1
            for byte in self.bytes[[ord(c) for c in name]].tolist():
                into = steps[at].get(byte)
                if into is None:
                    into = steps[at][byte] = len(steps)
                    steps.append({})
                    tokens.append(-1)
                at = into
            tokens[at] = token
        self.step = np.zeros((len(steps), 256), np.int32)
        for at, found in enumerate(steps):
            if found:
                self.step[at, list(found)] = list(found.values())
        self.token = np.array(tokens, np.int32)

    def changes(self, texts: Sequence[str]) -> list[np.ndarray]:
        """For each code point of each text, how the count changes when the prefix takes it in."""
        special = [bool(self.special and self.special.search(text)) for text in texts]
        plain = iter(self._plain([text for text, s in zip(texts, special, strict=True) if not s]))
        return [self._with_names(text) if s else next(plain) for text, s in zip(texts, special, strict=True)]

    def _with_names(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for found in self.special.finditer(text):
            # inside the name a prefix has ordinary text, together with what stands before it
            (plain,) = self._plain([text[at : found.start()] + found.group()[:-1]])
            before = int(plain[: found.start() - at].sum(dtype=np.int64))
            parts += [plain, np.array([before + 1 - int(plain.sum(dtype=np.int64))], CHANGE)]
            at = found.end()
        return np.concatenate([*parts, *self._plain([text[at:]])])

    def _plain(self, texts: Sequence[str]) -> list[np.ndarray]:
        cut = [CUTS.split(text) for text in texts]
        if len(self.stretches) > STRETCHES:
            self.stretches.clear()
        known, later = self.stretches, {}
        new = {stretch for parts in cut for stretch in parts if stretch not in known}
        learnt = self._learn(new)
        for stretch, packed in learnt:
            (known if len(stretch) <= LONG_STRETCH else later)[stretch] = packed
        if later:
            return [np.frombuffer(b"".join([known[s] if s in known else later[s] for s in parts]), CHANGE) for parts in cut]
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)), CHANGE) for parts in cut]

    def _learn(self, new: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Changes of stretches. Those that begin at a cut are given to the word rule as one text."""
        even, alone = [], []
        for stretch in new:
            (even if AT_CUT.match(stretch) and not UNEVEN.search(stretch) and not stretch[-1].isspace() else alone).append(stretch)
        cut = [word for at in range(0, len(even), 2000) for word, _ in self.rule.pre_tokenize_str("".join(even[at : at + 2000]))]
        cut_alone = [[word for word, _ in self.rule.pre_tokenize_str(stretch)] for stretch in alone]
        self._learn_words({*cut, *(word for words in cut_alone for word in words)})
        nth, known = 0, self.words
        for stretch in even:
            left, first = len(stretch) if stretch.isascii() else len(stretch.encode()), nth
            while left > 0:
                left -= len(cut[nth])
                nth += 1
            yield stretch, known[cut[first]] if nth == first + 1 else b"".join(map(known.__getitem__, cut[first:nth]))
        for stretch, words in zip(alone, cut_alone, strict=True):
            yield stretch, self._uneven(stretch, words) if UNEVEN.search(stretch) else b"".join(map(known.__getitem__, words))

    def _uneven(self, text: str, words: Sequence[str]) -> bytes:
        """Changes inside a stretch where a prefix may cut its last word otherwise than the stretch does."""
        parts, at, run = [], 0, None  # run: where the white space now running began, and the count there
        total = 0
        for word in words:
            own = np.frombuffer(self._word(word), CHANGE)
            plain = text[at : at + len(own)]
            counts = total + np.cumsum(own, dtype=np.int64)
            blank = next((k for k, c in enumerate(plain) if c not in WHITE), len(plain))
            if plain in LONG_CONTRACTIONS:
                counts[1] += 1 - int(own[1])
            elif blank:
                run = run or (at, total)
                if at > run[0]:
                    # a prefix that ends in the run has all of it as one word
                    whole = [w for w, _ in self.rule.pre_tokenize_str(text[run[0] : at + blank])]
                    counts[:blank] = run[1] + np.cumsum(np.frombuffer(self._word(whole[0]), CHANGE), dtype=np.int64)[at - run[0] :]
            if blank < len(plain):
                run = None
            total += int(own.sum(dtype=np.int64))
            parts.append(counts)
            at += len(own)
        return np.diff(np.concatenate([[0], *parts])).astype(CHANGE).tobytes() if parts else b""

    def _word(self, word: str) -> bytes:
        if word not in self.words:
            self._learn_words({word})
        return self.words[word]

    def _learn_words(self, words: set[str]) -> None:
        if len(self.words) > WORDS:
            self.words = {word: self.words[word] for word in words if word in self.words}
        by_length: dict[int, list[str]] = {}
        known = self.words
        for word in words:
            if word not in known:
                by_length.setdefault(len(word), []).append(word)
        for length, found in by_length.items():
            step = TOGETHER if length <= LONG_WORD else 1
            for at in range(0, len(found), step):
                part = found[at : at + step]
                letters = np.frombuffer("".join(part).encode("utf-16-le"), "<u2").reshape(len(part), length)
                given = self.bytes[letters]
                counts = self._long_word(given[0]) if length > LONG_WORD else self._count(given)
                ends = np.ones(given.shape, bool)
                ends[:, :-1] = (given[:, 1:] & 0xC0) != 0x80
                there, sizes = counts[:, 1:][ends], ends.sum(axis=1)
                before = np.concatenate([[0], there[:-1]])
                upto = np.cumsum(sizes)
                before[upto[:-1]] = 0
                packed = (there - before).astype(CHANGE).tobytes()
                for word, size, to in zip(part, (sizes * CHANGE.itemsize).tolist(), (upto * CHANGE.itemsize).tolist(), strict=True):
                    known[word] = packed[to - size : to]

    def _count(self, given: np.ndarray) -> np.ndarray:
        """Counts of all prefixes of words of one length, side by side: for each end, the longest token
        that fits beside the last one of the prefix before it."""
        n, length = given.shape
        last, count = np.zeros((n, length + 1), np.int64), np.zeros((n, length + 1), np.int32)
        states = np.ones((n, length), np.int32)
        for end in range(1, length + 1):
            states[:, :end] = self.step[states[:, :end], given[:, end - 1, None]]
            tokens = self.token[states[:, :end]]
            left = np.arange(n)
            for start in range(end):
                here = left[tokens[left, start] >= 0]
                if not len(here):
                    continue
                token = tokens[here, start].astype(np.int64)
                if start:
                    fits = self._fit(last[here, start] << 32 | token)
                    here, token = here[fits], token[fits]
                last[here, end] = token
                count[here, end] = count[here, start] + 1
                left = left[count[left, end] == 0]
                if not len(left):
                    break
            if len(left):
                raise ValueError("a byte has no token in the vocabulary")
        return count

    def _long_word(self, given: np.ndarray) -> np.ndarray:
        """The same for one word of any length; only starts from which a token still goes on are looked at."""
        last, count = np.zeros(len(given) + 1, np.int64), np.zeros((1, len(given) + 1), np.int32)
        starts, states = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for end in range(1, len(given) + 1):
            states = self.step[np.append(states, 1), given[end - 1]]
            starts = np.append(starts, end - 1)[states > 0]
            states = states[states > 0]
            tokens = self.token[states]
            for k in np.flatnonzero(tokens >= 0).tolist():
                start, token = int(starts[k]), int(tokens[k])
                if start == 0 or self._fit(np.array([last[start] << 32 | token]))[0]:
                    last[end], count[0, end] = token, count[0, start] + 1
                    break
            else:
                raise ValueError("a byte has no token in the vocabulary")
        return count

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether two tokens stay side by side when their text is encoded as one word."""
        slots = (pairs * np.int64(-7046029254386353131) >> 44) & (PAIRS - 1)
        fits = self.pair_fits[slots]
        missed = np.flatnonzero(self.pair_keys[slots] != pairs)
        if len(missed):
            asked, back = np.unique(pairs[missed], return_inverse=True)
            names, found = self.names, np.zeros(len(asked), bool)
            for k, pair in enumerate(asked.tolist()):
                first, second = pair >> 32, pair & 0xFFFFFFFF
                found[k] = [t.id for t in self.model.tokenize(names[first] + names[second])] == [first, second]
            fits[missed] = found[back]
            # a slot holds one pair: key and answer are of the same one, whichever is written last
            slot, nth = np.unique(slots[missed], return_index=True)
            self.pair_keys[slot], self.pair_fits[slot] = pairs[missed][nth], fits[missed][nth]
        return fits


@lru_cache(maxsize=1)
def counter_of(path: str) -> PrefixCounter:
    """One per worker: what it remembers serves the worker's later tasks too."""
    return PrefixCounter(path)


SEGMENT_TYPE = pa.struct([("before", pa.int64()), ("low", pa.int64()), ("changes", pa.binary())])
NAMES = ["doc_id", "n_bytes", "n_chars", "n_tokens", "segments"]
INDEX = "doc_id long, n_bytes long, n_chars long, n_tokens long, segments array<struct<before: long, low: long, changes: binary>>"


def segments_of(changes: np.ndarray) -> tuple[int, list[dict]]:
    """The count of the whole, and per segment: the count before it, its least count, its changes."""
    total, out = 0, []
    for at in range(0, len(changes), SEGMENT):
        part = changes[at : at + SEGMENT]
        counts = total + np.cumsum(part, dtype=np.int64)
        out.append({"before": total, "low": int(counts.min()), "changes": part.tobytes()})
        total = int(counts[-1])
    return total, out


def index_prefixes(documents: DataFrame, tokenizer: str) -> DataFrame:
    """The stored prefix counts of every document. ``tokenizer`` is a file every worker can open."""
    ship(documents.sparkSession)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            texts = [text or "" for _, text in held]
            rows = [(doc_id, len(text.encode()), len(text), *segments_of(part)) for (doc_id, _), text, part in zip(held, texts, counter.changes(texts), strict=True)]
            kinds = [pa.int64()] * 4 + [pa.list_(SEGMENT_TYPE)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

        for row in records(batches, "doc_id", "text", step=64):
            held.append(row)
            size += len(row[1] or "")
            if size > 1 << 20 or len(held) >= 2000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return stored(only(documents, "doc_id", "text").mapInArrow(build, INDEX), "prefix-counts")


def _segment(index: DataFrame, at: Column) -> tuple[Column, Column]:
    """The count before segment number ``at`` (from 1; none: null) and its changes; no other leaves the JVM."""
    one = F.try_element_at(index["segments"], F.coalesce(at, F.lit(1 << 30)).cast("int"))
    return F.coalesce(one["before"], F.lit(0)), F.coalesce(one["changes"], F.lit(b""))


def longest_prefix(index: DataFrame, budget: Column, name: str = "fits_chars") -> DataFrame:
    """Add the code points of the longest prefix that has at most ``budget`` tokens.

    Counts may fall as a prefix grows, so the longest one lies in the last segment whose least
    count is within the budget."""

    @F.pandas_udf("long")
    def within(budget: pd.Series, at: pd.Series, before: pd.Series, changes: pd.Series) -> pd.Series:
        out = []
        for b, k, start, packed in zip(budget, at, before, changes, strict=True):
            counts = start + np.cumsum(np.frombuffer(packed, CHANGE), dtype=np.int64)
            fits = np.flatnonzero(counts <= b)
            out.append(int((k - 1) * SEGMENT + fits[-1] + 1) if len(fits) else 0)
        return pd.Series(out, dtype="int64")

    ship(index.sparkSession)
    budget = budget.cast("long")
    at = F.array_max(F.transform("segments", lambda s, i: F.when(s["low"] <= budget, i + 1)))
    before, changes = _segment(index, at)
    # a text within the budget is its own longest prefix and asks nothing of the worker
    whole = index["n_tokens"] <= budget
    asked = within(F.coalesce(budget, F.lit(0)), F.coalesce(F.when(whole, None).otherwise(at), F.lit(0)), before, F.when(whole, F.lit(b"")).otherwise(changes))
    return index.withColumn(name, F.when(whole, F.col("n_chars")).when(budget >= 0, asked))


def tokens_of_prefix(index: DataFrame, chars: Column, name: str = "prefix_tokens") -> DataFrame:
    """Add the tokens of the first ``chars`` code points."""

    @F.pandas_udf("long")
    def upto(inside: pd.Series, before: pd.Series, changes: pd.Series) -> pd.Series:
        sums = (int(np.frombuffer(packed, CHANGE)[:n].sum(dtype=np.int64)) + start for n, start, packed in zip(inside, before, changes, strict=True))
        return pd.Series(list(sums), dtype="int64")

    ship(index.sparkSession)
    chars = chars.cast("long")
    at = F.when((chars > 0) & (chars <= F.col("n_chars")), F.ceil(chars / SEGMENT))
    before, changes = _segment(index, at)
    inside = F.coalesce(chars - (at - 1) * SEGMENT, F.lit(0))
    return index.withColumn(name, F.when(chars == 0, F.lit(0).cast("long")).when(at.isNotNull(), upto(inside, before, changes)))


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Per document, from its stored prefix counts: bytes, tokens, whether they are over the limit,
    and how many code points may stay for the rest to be within it."""
    found = longest_prefix(index_prefixes(documents, tokenizer), F.lit(limit))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits_chars")
