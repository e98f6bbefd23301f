"""Runs of repeated words: stretches of a text that repeat with a period.

Words are numbered and the suffixes of each text sorted (prefix doubling, many texts side by
side in arrays). From the sorted suffixes come longest common prefixes and their intervals; of
each interval of depth D, the suffixes of all children but the largest ask whether the suffix
D words on, or D words back, is in the same interval but in another child. Where it is, a square
(the same D words twice) begins that cannot be moved to the right: a branching tandem. Rotating
it to the left as far as the words agree gives the whole stretch with period D. Every stretch is
found so, with its smallest period and multiples of it; of the squares that span the same
stretch the smallest period stays. No tree is built: an interval is two numbers, and a child
ends where the next common prefix is not deeper.

A run holds at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods. Then the words at
distance of the period share at least 16 words, so a text in which no passage of 8 words occurs
twice has none and is done after three doublings.

Work is per text: nothing is shuffled and a lost task costs its own input. Memory follows the
longest text of a task.

Defined cases: a null or empty text has no words and no runs; words are cut at ASCII white
space only; rows that share an id, or have none, are answered one by one; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import only, records, ship

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words sorted side by side, about; a longer text is sorted by itself.
WORDS_TOGETHER = 1 << 19
#: A run has two suffixes that share twice as many words as this.
PASSAGE = 8

Run = tuple[int, int, int]


def double_once(rank: np.ndarray, open_at: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Sort suffixes that agree in ``k`` words by the next ``k``; ``rank`` (in place) is where a group
    starts in the order of all suffixes. Returns those that still share their rank with others."""
    onward = open_at + k
    inside = onward < ends
    second = np.where(inside, rank[np.where(inside, onward, 0)] + 1, 0)
    first = rank[open_at]
    order = np.lexsort((second, first))
    open_at, first, second = open_at[order], first[order], second[order]
    new_group = np.ones(len(order), bool)
    new_group[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    starts = np.flatnonzero(new_group)
    # a group's rank: where its old group starts, and how far into that it begins
    old_start = np.ones(len(order), bool)
    old_start[1:] = first[1:] != first[:-1]
    base = np.maximum.accumulate(np.where(old_start, np.arange(len(order)), 0))
    group_rank = first[starts] + (starts - base[starts])
    sizes = np.diff(np.append(starts, len(order)))
    rank[open_at] = np.repeat(group_rank, sizes)
    return open_at[np.repeat(sizes > 1, sizes)]


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of one text of word numbers and its inverse."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank, open_at = first_ranks(codes, order)
    k, ends = 1, np.full(n, n)
    while len(open_at):
        open_at = double_once(rank, open_at, ends[: len(open_at)], k)
        k *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank


def first_ranks(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the first word alone, and the places that share theirs."""
    ordered = keys[order]
    new_group = np.ones(len(keys), bool)
    new_group[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new_group)
    sizes = np.diff(np.append(starts, len(keys)))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.repeat(starts, sizes)
    return rank, order[np.repeat(sizes > 1, sizes)]


def repeats_a_passage(texts: Sequence[np.ndarray]) -> np.ndarray:
    """For each text of word numbers, whether some ``PASSAGE`` words occur twice in it."""
    sizes = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), sizes)
    codes = np.concatenate(texts)
    keys = text * (int(codes.max(initial=0)) + 1) + codes
    rank, open_at = first_ranks(keys, np.argsort(keys, kind="stable"))
    ends = np.repeat(np.cumsum(sizes), sizes)
    k = 1
    while k < PASSAGE and len(open_at):
        open_at = double_once(rank, open_at, ends[open_at], k)
        k *= 2
    found = np.zeros(len(texts), bool)
    found[text[open_at]] = True
    return found


def common_prefixes(codes: Sequence[int], suffixes: Sequence[int], place: Sequence[int]) -> list[int]:
    """Words that each suffix shares with the one sorted before it; the first shares none."""
    n, shared, out = len(codes), 0, [0] * len(codes)
    for at in range(n):
        where = place[at]
        if where == 0:
            shared = 0
            continue
        other = suffixes[where - 1]
        most = n - max(at, other)
        while shared < most and codes[at + shared] == codes[other + shared]:
            shared += 1
        out[where] = shared
        if shared:
            shared -= 1
    return out


def branching_tandems(suffixes: Sequence[int], place: Sequence[int], common: Sequence[int], deepest: int) -> list[tuple[int, int]]:
    """(D, start) of every square of D words, D at most ``deepest``, that cannot move right."""
    n, out = len(suffixes), []

    def close(depth: int, first: int, last: int, bounds: list[int]) -> None:
        # children are [bounds[c], bounds[c + 1]); suffixes of the largest one are only asked about
        if depth > deepest:
            return
        edges = [first, *bounds, last + 1]
        largest = max(range(len(edges) - 1), key=lambda c: edges[c + 1] - edges[c])
        for c in range(len(edges) - 1):
            if c == largest:
                continue
            low, high = edges[c], edges[c + 1]
            for at in suffixes[low:high]:
                onward, back = at + depth, at - depth
                if onward < n and first <= (p := place[onward]) <= last and not low <= p < high:
                    out.append((depth, at))
                if back >= 0 and first <= (p := place[back]) <= last and not low <= p < high:
                    out.append((depth, back))

    stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]  # depth, first suffix, where its further children begin
    for k in range(1, n + 1):
        depth, begin = common[k] if k < n else -1, k - 1
        while stack and stack[-1][0] > depth:
            closed, begin, bounds = stack.pop()
            close(closed, begin, k - 1, bounds)
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(k)
        elif depth > 0:
            stack.append((depth, begin, [k]))
    return out


def rotations(codes: np.ndarray, start: int, period: int) -> int:
    """How often the square at ``start`` moves left: words before it that equal the one a period on."""
    moved, step = 0, 64
    while moved < start:
        low, high = max(0, start - moved - step), start - moved
        differ = np.flatnonzero(codes[low:high] != codes[low + period : high + period])
        if len(differ):
            return moved + high - low - 1 - int(differ[-1])
        moved += high - low
        step *= 2
    return moved


def periodic_runs(codes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """Every run of a text of word numbers as (start, length, period), by start, then period."""
    n = len(codes)
    if n < max(least_words, least_periods):
        return []
    suffixes, place = sorted_suffixes(codes)
    order, where = suffixes.tolist(), place.tolist()
    common = common_prefixes(codes.tolist(), order, where)
    ending: dict[int, list[tuple[int, int]]] = {}
    # a square whose period is a multiple of a run's, and that ends with it, is of the same run
    for period, start in sorted(set(branching_tandems(order, where, common, n // least_periods))):
        known = ending.setdefault(start + 2 * period, [])
        if not any(period % smaller == 0 and begin <= start for begin, smaller in known):
            known.append((start - rotations(codes, start, period), period))
    runs = [(begin, end - begin, period) for end, found in ending.items() for begin, period in found]
    return sorted(((s, m, q) for s, m, q in runs if m >= max(least_words, least_periods * q)), key=lambda r: (r[0], r[2]))


def strongest(runs: Iterable[Run]) -> Run | None:
    """The run of most periods, compared as exact fractions; of equal ones the first, then that of least period."""
    best = None
    for run in runs:
        if best is None:
            best = run
            continue
        more = run[1] * best[2] - best[1] * run[2]
        if more > 0 or (more == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def collapsed(words: Sequence[bytes], runs: Iterable[Run]) -> bytes:
    """The text with one period of each run, words joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words if keep.all() else [words[k] for k in np.flatnonzero(keep).tolist()])


def numbered(words: Sequence[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "struct<start: long, length: long, period: long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN_SQL}>, strongest {RUN_SQL}, collapsed string"
NAMES = ["doc_id", "n_words", "runs", "strongest", "collapsed"]


def _runs_of(texts: Sequence[Sequence[bytes]]) -> list[list[Run]]:
    codes = [numbered(words) for words in texts]
    able = [k for k, c in enumerate(codes) if LEAST_WORDS <= len(c)]
    out: list[list[Run]] = [[] for _ in texts]
    if able:
        repeats = repeats_a_passage([codes[k] for k in able])
        for k in (k for k, r in zip(able, repeats.tolist(), strict=True) if r):
            out[k] = periodic_runs(codes[k])
    return out


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[list[bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        found = _runs_of(texts)
        as_dict = lambda run: run and dict(zip(("start", "length", "period"), run, strict=True))
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[as_dict(run) for run in runs] for runs in found], pa.list_(RUN)),
            pa.array([as_dict(strongest(runs)) for runs in found], RUN),
            pa.array([collapsed(t, runs) for t, runs in zip(texts, found, strict=True)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    for doc_id, text in records(batches, "doc_id", "text", step=64):
        words = (text or b"").split()
        ids.append(doc_id)
        texts.append(words)
        size += len(words) + 1
        if size > WORDS_TOGETHER:
            yield batch()
            ids, texts, size = [], [], 0
    if ids:
        yield batch()


def find_runs(documents: DataFrame) -> DataFrame:
    """Per document: its words, its runs by start, the strongest of them, and the text with each run's
    first period only."""
    ship(documents.sparkSession)
    rows = only(documents, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(_find, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """The runs of each document in a few columns."""
    line = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(best[c].alias(c) for c in ("start", "length", "period")),
        ((best["length"] * 1000 - best["length"] * 1000 % best["period"]) / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
