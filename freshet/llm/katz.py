"""Katz backoff language model: counted, discounted, normalised and applied in one family of exchanges.

A text's tokens are its words and one end. The n-gram of a token at order k is the
token with the k-1 before it; texts begin after a start mark that is only ever
context. Counts up to 5 are discounted by Good-Turing at every order; what that
frees at a context goes to the lower order by a backoff weight that makes the
context's probabilities sum to one exactly. The lowest order leaves its freed share
to one class of unknown words.

    P(w | h) = d(c(h w)) c(h w) / c(h)         where h w was seen
             = bow(h) P(w | h without its first word)   where h was seen, else
             = P(w | h without its first word)

How it runs. Each task packs its documents into chunks of some million tokens, which
are stored: numbers of local words, with a 64-bit hash per word. Whatever has to be
known over all chunks is asked for by one kind of exchange: every chunk sends its own
distinct keys with its own sums, cut into buckets of the hash; a bucket adds up; every
chunk gets its keys' totals back. Three such exchanges per order are needed at most:
the counts, and the sums at each context that give its backoff weight. A chunk sends a
key once however often it occurs, and hashes are even, so no key, word or source is
hot anywhere. The buckets' totals are the model's tables (order, bucket, keys, counts
and backoff weights).

n-grams are told apart by 64-bit hashes of their words.

Defined cases: a null or empty text is the end alone; a null id counts as the text
"" for the fold and keeps its row; repeated rows count and are scored each; without
training tokens there is one class of words with probability one, so scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import only, records, ship
from freshet.sources.workspace import fresh_path, give_back, stored

ORDER = 2
#: Counts up to this one are discounted.
DISCOUNTED = 5
CHUNK_TOKENS = 2_000_000
#: Keys of one bucket, about: what one task adds up at a time.
BUCKET_KEYS = 3_000_000

CHUNKS = "chunk long, documents long, tokens long, body binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each split into its byte planes, so that Zstandard finds the empty ones."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((a.itemsize, 0), np.uint8)
        body = zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)
        parts += [np.array([ord(a.dtype.kind), a.itemsize, len(a), len(body)], "<i8").tobytes(), body]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, width, n, length = np.frombuffer(blob, "<i8", 4, at).tolist()
        at += 32
        planes = np.frombuffer(zstandard.decompress(blob[at : at + length], max_output_size=width * n), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(width, n).T).view(f"<{chr(kind)}{width}").reshape(n))
        at += length
    return out


def pack_keys(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, most of whose high bytes are empty."""
    return np.diff(keys, prepend=np.uint64(0))


def unpack_keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of context and word from both keys; a bijection of the word for each context."""
    x = word ^ (context * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Documents of one task: per document id, held out, tokens; per token the number of its local word."""

    ids: np.ndarray
    has_id: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    hashes: np.ndarray

    @classmethod
    def read(cls, body: bytes) -> Chunk:
        return cls(*unpack(body))

    def __post_init__(self):
        self.word_keys = self.hashes[self.words]
        ends = np.cumsum(self.lengths)
        self.first = np.zeros(len(self.words), bool)
        self.first[(ends - self.lengths)[self.lengths > 0]] = True
        self.train = np.repeat(self.held == 0, self.lengths)

    def shifted(self, keys: np.ndarray) -> np.ndarray:
        """Of each token, the key of the one before it; the start mark at a text's beginning."""
        before = np.empty_like(keys)
        before[1:], before[:1] = keys[:-1], START
        before[self.first] = START
        return before

    def contexts(self, order: int) -> np.ndarray:
        """Of each token, the key of the ``order`` - 1 tokens before it."""
        if order == 1:
            return np.zeros(len(self.words), np.uint64)
        if order == 2:
            return self.shifted(self.word_keys)
        return self.shifted(self.grams(order - 1))

    def grams(self, order: int) -> np.ndarray:
        return self.word_keys if order == 1 else mixed(self.contexts(order), self.word_keys)

    def gram_places(self, order: int) -> np.ndarray:
        """Of each token, where its n-gram's key stands among the chunk's sorted distinct ones."""
        if order == 1:
            return _index_by_number(self.hashes, self.words)[1]
        return np.unique(self.grams(order), return_inverse=True)[1]

    def context_index(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys of the contexts, and of each token where its context stands among them."""
        if order > 2:
            return np.unique(self.contexts(order), return_inverse=True)
        before = np.roll(self.words, 1)
        before[self.first] = len(self.hashes)
        return _index_by_number(np.append(self.hashes, START), before)


def _index_by_number(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and places of keys that tokens name by number: only the few different ones are sorted."""
    occurs = np.zeros(len(keys), bool)
    occurs[numbers] = True
    places = np.zeros(len(keys), np.uint32)
    found, places[occurs] = np.unique(keys[occurs], return_inverse=True)
    return found, places[numbers]


def chunks_of(documents: DataFrame, held_out: Column) -> DataFrame:
    """Store the documents as chunks, bucketed by chunk: answers come to them, their bodies never move.
    A task has few chunks, so a bucket is written as they are, a file for each task at most."""
    spark = documents.sparkSession
    rows = only(documents, "doc_id", "text").select("doc_id", "text", held_out.cast("boolean").alias("held"))
    ship(spark)
    path, buckets = fresh_path(spark, "chunks"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "chunks_" + path.rsplit("-", 1)[1]
    rows.mapInArrow(_Tokenise(), CHUNKS).write.bucketBy(buckets, "chunk").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


class _Tokenise:
    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        local: dict[bytes, int] = {b"\n": 0}  # no word holds white space: this one is the end
        held, words, n = [], [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal made, held, words, n, local
            made += 1
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in local), np.uint64, len(local))
            hashes[0] = END
            ids, has, out, lengths = (np.array(c) for c in zip(*held, strict=True))
            body = pack(ids.astype("<i8"), has.astype("<u1"), out.astype("<u1"), lengths.astype("<u4"), np.concatenate(words), hashes)
            columns = ([(task << 32) + made], [len(held)], [n], [body])
            held, words, n, local = [], [], 0, {b"\n": 0}
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "documents", "tokens", "body"])

        for doc_id, text, out in records(batches, "doc_id", "text", "held", step=64):
            found = [local.setdefault(w, len(local)) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
            found.append(0)
            held.append((doc_id or 0, doc_id is not None, bool(out), len(found)))
            words.append(np.array(found, "<u4"))
            n += len(found)
            if n >= CHUNK_TOKENS:
                yield chunk()
        if held:
            yield chunk()


def _sorted_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of the values at each."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ranked[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


def _batch(names: Sequence[str], kinds: Sequence[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _bucketed(keys: np.ndarray, buckets: int) -> list[slice]:
    """Where each bucket's keys stand among sorted keys; buckets are ranges of the hash."""
    edges = [(k << 64) // buckets for k in range(1, buckets)]
    cuts = [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class _Ask:
    """A chunk's sums by key, sent to the buckets. ``what`` makes (keys, sums...) of a chunk."""

    what: object
    buckets: int

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, *bodies in records(batches, *self.what.columns, step=1):
            keys, *sums = self.what(*bodies)
            rows = [
                (number, bucket, pack(pack_keys(keys[at]), *(s[at] for s in sums)))
                for bucket, at in enumerate(_bucketed(keys, self.buckets))
                if at.stop > at.start
            ]
            for k in range(0, len(rows), 64):
                yield _batch(("chunk", "bucket", "body"), (pa.int64(), pa.int32(), pa.binary()), rows[k : k + 64])


def _answer(found: pd.DataFrame, what) -> pd.DataFrame:
    """One bucket: of each chunk's keys what ``what`` makes of the totals over chunks, and, where it
    asks for that, which chunk is a key's first.

    The row with chunk -1 holds the same of the bucket's distinct keys, and the keys."""
    found = found.sort_values("chunk")
    parts = [unpack(b) for b in found["body"]]
    keys = [unpack_keys(p[0]) for p in parts]
    merged = np.concatenate(keys)
    distinct, first, inverse = np.unique(merged, return_index=True, return_inverse=True)
    width = len(parts[0]) - 1
    totals = [np.zeros(len(distinct), parts[0][k + 1].dtype) for k in range(width)]
    for k, total in enumerate(totals):
        np.add.at(total, inverse, np.concatenate([p[k + 1] for p in parts]))
    totals = what.answer(*totals)
    leads = np.zeros(len(merged), np.uint8)
    leads[first] = 1
    rows, at, bucket = [], 0, found["bucket"].iloc[0]
    for number, own in zip(found["chunk"], keys, strict=True):
        part = slice(at, at + len(own))
        rows.append((number, bucket, pack(*([leads[part]] if what.leads else []), *(t[inverse[part]] for t in totals))))
        at += len(own)
    rows.append((-1, bucket, pack(pack_keys(distinct), *totals)))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "body"])


def exchange(chunks: DataFrame, what, keys: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Totals over all chunks of what each chunk sends: the answers per chunk (chunk, parts: the
    bodies in order of bucket), and the table (bucket, body: keys and totals).

    ``keys``: how many keys all chunks send, at most; it gives the number of buckets."""
    buckets = max(1, -(-keys // BUCKET_KEYS))
    asked = chunks.select(*what.columns).mapInArrow(_Ask(what, buckets), "chunk long, bucket int, body binary")
    answers = stored(asked.groupBy("bucket").applyInPandas(lambda found: _answer(found, what), "chunk long, bucket int, body binary"), name)
    back = answers.where("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "body"))).alias("parts"))
    return back.select("chunk", F.col("parts.body").alias("parts")), answers.where("chunk < 0").select("bucket", "body")


def joined(parts: Sequence[bytes]) -> list[np.ndarray]:
    """A chunk's answer over all buckets, in order of its sorted keys."""
    return [np.concatenate(c) for c in zip(*map(unpack, parts), strict=True)] if parts else []


@dataclass(frozen=True)
class Counts:
    """Training counts of the n-grams of one order; keys only held-out texts have are asked with 0."""

    order: int
    columns: tuple[str, ...] = ("chunk", "body")
    leads: bool = True

    @staticmethod
    def answer(counts: np.ndarray) -> tuple[np.ndarray, ...]:
        return (counts,)

    def __call__(self, body: bytes) -> tuple[np.ndarray, ...]:
        chunk = Chunk.read(body)
        return _sorted_sums(chunk.grams(self.order), chunk.train.astype("<u8"))


@dataclass(frozen=True)
class Discounts:
    """Of one order: by count up to DISCOUNTED, the share of it that is kept."""

    kept: tuple[float, ...]

    def of(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.kept, 1.0])
        return table[np.minimum(counts, len(self.kept) + 1)]


def good_turing(spectrum: dict[int, int]) -> Discounts:
    """From how many n-grams occur r times. Katz's renormalised Good-Turing ratios, kept where all
    lie in (0, 1]; else (few data) absolute discounting of the same counts."""
    n, k = lambda r: spectrum.get(r, 0), DISCOUNTED
    if all(n(r) for r in range(1, k + 2)):
        rest = (k + 1) * n(k + 1) / n(1)
        if rest < 1:
            kept = tuple(((r + 1) * n(r + 1) / (r * n(r)) - rest) / (1 - rest) for r in range(1, k + 1))
            if all(0 < d <= 1 for d in kept) and any(d < 1 for d in kept):
                return Discounts(kept)
    off = n(1) / (n(1) + 2 * n(2)) if n(1) and n(2) else 0.5
    return Discounts(tuple((r - off) / r for r in range(1, k + 1)))


@dataclass(frozen=True)
class Totals:
    """What the whole corpus has: training tokens, distinct ones, and per order the discounts."""

    tokens: int
    distinct: int
    unknown: float
    discounts: tuple[Discounts, ...]


def _spectrum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (body,) in records(batches, "body", step=1):
        counts = unpack(body)[1]
        counts = counts[counts > 0]
        small = np.bincount(counts[counts <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
        rows = [(r, int(small[r]), 0) for r in range(1, DISCOUNTED + 2)] + [(0, len(counts), int(counts.sum()))]
        yield _batch(("r", "n", "tokens"), (pa.int64(),) * 3, rows)


def spectrum_of(table: DataFrame) -> dict[int, int]:
    """How many n-grams occur r times, for small r; under 0 all of them, under -1 their tokens. A few numbers."""
    rows = table.mapInArrow(_spectrum, "r long, n long, tokens long").groupBy("r").agg(F.sum("n").alias("n"), F.sum("tokens").alias("t")).collect()
    out = {r.r: r.n for r in rows}
    return out | {-1: next((r.t for r in rows if r.r == 0), 0)}


def lowest(counts: np.ndarray, totals: Totals) -> np.ndarray:
    """Probabilities of order 1; an unknown word has the share left to its class."""
    if not totals.tokens:
        return np.ones(len(counts))
    return np.where(counts > 0, totals.discounts[0].of(counts) * counts / totals.tokens, totals.unknown)


def _aligned(places: np.ndarray, values: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Values given per sorted distinct key, per token."""
    return [v[places] for v in values]


def _probabilities(chunk: Chunk, totals: Totals, order: int, answers: Sequence[Sequence[bytes]]) -> np.ndarray:
    """Per token of a chunk its probability at ``order``. ``answers``: counts of order 1, then
    counts and context sums of each order after it."""
    _, counts = joined(answers[0])
    p = lowest(counts, totals)[chunk.gram_places(1)]
    for k in range(2, order + 1):
        _, counts = _aligned(chunk.gram_places(k), joined(answers[2 * k - 3]))
        base, bow = _aligned(chunk.context_index(k)[1], joined(answers[2 * k - 2]))
        p *= bow
        del bow
        base = totals.discounts[k - 1].of(counts) * counts / base
        p = np.where(counts > 0, base, p)
    return p


def backoff(seen: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context, from its count, its discounted count and the lower order's share of the words
    seen after it: the divisor of its counts and its backoff weight. Where no count was small enough
    to be discounted, one more observation is allowed for, so that something is left for the rest.
    A context not seen leaves all to the lower order."""
    base = np.where(seen - kept > 1e-9 * np.maximum(seen, 1), seen, seen + 1.0)
    base = np.maximum(base, 1)
    left = 1.0 - kept / base
    return base, np.where(seen > 0, left / np.maximum(1.0 - lower, 1e-15), 1.0)


@dataclass(frozen=True)
class Contexts:
    """Sums at each context of one order, of every distinct n-gram once: its first chunk sends it.
    The answer is the divisor and the backoff weight they give."""

    order: int
    totals: Totals
    leads: bool = False
    answer = staticmethod(backoff)

    @property
    def columns(self) -> tuple[str, ...]:
        return ("chunk", "body", *(f"a{k}" for k in range(2 * self.order - 2)))

    def __call__(self, body: bytes, *answers: Sequence[bytes]) -> tuple[np.ndarray, ...]:
        chunk = Chunk.read(body)
        _, at = np.unique(chunk.grams(self.order), return_index=True)
        leads, counts = joined(answers[2 * self.order - 3])
        own = (leads > 0) & (counts > 0)
        at, counts = at[own], counts[own]
        lower = _probabilities(chunk, self.totals, self.order - 1, answers)[at]
        kept = self.totals.discounts[self.order - 1].of(counts) * counts
        keys, places = chunk.context_index(self.order)
        places = places[at]
        return keys, *(np.bincount(places, v, len(keys)) for v in (counts, kept, lower))


@dataclass(frozen=True)
class _Score:
    order: int
    totals: Totals

    @property
    def columns(self) -> tuple[str, ...]:
        return ("body", *(f"a{k}" for k in range(2 * self.order - 1)))

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body, *answers in records(batches, *self.columns, step=1):
            chunk = Chunk.read(body)
            p = _probabilities(chunk, self.totals, self.order, answers)
            _, counts = _aligned(chunk.gram_places(1), joined(answers[0]))
            base = np.log10((counts.astype(float) + 1) / (self.totals.tokens + self.totals.distinct + 1))
            starts = np.cumsum(chunk.lengths, dtype=np.int64) - chunk.lengths
            add = lambda values: np.add.reduceat(values, starts)
            columns = [
                pa.array(chunk.ids, pa.int64(), mask=chunk.has_id == 0),
                pa.array(chunk.held == 1),
                pa.array(chunk.lengths.astype(np.int64)),
                pa.array(add((counts > 0).astype(np.int64))),
                pa.array(np.full(len(chunk.ids), self.totals.tokens, np.int64)),
                pa.array(add(base)),
                pa.array(add(np.log10(p))),
            ]
            for at in range(0, len(chunk.ids), 8192):
                yield pa.RecordBatch.from_arrays([c.slice(at, 8192) for c in columns], SCORES.replace(",", "").split()[::2])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Trained:
    """Chunks with all their answers, what the corpus has, and the model's tables by order."""

    chunks: DataFrame
    totals: Totals
    counts: tuple[DataFrame, ...]
    contexts: tuple[DataFrame, ...]

    def scores(self) -> DataFrame:
        order = len(self.counts)
        score = _Score(order, self.totals)
        return self.chunks.select(*score.columns).mapInArrow(score, SCORES)


def train(documents: DataFrame, held_out: Column, order: int = ORDER) -> Trained:
    """Learn from the documents ``held_out`` is not true of, and make ready to score all of them."""
    chunks = chunks_of(documents, held_out)
    tokens = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    counts, contexts, discounts, have = [], [], [], chunks
    totals = Totals(0, 0, 1.0, ())

    def answered(asking: DataFrame, what, name: str) -> DataFrame:
        nonlocal have
        back, table = exchange(asking, what, tokens, name)
        have = have.join(back.withColumnRenamed("parts", f"a{len(have.columns) - len(chunks.columns)}"), "chunk")
        give_back(documents.sparkSession)  # what the chunks sent is in the stored answers now
        return table

    for k in range(1, order + 1):
        counts.append(answered(chunks, Counts(k), f"counts-{k}"))
        seen = spectrum_of(counts[-1])
        discounts.append(good_turing(seen))
        if k == 1:
            small = sum(r * seen.get(r, 0) * (1 - discounts[0].of(np.array([r]))[0]) for r in range(1, DISCOUNTED + 1))
            unknown = small / seen[-1] if seen[-1] else 1.0
            if seen[-1] and unknown <= 0:  # every word is frequent: leave the unknown class one observation
                unknown = 1 / (seen[-1] + 1)
            totals = Totals(seen[-1], seen.get(0, 0), unknown, ())
        totals = Totals(totals.tokens, totals.distinct, totals.unknown, tuple(discounts))
        if k > 1:
            contexts.append(answered(have, Contexts(k, totals), f"contexts-{k}"))
    return Trained(have, totals, tuple(counts), tuple(contexts))


def score_documents(documents: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one order 1)
    and score, the model's log10 probability."""
    return train(documents, held_out, order).scores()


def _table_rows(order: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, body in records(batches, "bucket", "body", step=1):
            steps, counts = unpack(body)
            keys, seen = unpack_keys(steps).view(np.int64), counts > 0
            columns = [pa.array(np.full(seen.sum(), order)), pa.array(np.full(seen.sum(), bucket)), pa.array(keys[seen]), pa.array(counts[seen].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["order", "bucket", "key", "count"])

    return rows


def ngram_table(trained: Trained) -> DataFrame:
    """The counts as rows (order, bucket, key, count), to be written partitioned by order and bucket."""
    parts = [t.mapInArrow(_table_rows(k + 1), "order long, bucket long, key long, count long") for k, t in enumerate(trained.counts)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
