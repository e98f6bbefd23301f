"""Exact top-k inner products on a bit-sliced index.

A vector's components are quantised to integers. The index cuts the rows, in id
order, into blocks and stores for each block and component one bitmap per binary
digit ("slice") of component minus the block's smallest. A query's score is a sum of
shifted slices, formed for all rows of a block at once with bitmap arithmetic:
three numbers become two by exclusive-or and majority until two are left, which a
ripple of carries joins. A query component's digits are signed (no two neighbours
set), and a negative digit adds the complement, so every addend is a bitmap of
non-negative numbers and what they are off by is one constant.

The best k rows are found on the sum's slices from the most significant one down:
rows with the digit set are in while at most k are, else only they stay candidates.
Rows left at the boundary have equal scores, and the smaller ids of them are taken.
Blocks are merged by score and id.

Defined cases: vectors that are null, empty, hold a null, NaN or infinity, or whose
length differs from the query's take no part; rows with a null id neither; rows
with the query's id are its own and no candidates; repeated rows are candidates
each. Scores must fit 62 bits, or the index says so.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import only, ship
from freshet.sources.workspace import stored

SCALE = 1024
#: Rows of a block: a bitmap is 2 KB, and the bitmaps of one step stay in the processor's cache.
BLOCK_ROWS = 16_384
#: Queries that meet a block together.
QUERY_ROWS = 64

INDEX = "block long, width int, ids binary, least binary, counts binary, slices binary"


def slices_of(values: np.ndarray) -> np.ndarray:
    """Non-negative integers (rows, width) as bitmaps (width, digits, words), least digit first."""
    rows, width = values.shape
    digits = max(1, int(values.max(initial=0)).bit_length())
    bits = (values.T[:, None, :] >> np.arange(digits)[None, :, None]) & 1
    padded = np.zeros((width, digits, -(-rows // 64) * 64), np.uint8)
    padded[:, :, :rows] = bits
    return np.packbits(padded, axis=2, bitorder="little").view("<u8")


def signed_digits(values: np.ndarray) -> list[np.ndarray]:
    """Signed binary digits of integers, least first: each an array of -1, 0 and 1."""
    out, rest = [], values.astype(np.int64)
    while rest.any():
        digit = np.where(rest & 1, 2 - (rest & 3), 0)
        out.append(digit)
        rest = (rest - digit) >> 1
    return out


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two numbers held as slices (digits, words)."""
    n = max(len(a), len(b)) + 1
    out, carry = np.zeros((n, a.shape[1]), np.uint64), np.zeros(a.shape[1], np.uint64)
    for k in range(n):
        x = a[k] if k < len(a) else None
        y = b[k] if k < len(b) else None
        if x is None and y is None:
            out[k] = carry
            return out[: k + 1]
        if x is None or y is None:
            z = y if x is None else x
            out[k], carry = z ^ carry, z & carry
        else:
            both = x ^ y
            out[k], carry = both ^ carry, (x & y) | (both & carry)
    return out


def total(addends: np.ndarray) -> np.ndarray:
    """The sum of numbers held as slices (numbers, digits, words)."""
    while len(addends) > 2:
        n = len(addends) // 3
        a, b, c = addends[:n], addends[n : 2 * n], addends[2 * n : 3 * n]
        both = a ^ b
        rest = addends[3 * n :]
        out = np.zeros((2 * n + len(rest), addends.shape[1] + 1, addends.shape[2]), np.uint64)
        out[:n, :-1] = both ^ c
        out[n : 2 * n, 1:] = (a & b) | (both & c)
        out[2 * n :, :-1] = rest
        addends = out
    return _add(addends[0], addends[1]) if len(addends) == 2 else addends[0]


@dataclass
class Block:
    """One block of the index."""

    ids: np.ndarray
    least: np.ndarray
    slices: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        least = values.min(axis=0)
        parts = slices_of(values - least)
        return cls(ids, least, list(parts))

    @classmethod
    def read(cls, ids: bytes, least: bytes, counts: bytes, slices: bytes) -> Block:
        ids, least = np.frombuffer(ids, "<i8"), np.frombuffer(least, "<i8")
        digits, words = np.frombuffer(counts, "<i4"), -(-len(ids) // 64)
        flat = np.frombuffer(slices, "<u8").reshape(-1, words)
        ends = np.cumsum(digits)
        return cls(ids, least, [flat[e - d : e] for d, e in zip(digits, ends, strict=True)])

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        counts = np.array([len(s) for s in self.slices], "<i4")
        return self.ids.astype("<i8").tobytes(), self.least.astype("<i8").tobytes(), counts.tobytes(), np.concatenate(self.slices).astype("<u8").tobytes()

    def stacked(self) -> np.ndarray:
        """All components with as many slices as the longest has, (width, digits, words)."""
        digits = max(len(s) for s in self.slices)
        out = np.zeros((len(self.slices), digits, self.slices[0].shape[1]), np.uint64)
        for k, s in enumerate(self.slices):
            out[k, : len(s)] = s
        return out

    def scores(self, query: np.ndarray, stack: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of a non-negative number per row, and what to add to it for the score."""
        digits, top = stack.shape[1], (1 << stack.shape[1]) - 1
        constant = int(np.dot(query.astype(object), self.least.astype(object)))
        result = np.zeros((1, stack.shape[2]), np.uint64)
        for place, digit in enumerate(signed_digits(query)):
            plus, minus = np.flatnonzero(digit > 0), np.flatnonzero(digit < 0)
            if not len(plus) + len(minus):
                continue
            constant -= (top << place) * len(minus)
            part = total(np.concatenate([stack[plus], ~stack[minus]]))
            shifted = np.zeros((place + len(part), stack.shape[2]), np.uint64)
            shifted[place:] = part
            result = _add(result, shifted)
        assert digits
        return result, constant

    def best(self, query_id: int, query: np.ndarray, k: int, stack: np.ndarray) -> Iterator[tuple[int, int]]:
        """(id, score) of the k best rows, ties to the smaller id: rows stand in id order."""
        slices, constant = self.scores(query, stack)
        rows = len(self.ids)
        open_rows = np.packbits(np.pad((self.ids != query_id).astype(np.uint8), (0, -rows % 64)), bitorder="little").view("<u8")
        taken = np.zeros_like(open_rows)
        for s in slices[::-1]:
            high = open_rows & s
            n = int(np.bitwise_count(taken | high).sum())
            if n > k:
                open_rows = high
            else:
                taken, open_rows = taken | high, open_rows & ~s
            if n == k:
                open_rows = np.zeros_like(taken)
                break
        bits = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        sure = bits(taken)
        chosen = np.concatenate([sure, bits(open_rows)[: max(0, k - len(sure))]])
        for row in chosen:
            value = sum(((int(s[row >> 6]) >> int(row & 63)) & 1) << place for place, s in enumerate(slices))
            yield int(self.ids[row]), value + constant


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one width become blocks; a task holds one block's rows."""
    task, made, held = TaskContext.get().partitionId(), 0, []

    def block() -> pa.RecordBatch:
        nonlocal made, held
        ids, values = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        ids, values, held = ids[:BLOCK_ROWS], values[:BLOCK_ROWS], [(ids[BLOCK_ROWS:], values[BLOCK_ROWS:])] if len(ids) > BLOCK_ROWS else []
        packed = Block.of(ids, values).packed()
        made += 1
        columns = [[(task << 32) + made], [values.shape[1]], *([x] for x in packed)]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], INDEX.replace(",", "").split()[::2])

    for batch in batches:
        widths, ids = batch.column("width").to_numpy(), batch.column("vec_id").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            values = _matrix(batch.column("q").slice(a, b - a), int(widths[a]))
            if held and held[0][1].shape[1] != values.shape[1]:
                yield block()
            held.append((ids[a:b], values))
            while sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                yield block()
    if held and len(held[0][0]):
        yield block()


@dataclass(frozen=True)
class _Search:
    k: int

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, stack = None, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                if row["block"].as_py() != last:
                    last = row["block"].as_py()
                    block = Block.read(*(row[c].as_py() for c in ("ids", "least", "counts", "slices")))
                    stack = block.stacked()
                names = np.frombuffer(row["query_ids"].as_py(), "<i8")
                queries = np.frombuffer(row["queries"].as_py(), "<i8").reshape(len(names), -1)
                found = [(int(q), i, s) for q, v in zip(names, queries, strict=True) for i, s in block.best(int(q), v, self.k, stack)]
                if found:
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in groups of QUERY_ROWS of one width, packed."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        widths, ids = batch.column("width").to_numpy(), batch.column("vec_id").to_numpy()
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            for at in range(0, len(rows), QUERY_ROWS):
                part = rows[at : at + QUERY_ROWS]
                values = _matrix(batch.column("q").take(pa.array(part)), int(width))
                made += 1
                columns = [[(task << 32) + made], [int(width)], [ids[part].astype("<i8").tobytes()], [values.astype("<i8").tobytes()]]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["group", "width", "query_ids", "queries"])


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, width and q: floor(scale * x) of every component x of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (
        only(vectors, "vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("width"), whole.alias("q"))
    )


def build_index(rows: DataFrame) -> DataFrame:
    """Store the blocks of quantised rows. Rows are dealt by ranges of (width, id, content), so
    that even an id that holds a third of them is spread over blocks."""
    ship(rows.sparkSession)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(q, 0D, (m, x) -> greatest(m, abs(double(x))))")).alias("most"), F.max("width").alias("width")).first()
    if size.n and 2 * size.most * size.most * size.width * 4 >= 2.0**62:
        raise ValueError("scores of these vectors do not fit 62 bits; use a smaller scale")
    parts = max(1, -(-size.n // BLOCK_ROWS))
    dealt = rows.withColumn("digest", F.xxhash64("q")).repartitionByRange(parts, "width", "vec_id", "digest")
    return stored(dealt.sortWithinPartitions("width", "vec_id", "digest").mapInArrow(_build, INDEX), "bit-slices")


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query (vec_id, width, q) its k best rows of the index: query_id, rank, vec_id, score.

    Groups of queries meet every block: each group is repeated once per block and joined on the
    block's number. A group is some KB, so it is the groups that are repeated and not the blocks.
    """
    ship(index.sparkSession)
    groups = stored(queries.mapInArrow(_gather, "group long, width int, query_ids binary, queries binary"), "query-groups")
    blocks = index.select("block", "width")
    met = groups.join(blocks, "width").select("block", "group", "query_ids", "queries")
    pairs = max(1, groups.count() * index.count())
    dealt = met.join(index.select("block", "ids", "least", "counts", "slices"), "block")
    # every pair is the same work: they are dealt out evenly by both numbers
    dealt = dealt.repartition(min(pairs, 8 * max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "block", "group")
    found = dealt.sortWithinPartitions("block").mapInArrow(_Search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """The rows of ``vectors`` that ``is_query`` picks, each with its k best other rows."""
    rows = quantised(vectors, scale)
    return search(build_index(rows), rows.where(is_query), k)
