"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct word shingles (64-bit hashes). Documents with equal
sets form a class; only classes are compared. A class's signature has 60 symbols of 16
bits, each from a minimum over the set. Signatures at most 23 symbols apart are
candidates, and all such pairs are found: cut into 12 chunks of 5 symbols, two of them
have, by pigeonhole, a chunk with at most one wrong symbol, so they share one of the 60
keys made of a chunk with one symbol left out. At similarity 0.8 a pair is more than 23
symbols apart with a probability below one in a thousand, and far less above that.

Classes that share a key are not paired with each other. Each is paired with one other:
of the heads of its keys the one it shares most keys with. The head of a key is its class
whose keys hold most classes: the text a group's copies were made of has the symbols most
of them have, and is nearer to each copy than copies are to each other. These pairs are
confirmed on the full sets and joined to components, first with the keys of two chunks,
then with all keys that still hold two components. At last every two classes of a key
that lie in different components, and whose sizes allow a link, are tried, so no link is
lost. Before that, a class whose own shingles (in no other class that is left) rule out every
link falls: those are the copies that edits of their own took just below the share. And two
classes are only held against each other where what they lack of their key's head agrees
well enough: copies of one text that were edited in different places are told apart by
comparing two bitmaps, without a row for the pair.

Components are smallest ids spread along links with shortcuts until nothing changes,
every state being a stored table.

Defined cases: texts without words (null, empty, white space) have an empty set and are
linked with nothing; fewer words than a shingle are one shingle; rows that share an id are
each judged by their own text; rows with a null id take part in no link and are not kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched, groupby, product
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import only, records, ship
from freshet.llm.katz import mixed
from freshet.operators import sizing
from freshet.operators.sizing import Sized, summarised
from freshet.sources.workspace import give_back, stored

SYMBOLS, CHUNK = 60, 5
#: Each of the chunks may hold one wrong symbol and some chunk must: 2 * 12 - 1.
MOST_WRONG = 2 * (SYMBOLS // CHUNK) - 1
#: Words whose documents are sketched together.
BATCH_WORDS = 500_000
#: Tables up to this many bytes are broadcast. A run has some thirty of them, and the driver holds
#: each until its garbage is collected, which is asked for between steps. Signatures and sets never are.
BROADCAST_BYTES = 16 << 20


def attach(fact: DataFrame, table: Sized, on: list[str], how: str = "inner", keys_from: DataFrame | None = None) -> DataFrame:
    return sizing.attach(fact, table, on, how, BROADCAST_BYTES, keys_from)


def sized(table: DataFrame) -> Sized:
    """A stored table with its counted rows; its columns are numbers or of known width."""
    return sizing.counted(table)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    return mixed(n, n + np.uint64(7)) | np.uint64(1), mixed(n + np.uint64(77), n)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.local, self.hashes = words, {}, np.zeros(1024, np.uint64)

    def _learn(self, word: bytes) -> int:
        n = self.local[word] = len(self.local)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word)
        return n

    def set_of(self, text: str | None) -> np.ndarray:
        if len(self.local) > 300_000:
            self.local.clear()
        local = self.local
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = np.array([n if (n := local.get(w)) is not None else self._learn(w) for w in words], np.int64)
        found = self.hashes[known]
        if not len(found):
            return found
        width = min(self.words, len(found))
        out = found[: len(found) - width + 1]
        for k in range(1, width):
            out = mixed(out, found[k : len(found) - width + 1 + k])
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit symbols per non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k, (odd, flip) in enumerate(zip(*_multipliers(), strict=True)):
        least = np.minimum.reduceat((flat ^ flip) * odd, starts)
        out[:, k] = (mixed(least, least) >> np.uint64(48)).astype(np.uint16)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """The keys of signatures (rows, SYMBOLS): each chunk with each one of its symbols left out."""
    chunks = signature.reshape(len(signature), -1, CHUNK).astype(np.uint64)
    out = np.empty((len(signature), chunks.shape[1], CHUNK), np.uint64)
    for left_out in range(CHUNK):
        kept = [k for k in range(CHUNK) if k != left_out]
        body = np.zeros(chunks.shape[:2], np.uint64)
        for k in kept:
            body = (body << np.uint64(16)) | chunks[:, :, k]
        place = np.arange(chunks.shape[1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out + 1)
        out[:, :, left_out] = mixed(np.broadcast_to(place, body.shape), body)
    return out.reshape(len(signature), -1)


CARRIED = ("class", "component", "size", "shared")
KEYS = "key long, class long, component long, size long, shared long"
#: Chunks whose keys make the first pairs.
FIRST_CHUNKS = 2
SKETCHES = "doc_id long, n_shingles long, digest binary, signature binary"


@dataclass(frozen=True)
class _Sketch:
    words: int

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(self.words), [], 0

        def batch() -> pa.RecordBatch:
            full = [s for _, s in held if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            columns = zip(
                *((i, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, next(rows).tobytes() if len(s) else None) for i, s in held),
                strict=True,
            )
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SKETCHES.replace(",", "").split()[::2])

        for doc_id, text in records(batches, "doc_id", "text", step=64):
            held.append((doc_id, shingler.set_of(text)))
            size += len(held[-1][1])
            if size > BATCH_WORDS or len(held) >= 8192:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


@dataclass(frozen=True)
class _Keys:
    chunks: int = SYMBOLS // CHUNK

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, SYMBOLS)
                keys = np.ascontiguousarray(keys_of(own)[:, : self.chunks * CHUNK])
                columns = [pa.array(keys.view(np.int64).ravel())]
                columns += [pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), keys.shape[1])) for c in CARRIED]
                yield pa.RecordBatch.from_arrays(columns, ["key", *CARRIED])


def _both(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple]:
    """Pairs (a, b) whose rows stand together, with ``column`` of either side; classes that share an id are met one by one."""
    for (a, b), rows in groupby(records(batches, "a", "b", "side", column, step=64), itemgetter(0, 1)):
        sides = ([], [])
        for _, _, side, value in rows:
            sides[side].append(value)
        yield from ((a, b, x, y) for x, y in product(*sides))


def _wrong(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are near enough, with how many symbols are wrong."""
    for part in batched(_both(batches, "signature"), 4096):
        a, b, *own = zip(*part, strict=True)
        one, two = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, SYMBOLS) for x in own)
        wrong = (one != two).sum(axis=1)
        near = pa.array(wrong <= MOST_WRONG)
        columns = [pa.array(a).filter(near), pa.array(b).filter(near), pa.array(wrong, pa.int32()).filter(near)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "wrong"])


@dataclass(frozen=True)
class _Sets:
    words: int

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(self.words)
        for doc_id, text in records(batches, "doc_id", "text", step=64):
            found = shingler.set_of(text)
            columns = [pa.array([doc_id]), pa.array([xxhash.xxh3_128_digest(found.tobytes())], pa.binary()), pa.array([found.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "digest", "members"])


@dataclass(frozen=True)
class _Confirm:
    percent: int

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for a, b, x, y in _both(batches, "members"):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(one, two, assume_unique=True))
            out.append((a, b, 100 * common >= self.percent * (len(one) + len(two) - common)))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "linked"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "linked"])


def components(links: DataFrame) -> DataFrame:
    """(class, component) of all classes in links (a, b): the smallest class reachable.

    Each round a class takes the smallest component among itself and its neighbours, then the
    component of that; the table of a round is stored and read by the next."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "class"), "components")
    while True:
        known = sized(state)
        reached = attach(both, sized(state.withColumnRenamed("class", "b")), ["b"]).groupBy("a").agg(F.min("component").alias("near"))
        moved = attach(reached.withColumnRenamed("a", "class"), known, ["class"]).select("class", "component", F.least("near", "component").alias("low"))
        jump = sized(state.select(F.col("class").alias("low"), F.col("component").alias("lower")))
        after = stored(attach(moved, jump, ["low"], "left").select("class", "component", F.least("low", F.coalesce("lower", "low")).alias("next")), "components")
        changed = after.where("next < component").limit(1).count()
        state = after.select("class", F.col("next").alias("component"))
        if not changed:
            return state


def _met(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each stored pair (a, b), next to each other, what ``rows`` (class and a wide column) has of both classes.

    The pairs are brought to the classes, as narrow rows, and only what is in a pair moves on, once per pair and to
    a task chosen by the pair: the wide rows are never broadcast, and a class in many pairs loads no single task."""
    end = F.explode(F.array(*(F.struct(F.col(c).alias("class"), F.lit(k).alias("side")) for k, c in enumerate("ab"))))
    ends = Sized(pairs.select("a", "b", end.alias("end")).select("a", "b", "end.*"), 2 * pairs.count())
    if ends.bytes_in_memory <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(ends.frame), "class")
    else:  # of the pairs' classes some may be hot
        met = sizing.attach(ends.frame, sized(rows), ["class"], limit=0)
    return met.drop("class").repartition("a", "b").sortWithinPartitions("a", "b")


def _near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most MOST_WRONG symbols."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    return _met(pairs, classes.select("class", "signature")).mapInArrow(_wrong, "a long, b long, wrong int")


def _sets_of(wanted: DataFrame, documents: DataFrame, classes: DataFrame, words: int) -> Sized:
    """(class, members) of the wanted classes: sets are made again from the texts, not kept."""
    chosen = summarised(classes.select("class", "digest").join(wanted, "class", "left_semi"), "involved")
    ids = Sized(chosen.frame.select(F.col("class").alias("doc_id")), chosen.rows)
    texts = attach(only(documents, "doc_id", "text"), ids, ["doc_id"], "left_semi")
    sets = texts.mapInArrow(_Sets(words), "class long, digest binary, members binary")
    return summarised(attach(sets, chosen, ["class", "digest"], "left_semi").select("class", "members"), "sets")


def _confirmed(pairs: DataFrame, documents: DataFrame, classes: DataFrame, words: int, percent: int, sets: Sized | None = None) -> DataFrame:
    """Which of the stored pairs are linked, by the full sets of the two classes."""
    sets = sets or _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), documents, classes, words)
    return stored(_met(pairs.select("a", "b"), sets.frame).mapInArrow(_Confirm(percent), "a long, b long, linked boolean"), "confirmed")


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once per shingle of its set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(m, np.int64) for m in part.column("members").to_pylist()]
            owner = np.repeat(part.column("class").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(sets))], ["class", "shingle"])


def _most_shared(sets: DataFrame) -> DataFrame:
    """(class, own): how many shingles of a class no other of these classes has."""
    spread = sets.mapInArrow(_members, "class long, shingle long")
    alone = spread.groupBy("shingle").agg(F.min("class").alias("class"), F.max("class").alias("high")).where("class = high")
    return alone.groupBy("class").agg(F.count("*").alias("own"))


#: Words of 64 bits of a bitmap, and their names.
BITMAP = tuple(f"missing_{k}" for k in range(4))


def _missing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class (a) and head (b), a bitmap of the head's shingles that the class does not have, by their hash."""

    def rows() -> Iterator[tuple]:
        for one, head, members, heads in _both(batches, "members"):
            gone = np.setdiff1d(np.frombuffer(heads, np.uint64), np.frombuffer(members, np.uint64), assume_unique=True)
            bits = np.zeros(64 * len(BITMAP), np.uint8)
            bits[(gone % np.uint64(len(bits))).astype(np.int64)] = 1
            yield one, head, *np.packbits(bits, bitorder="little").view(np.int64).tolist()

    for part in batched(rows(), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], ["class", "head", *BITMAP])


def _apart(mine: str, theirs: str) -> Column:
    """At least so many of the head's shingles the one has and the other lacks."""
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(theirs + c).bitwiseAND(F.bitwise_not(F.col(mine + c)))) for c in BITMAP))


def _across(spread: DataFrame, documents: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, Sized]:
    """Pairs (a, b) of classes of different components that share a key and may be linked, and the
    sets of their classes.

    A link needs an overlap of percent / (100 + percent) of the two sizes together. What two classes
    have in common is at most the shingles of the one that some other class has too, less those of
    the key's head that it has and the other lacks. Copies that miss the share by edits of their own
    fall by the first, before classes meet; pairs of copies edited in different places by the second,
    which compares bitmaps of what each lacks of the head."""
    open_keys = spread.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    across = stored(attach(spread, summarised(open_keys, "open-keys"), ["key"], "left_semi"), "across")
    give_back(spread.sparkSession)
    sets = _sets_of(across.select("class").distinct(), documents, classes, words)
    own = summarised(_most_shared(sets.frame), "own-shingles")
    common = F.col("size") - F.coalesce("own", F.lit(0))
    able = attach(across, own, ["class"], "left").withColumn("common", common).drop("own")
    # the smallest size that a partner may have, of those there are under the key; and the key's head
    first = F.min(F.struct((-F.col("shared")).alias("rank"), "class"))["class"].alias("head")
    least = summarised(able.groupBy("key").agg(F.min("size").alias("least"), first), "least-sizes")
    partner = F.greatest(F.col("least"), F.ceil(percent * F.col("size") / 100))
    able = attach(able, least, ["key"]).where((100 + percent) * F.col("common") >= percent * (F.col("size") + partner)).drop("least", "shared")
    able = stored(able, "able")
    refs = stored(able.select(F.col("class").alias("a"), F.col("head").alias("b")).distinct(), "references")
    lacks = _met(refs, sets.frame).mapInArrow(_missing, "class long, head long, " + ", ".join(f"{c} long" for c in BITMAP))
    # all shingles of a head count as shared: what others lack of it takes its own ones off as well
    base = F.when(F.col("class") == F.col("head"), F.col("size")).otherwise(F.col("common"))
    able = attach(able, summarised(lacks, "missing"), ["class", "head"]).withColumn("common", base).drop("head")
    # a class has few keys; of those two classes share, the smallest alone brings them together
    own_keys = summarised(able.groupBy("class").agg(F.collect_list("key").alias("keys")), "own-keys")
    able = stored(attach(able, own_keys, ["class"]), "able-keys")
    other = able.select("key", *(F.col(c).alias(f"other_{c}") for c in ("class", "component", "size", "common", *BITMAP, "keys")))
    most = F.least(F.col("common") - _apart("", "other_"), F.col("other_common") - _apart("other_", ""))
    may_link = F.expr("class < other_class AND component <> other_component")
    may_link &= (100 + percent) * most >= percent * (F.col("size") + F.col("other_size"))
    may_link &= F.col("key") == F.array_min(F.array_intersect("keys", "other_keys"))
    return able.join(other, "key").where(may_link).select(F.col("class").alias("a"), F.col("other_class").alias("b")), sets


def _placed(classes: DataFrame, state: Sized | None) -> DataFrame:
    """Classes with their component so far."""
    if state is None:
        return classes.select(F.col("class").alias("component"), "class", "size", "shared", "signature")
    own = classes.select("class", "size", "shared", "signature")
    return attach(own, state, ["class"], "left").withColumn("component", F.coalesce("component", "class"))


def _popular(classes: DataFrame) -> DataFrame:
    """Classes with ``shared``: how many classes the keys of the first chunks bring each together with."""
    bare = classes.select("class", F.col("class").alias("component"), "size", F.lit(0).cast("long").alias("shared"), "signature")
    spread = bare.mapInArrow(_Keys(FIRST_CHUNKS), KEYS).select("key", "class")
    held = summarised(spread.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "held")
    shared = attach(spread, held, ["key"]).groupBy("class").agg(F.sum("held").alias("shared"))
    met = attach(classes, summarised(shared, "shared"), ["class"], "left")
    give_back(classes.sparkSession)
    return stored(met.withColumn("shared", F.coalesce("shared", F.lit(0).cast("long"))), "popular")


def _stars(placed: DataFrame, chunks: int) -> DataFrame:
    """One pair (a, b) per class: one of the two is the head of a key of the other and in another component."""
    spread = placed.mapInArrow(_Keys(chunks), KEYS)
    first = F.min(F.struct((-F.col("shared")).alias("rank"), "class", "component"))
    heads = spread.groupBy("key").agg(first.alias("head"), F.min("component").alias("low"), F.max("component").alias("high"))
    heads = heads.where("low < high").select("key", F.col("head.class").alias("head"), F.col("head.component").alias("place"))
    met = attach(spread, summarised(heads, "heads"), ["key"]).where("component <> place")
    shared = met.groupBy(F.col("class").alias("b"), F.col("head").alias("a")).count()
    best = shared.groupBy("b").agg(F.min(F.struct(-F.col("count"), "a")).alias("best"))
    return best.select(F.least("best.a", "b").alias("a"), F.greatest("best.a", "b").alias("b")).distinct()


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable) and kept.

    Documents are linked whose sets of ``words``-word shingles have ``percent`` or more of their
    union in common."""
    spark = documents.sparkSession
    ship(spark)
    sketches = stored(only(documents, "doc_id", "text").mapInArrow(_Sketch(words), SKETCHES), "sketches")
    there = sketches.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    size = F.min("n_shingles").alias("size")
    classes = stored(there.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies"), size, F.min("signature").alias("signature")), "classes")
    classes = _popular(classes)
    tried, links, state = None, None, None
    for chunks in (FIRST_CHUNKS, SYMBOLS // CHUNK):
        new = _stars(_placed(classes, state), chunks)
        if tried is not None:
            new = new.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(_near_pairs(new, classes).select("a", "b"), "stars")
        give_back(spark)
        found = _confirmed(pairs, documents, classes, words, percent)
        tried = found if tried is None else tried.unionByName(found)
        links = tried.where("linked").select("a", "b")
        state = sized(components(links))
        give_back(spark)

    # what is left: pairs across components that share a key
    spread = _placed(classes, state).mapInArrow(_Keys(), KEYS)
    met, sets = _across(spread, documents, classes, words, percent)
    give_back(spark)
    rest = met.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    rest = stored(_near_pairs(rest, classes).select("a", "b"), "rest")
    last = _confirmed(rest, documents, classes, words, percent, sets).where("linked").select("a", "b")
    final = sized(components(links.unionByName(last)))
    give_back(spark)

    # a document alone in its class, which has no link, is its own component and needs no row here
    named = attach(classes.select("digest", "class", "copies"), final, ["class"], "left").where("copies > 1 OR component IS NOT NULL")
    named = summarised(named.select("digest", F.coalesce("component", "class").alias("component_id")), "named")
    rows = sketches.select("doc_id", "n_shingles", "digest")
    found = attach(rows, named, ["digest"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
