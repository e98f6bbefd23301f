"""Token ids in seekable binary files.

A file is a run of independent Zstandard frames, each with a content checksum,
followed by two skippable frames: an index of the documents and, last, a seek table
in the layout of the public Zstandard seekable format (compressed size, decompressed
size and checksum of every frame, then the count, a descriptor and a magic number).
A document's ids fill frames of their own, several if it is long, so a reader fetches
the tail of a file, finds a document in the index, and decompresses only its frames.
Any Zstandard tool can also decompress the whole file.

Documents are written in ascending id order: the table is range-partitioned by id,
and each task writes one file into the shared folder under a name no other attempt
uses. Spark commits the list of files; what a lost attempt wrote is in no list.

Defined cases: a null text is an empty one, and an empty document is its end id; a
null id comes first; rows that share an id stand together, ordered by a digest of
their text; an empty table gives no file and no rows. The name of a special token
in a document is that token, as the library has it by default.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.common import only, records, ship
from freshet.sources.workspace import fresh_path, stored

END_ID = 2
#: Ids of one frame at most; a longer document takes several frames.
FRAME_IDS = 1 << 18
#: Documents of one file, about; a file is what one task writes.
FILE_DOCUMENTS = 8_000
#: Pieces of text whose ids a task remembers, some 200 bytes each, at most: five eighths of them came again, and when
#: these are full, all but those of the last texts are forgotten; the others came once and make room for newer ones.
REMEMBERED = 800_000

# Fixed values of the Zstandard format and of its seekable layout.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
#: Of the index: layout version and bytes of an id.
INDEX_HEAD = struct.Struct("<BBHI")
#: Of the index: id, is the id null, frames, ids.
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frames", "<u4"), ("ids", "<u8")])
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
FOOTER = struct.Struct("<IBI")

FILES = "path string, part int, first long, last long, documents long, ids long"
#: A cut never falls inside a token: byte-level BPE starts a new word at a space before such a character.
CUTS = re.compile("(?= [!-~À-ÿ])")
#: A space before anything else is no cut.
NO_CUT = re.compile(" (?![!-~À-ÿ])")
#: New pieces encoded as one text.
TOGETHER = 2000


class Encoder:
    """Ids of whole texts. A text is cut where the vocabulary's own word rule cuts too; the
    library encodes the pieces, each once while it is remembered. Pieces that follow a cut are
    remembered without their space, so most texts are cut by their spaces alone. Most pieces never
    come again: those that came once are kept apart, in a newer and an older half, and only the
    others are kept for long."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        # a byte-level token has one character per byte of text, as has an added token of ASCII
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.bytes_of[number] = len(token)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian ids of each text, without an end id."""
        if len(self.first) > REMEMBERED:
            self.first.clear()
        cut = [self._cut(text) for text in texts]
        heads = [parts.pop(0) for parts in cut]
        self._learn({head for head in heads if head not in self.first}, self.first)
        get, missing, found = self.known.get, set(), []
        for parts in cut:
            ids = list(map(get, parts))
            gaps = [k for k, known in enumerate(ids) if known is None]
            missing.update([parts[k] for k in gaps])
            found.append((ids, gaps))
        recalled, out = self._recall(missing), []
        for head, parts, (ids, gaps) in zip(heads, cut, found, strict=True):
            for k in gaps:
                ids[k] = recalled[parts[k]]
            out.append(self.first[head] + b"".join(ids))
        if len(self.known) > REMEMBERED * 5 // 8:
            last = {part for parts in cut for part in parts}
            self.known = {piece: ids for piece, ids in self.known.items() if piece in last}
        if len(self.once) > REMEMBERED * 3 // 16:
            self.older, self.once = self.once, {}
        return out

    def _recall(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of pieces not known to have come again: those that came once are known from now on, the rest are learnt."""
        again, new = {}, []
        for piece in pieces:
            ids = self.once.pop(piece, None) or self.older.pop(piece, None)
            if ids is None:
                new.append(piece)
            else:
                again[piece] = ids
        if new:
            self._learn_together(new)
        self.known.update(again)
        return again | {piece: self.once[piece] for piece in new}

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The text up to its first cut, then the pieces after each cut, without the space there."""
        if not NO_CUT.search(text):
            return text.split(" ")
        head, *rest = CUTS.split(text)
        return [head, *(piece[1:] for piece in rest)]

    def _ids(self, text: str) -> np.ndarray:
        (encoding,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoding.ids, f"<u{self.width}")

    def _learn(self, pieces: Iterable[str], memory: dict[str, bytes], space: str = "") -> None:
        for piece in pieces:
            memory[piece] = self._ids(space + piece).tobytes()

    def _learn_together(self, pieces: Sequence[str]) -> None:
        """Pieces without a space inside are encoded as one text and told apart by where its spaces are."""
        plain = [piece for piece in pieces if " " not in piece]
        self._learn((piece for piece in pieces if " " in piece), self.once, " ")
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            text = " " + " ".join(part)
            ids, given = self._ids(text), np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(given == 32)[1:], len(given))
            cuts = (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * self.width
            packed, before = ids.tobytes(), 0
            for piece, cut in zip(part, cuts.tolist(), strict=True):
                self.once[piece] = packed[before:cut]
                before = cut


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One per worker: what it remembers serves the worker's later tasks too."""
    return Encoder(path)


def _checksum(plain: bytes) -> int:
    """As the seekable layout has it: the low half of the 64-bit xxHash."""
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file; nothing of it is kept but the sizes."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step, before = FRAME_IDS * self.width, len(self.frames)
        for at in range(0, len(ids), step):
            plain = ids[at : at + step]
            packed = self.packer.compress(plain)
            self.sink.write(packed)
            self.frames.append((len(packed), len(plain), _checksum(plain)))
        self.documents.append((doc_id or 0, doc_id is None, len(self.frames) - before, len(ids) // self.width))

    def close(self) -> None:
        index = INDEX_HEAD.pack(1, self.width, 0, len(self.documents)) + np.array(self.documents, DOCUMENT).tobytes()
        index += struct.pack("<I", len(index))
        table = np.array(self.frames, ENTRY).tobytes() + FOOTER.pack(len(self.frames), CHECKSUMS, SEEKABLE_MAGIC)
        for magic, body in ((SKIPPABLE_INDEX, index), (SKIPPABLE_TABLE, table)):
            self.sink.write(struct.pack("<II", magic, len(body)) + body)
        self.sink.close()


class FrameReader:
    """Reads single documents of a file by seeking."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - FOOTER.size - n * ENTRY.itemsize
        self.frames = np.frombuffer(self._bytes(table_at, n * ENTRY.itemsize), ENTRY)
        index_end = table_at - 8
        (length,) = struct.unpack("<I", self._bytes(index_end - 4, 4))
        index = self._bytes(index_end - 4 - length, length)
        _, self.width, _, _ = INDEX_HEAD.unpack_from(index)
        self.documents = np.frombuffer(index, DOCUMENT, offset=INDEX_HEAD.size)
        self.at = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.documents["frames"], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def _bytes(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def ids(self, nth: int) -> Iterator[np.ndarray]:
        """The nth document's ids, frame by frame; both checksums of a frame are verified."""
        for k in range(self.first[nth], self.first[nth + 1]):
            frame = self.frames[k]
            plain = self.unpacker.decompress(self._bytes(int(self.at[k]), int(frame["packed"])), max_output_size=int(frame["plain"]))
            if _checksum(plain) != frame["checksum"] or len(plain) != frame["plain"]:
                raise ValueError(f"frame {k} does not have the checksum of the seek table")
            yield np.frombuffer(plain, f"<u{self.width}")


@dataclass(frozen=True)
class _Write:
    folder: str
    tokenizer: str
    end_id: int

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = records(batches, "doc_id", "text", step=64)
        if (first := next(rows, None)) is None:
            return
        encoder = encoder_of(self.tokenizer)
        end = np.array([self.end_id], f"<u{encoder.width}").tobytes()
        part = TaskContext.get().partitionId()
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer = FrameWriter(system.open_output_stream(f"{folder}/{name}", compression=None), encoder.width)
        held, size, low, high = [first], 0, None, None

        def flush() -> None:
            for (doc_id, _), ids in zip(held, encoder.encode([text or "" for _, text in held]), strict=True):
                writer.add(doc_id, ids + end)

        for row in rows:
            size += len(row[1] or "")
            held.append(row)
            if size > 1 << 20 or len(held) >= 500:
                flush()
                held, size = [], 0
        flush()
        known = [d[0] for d in writer.documents if not d[1]]
        low, high = (min(known), max(known)) if known else (None, None)
        total = sum(d[3] for d in writer.documents)
        writer.close()
        columns = ([f"{self.folder}/{name}"], [part], [low], [high], [len(writer.documents)], [total])
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["path", "part", "first", "last", "documents", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int = END_ID, file_documents: int = FILE_DOCUMENTS) -> DataFrame:
    """Encode and write every document; returns the stored list of files.

    ``tokenizer`` is the path of a vocabulary file every worker can open.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = only(documents, "doc_id", "text")
    files = max(1, -(-rows.select("doc_id").count() // file_documents))
    dealt = rows.withColumn("digest", F.xxhash64("text")).repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "digest")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest").drop("digest")
    folder = fresh_path(spark, "tokens")
    folder = folder if re.match(r"\w[\w+.-]*:", folder) else f"file://{folder}"
    return stored(ordered.mapInArrow(_Write(folder, tokenizer, end_id), FILES), "token-files")


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, start in records(batches, "path", "start"):
        system, place = fs.FileSystem.from_uri(path)
        with system.open_input_file(place) as source:
            reader, out = FrameReader(source), []
            for nth, document in enumerate(reader.documents):
                crc = 0
                for ids in reader.ids(nth):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                out.append((None if document["null"] else int(document["doc_id"]), start, int(document["ids"]), crc))
                start += int(document["ids"])
        for at in range(0, len(out), 4096):
            columns = zip(*out[at : at + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_summary(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids).

    Where a file starts is a running sum over the list of files, one row per file."""
    ship(files.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))
    parts = max(1, files.count())
    return placed.select("path", "start", "part").repartition(parts, "part").select("path", "start").mapInArrow(_read, DOCUMENTS)


def read_documents(spark: SparkSession, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of requested documents (``wanted`` has doc_id), as (doc_id, nth, ids): one row per
    frame, in order of nth. Files and frames that hold none of them are not opened or decompressed."""
    ship(spark)
    asked = only(wanted, "doc_id").where("doc_id IS NOT NULL").distinct()
    per_file = asked.join(files, F.col("doc_id").between(F.col("first"), F.col("last"))).select("path", "doc_id")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for path, doc_id in records(batches, "path", "doc_id"):
            if path != opened:
                system, place = fs.FileSystem.from_uri(path)
                opened, reader = path, FrameReader(system.open_input_file(place))
            here = np.flatnonzero((reader.documents["doc_id"] == doc_id) & (reader.documents["null"] == 0))
            for nth, ids in enumerate(frame for k in here for frame in reader.ids(k)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id]), pa.array([nth], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["doc_id", "nth", "ids"]
                )

    return per_file.repartition("path").sortWithinPartitions("path").mapInArrow(fetch, "doc_id long, nth long, ids array<long>")
