"""Token-id files: independent zstandard frames with a seek table, in ascending document order.

A file holds the ids of consecutive documents as little-endian unsigned
integers (2 bytes where the vocabulary allows, else 4). Documents are packed
into frames of about FRAME_BYTES. The layout is zstandard's public seekable
format: data frames, then one skippable frame with the seek table, whose last
four bytes are the seekable magic number. Before the seek table stands a
skippable frame of our own with the documents' index, so the file is whole in
itself; any zstandard reader can decompress all of it.

* index frame: magic 0x184D2A5D, size, then a zstandard frame of 24 bytes a
  document: doc_id (signed 64 bits), tokens (64 bits), number of its frame (32
  bits), flags (bit 0: doc_id is null; bit 1: 4-byte ids).
* seek table: for each data frame its compressed size, decompressed size and
  the low 32 bits of the XXH64 of its content, as the public format has it.

The files are written by Spark's text sink, one value a file, through the
commit protocol and Hadoop's file system: the magic number is the line
separator. They are read back by the binaryFile source.

Defined results: a null text counts as empty and has only the end id; rows
with equal doc_id follow each other in the order of their texts, null ids come
first; an empty table makes no files and an empty result.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import lookup, scratch, sliced, small_batches, written

#: Fixed values of the public formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE, SEEKABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
DESCRIPTOR_CHECKSUMS = 0x80

END_ID = 1
#: Ids of a frame and of a file, about; a file is one value in a task's memory.
FRAME_BYTES = 128 << 10
FILE_BYTES = 6 << 20
#: Bytes of text of a range of documents, about, and ranges at most: a larger table has larger ranges, whose tasks make many files each.
RANGE_TEXT_BYTES, MOST_RANGES = 12 << 20, 20_000
#: Bytes of chunks and their ids that a worker keeps, about; what an entry costs besides; chunks over LONGEST bytes aren't kept.
KEPT_BYTES, ENTRY_BYTES, LONGEST = 160 << 20, 160, 64

#: The byte-level alphabet: bytes that print stand for themselves, the others for the characters from 256 on, in order.
_PRINTING = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(_PRINTING))}

#: Marks that the tokenizer separates from letters before them.
MARKS = frozenset(b".,!?;:")

_DOC = struct.Struct("<qQII")
_DOCS = np.dtype([("doc_id", "<i8"), ("tokens", "<u8"), ("frame", "<u4"), ("flags", "<u4")])


class ChunkIds(dict):
    """The ids of white-space-delimited chunks, as little-endian bytes, kept for recent chunks of ordinary length.

    Only for tokenizers whose pieces never cross ASCII white space and drop
    it. A chunk that ends in one punctuation mark after an ASCII letter has the
    ids of both parts, if the tokenizer separates letters from marks.
    """

    def __init__(self, path: str, dtype: str) -> None:
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.passing: dict[bytes, bytes] = {}
        self.held = 0
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # each access to it makes a new object
        self.dtype = dtype
        self.code = {"<u2": "H", "<u4": "I"}[dtype] if sys.byteorder == "little" else None
        self.has_words = True
        probe = "Zürich wörter éléphant straße plain ÑANDÚES"
        self.has_words = b"".join(self.word(w.encode()) or b"" for w in probe.split()) == self.encode([probe])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_word(self, chunk: bytes) -> bool:
        """Whether a chunk is Latin-1 letters only, and words may be taken from the model."""
        if not self.has_words or chunk.isalpha():
            return self.has_words
        text = chunk.decode("utf-8", "surrogatepass")
        return text.isalpha() and max(text) <= "\xff"

    def word(self, chunk: bytes) -> bytes | None:
        """The ids of a chunk of Latin-1 letters only, from the tokenizer's model, which is much faster than its pipeline.

        For such a chunk the pipeline only lowers case and writes each byte as
        the byte-level alphabet's character. None for other chunks.
        """
        if not self.is_word(chunk):
            return None
        if chunk.isascii():  # ASCII letters stand for themselves
            found = self.model.tokenize(chunk.lower().decode())
        else:
            found = self.model.tokenize(chunk.decode().lower().encode().decode("latin-1").translate(BYTE_CHARS))
        return np.array([t.id for t in found], self.dtype).tobytes() if self.code is None else array(self.code, [t.id for t in found]).tobytes()

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that aren't known; ASCII letters are small ones."""
        marked = [c for c in chunks if c[-1] in MARKS and c[-2:-1].isalpha()]
        made, known, rest = {}, self.get, []
        tokenize, code = self.model.tokenize if self.has_words and self.code else None, self.code
        for c in chunks.difference(marked).union([c[:-1] for c in marked], [c[-1:] for c in marked]):
            found = known(c)
            if found is None:
                if tokenize is not None and c.isalpha():  # ASCII letters stand for themselves
                    found = array(code, [t.id for t in tokenize(c.decode())]).tobytes()
                elif c.isascii() or (found := self.word(c)) is None:
                    rest.append(c)
                    continue
            made[c] = found
        made.update(zip(rest, self.encode([c.decode("utf-8", "surrogatepass") for c in rest]), strict=True))
        made.update([(c, made[c[:-1]] + made[c[-1:]]) for c in marked])
        return made

    def __missing__(self, chunk: bytes) -> bytes:
        return self.passing[chunk]

    def prepare(self, chunks: set[bytes]) -> None:
        """Makes the ids of chunks known. A full generation becomes the older one, from which chunks come back when they are met again."""
        # no set operations with dictionaries: they would go through all that is kept
        missing = [c for c in chunks if c not in self]
        older = self.older
        made = self.learn({c for c in missing if c not in older})
        made.update([(c, older[c]) for c in missing if c in older])
        self.passing = {c: made.pop(c) for c in [c for c in made if len(c) > LONGEST]}
        size = sum(map(len, made)) + sum(map(len, made.values())) + ENTRY_BYTES * len(made)
        if self.held + size > KEPT_BYTES // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
            self.passing.update([(c, self.older[c]) for c in chunks if c in self.older])
        self.update(made)
        self.held += size

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts. Texts with a special token's first characters go to the tokenizer as they are."""
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() if "<|" not in (t or "") else None for t in texts]
        self.prepare(set().union(*(chunks for chunks in split if chunks)))
        get = self.__getitem__
        out = [b"".join(map(get, chunks)) if chunks is not None else self.encode([t])[0] for chunks, t in zip(split, texts, strict=True)]
        self.passing = {}
        return out


class Packer:
    """Makes one file of documents: frames are compressed as soon as they are full, so little more than the file is held."""

    def __init__(self, width: int, level: int = 3) -> None:
        self.width = width
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[bytes] = []
        self.docs: list[bytes] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > FRAME_BYTES:
            self.close_frame()
        self.docs.append(_DOC.pack(doc_id or 0, len(ids) // self.width, len(self.frames), (doc_id is None) | (self.width == 4) << 1))
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)

    def close_frame(self) -> None:
        content = b"".join(self.held)
        frame = self.packer.compress(content)
        self.frames.append(frame)
        self.table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.held.clear()
        self.size = 0

    def file(self) -> bytes:
        """The file's bytes, but for the last four (the magic number)."""
        if self.held:
            self.close_frame()
        about = self.packer.compress(b"".join(self.docs))
        seek = b"".join(self.table) + struct.pack("<IB", len(self.frames), DESCRIPTOR_CHECKSUMS)
        return b"".join(
            [*self.frames, struct.pack("<II", SKIPPABLE_INDEX, len(about)), about, struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(seek) + 4), seek]
        )


def pack_file(docs: Iterable[tuple[int | None, bytes]], width: int, level: int = 3) -> bytes:
    """The bytes of a file of docs, but for the last four (the magic number)."""
    packer = Packer(width, level)
    for doc_id, ids in docs:
        packer.add(doc_id, ids)
    return packer.file()


class TokenFile:
    """Reads documents of a file's bytes; only the frames asked for are decompressed."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 17 or struct.unpack("<I", data[-4:])[0] != SEEKABLE_MAGIC:
            raise ValueError("no seekable zstandard file")
        n, descriptor = struct.unpack("<IB", data[-9:-4])
        start = len(data) - 9 - 12 * n
        if descriptor != DESCRIPTOR_CHECKSUMS or struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE_SEEK_TABLE, 12 * n + 9):
            raise ValueError("broken seek table")
        self.data, self.table = data, np.frombuffer(data[start : start + 12 * n], "<u4").reshape(n, 3)
        self.offsets = np.r_[0, np.cumsum(self.table[:, 0].astype(np.int64))]
        at = int(self.offsets[-1])
        magic, size = struct.unpack("<II", data[at : at + 8])
        if magic != SKIPPABLE_INDEX or at + 8 + size != start - 8:
            raise ValueError("broken document index")
        self.unpacker = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.unpacker.decompress(data[at + 8 : at + 8 + size]), _DOCS)
        self.dtype = "<u4" if len(self.docs) and self.docs["flags"][0] & 2 else "<u2"

    def frame(self, k: int) -> bytes:
        content = self.unpacker.decompress(self.data[int(self.offsets[k]) : int(self.offsets[k + 1])], max_output_size=int(self.table[k, 1]))
        if len(content) != self.table[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of every document in order."""
        width, kept, at, content = np.dtype(self.dtype).itemsize, -1, 0, b""
        for doc_id, tokens, k, flags in self.docs.tolist():
            if k != kept:
                kept, at, content = k, 0, self.frame(k)
            ids = np.frombuffer(content, self.dtype, tokens, at)
            at += tokens * width
            yield None if flags & 1 else doc_id, ids

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at a place; one frame is decompressed."""
        k = int(self.docs["frame"][place])
        first = int(np.searchsorted(self.docs["frame"], k))
        skip = int(self.docs["tokens"][first:place].sum())
        return np.frombuffer(self.frame(k), self.dtype)[skip : skip + int(self.docs["tokens"][place])]


@cache
def chunk_ids(path: str, dtype: str) -> ChunkIds:
    """One tokenizer with its chunks for a worker process, whatever its tasks (tasks find it by this function's name)."""
    return ChunkIds(path, dtype)


def _files(path: str, dtype: str, end_id: int):
    """Sorted rows (range, doc_id, text) to rows (file_name, value): a file for each range, or more if one grows too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(path, dtype)
        end, width = np.asarray([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        packer, current = Packer(width), None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([packer.file()], pa.binary())], names=["value"])

        for batch in sliced(batches):
            ids = chunks.texts(batch.column("text").to_pylist())
            for part, doc_id, each in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), ids, strict=True):
                if packer.docs and (part != current or packer.total + len(each) > FILE_BYTES):
                    yield close()
                    packer = Packer(width)
                current = part
                packer.add(doc_id, each + end)
        if packer.docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int = END_ID) -> None:
    """Writes docs (doc_id, text) as token files under path, in ranges of ascending doc_id.

    The ranges come from quantiles of doc_id over the whole table, so that the
    sort doesn't run the tokenizer to take samples.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_RANGES, int(total // RANGE_TEXT_BYTES)))
    ranged = keyed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).withColumn("range", F.spark_partition_id())
    rows = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select("range", "doc_id", "text")
    packed = rows.mapInArrow(_files(tokenizer_path, dtype, end_id), "value binary")
    magic = struct.pack("<I", SEEKABLE_MAGIC).decode("latin-1")
    with small_batches(docs.sparkSession):
        packed.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", magic).option("encoding", "ISO-8859-1").text(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, content) to rows (path, place, doc_id, n_tokens, ids_crc32)."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            found = [(doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, ids in TokenFile(content.as_py())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path.as_py()] * len(found), pa.string()),
                    pa.array(range(len(found)), pa.int64()),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.int64()),
                ],
                names=["path", "place", "doc_id", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, checksums verified.

    Files come in the order of their first documents. start is the number of
    ids before a document: running sums inside a file, plus those of the files
    before it, which are summed over groups of files first.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    docs = written(files.mapInArrow(_digests, "path string, place long, doc_id long, n_tokens long, ids_crc32 long"), "digests")
    name = F.regexp_extract("path", r"part-(\d+)-.*?(?:-c(\d+))?\.txt$", 1).cast("long")
    sub = F.coalesce(F.try_element_at(F.regexp_extract_all("path", F.lit(r"-c(\d+)\.txt"), F.lit(1)), F.lit(1)).cast("long"), F.lit(0))
    placed = docs.withColumn("part", name).withColumn("sub", sub)
    sums = placed.groupBy("part", "sub").agg(F.sum("n_tokens").alias("n"))
    sums = written(sums.withColumn("bundle", F.floor(F.col("part") / 1000)), "file_sums")
    bundles = sums.groupBy("bundle").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bundle_starts = bundles.select("bundle", before(Window.orderBy("bundle")).alias("bundle_start"))
    starts = sums.withColumn("in_bundle", before(Window.partitionBy("bundle").orderBy("part", "sub"))).join(bundle_starts, "bundle")
    starts = lookup(written(starts.select("part", "sub", (F.col("in_bundle") + F.col("bundle_start")).alias("file_start")), "file_starts"))
    inside = Window.partitionBy("part", "sub").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return at.join(starts, ["part", "sub"]).select("doc_id", (F.col("in_file") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int = END_ID) -> DataFrame:
    """Writes docs as token files in a new shared folder and returns what reading them gives."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path)
