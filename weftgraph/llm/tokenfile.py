"""Token-id files: independent zstandard frames, a document index, and a trailing seek table with a checksum for each frame.

Layout of a file, readable by any zstandard decoder (which skips the last two parts):
  frames     ids of whole documents, little-endian unsigned 32-bit, about FRAME_IDS for each frame
  index      skippable frame; zstandard-compressed columns doc_id (int64), frame, first id in it, number of ids (uint32), and
             whether the document has an id (uint8)
  seek table skippable frame in the public seekable format: for each frame its compressed size, its size and the low 32 bits
             of the xxHash64 of its content; then the number of frames, a descriptor byte and the magic number
A reader takes the tail, finds a document's frame in the index, and decompresses that frame only.

Writing: documents are range-partitioned and sorted by doc_id; each task writes one file in the shared folder under a name
that holds its attempt, and returns a manifest row, so files of lost or repeated attempts are never read. First ids of the
files are sums over the manifest. Memory in a task: one frame, one document and a bounded cache.

Defined results: a null text counts as empty; an empty text gives the end id alone; documents without an id come first; those
of one id come one after the other, by the hash of their texts; a very long text is one document in one frame, held whole by
its task; an empty table gives no files and no rows; columns besides doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import shared_folder, written

FRAME_IDS = 1 << 16
END_ID = 2
#: Words whose ids a worker keeps.
CACHE_WORDS = 1_200_000
#: Characters of text taken at once, one text at least.
TEXT_CHARS = 1 << 15
#: Fixed value: how the vocabulary marks a token that ends a word.
WORD_END = "</w>"
#: Fixed value: how the vocabulary's added tokens begin.
ADDED = "<|"
#: Fixed values of the zstandard and seekable formats.
SKIP_INDEX, SKIP_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1


class Writer:
    """Appends documents to one file; close() adds the index and the seek table."""

    def __init__(self, stream, level: int = 3, frame_ids: int = FRAME_IDS):
        self.stream, self.frame_ids = stream, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.waiting, self.frames, self.index = 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, len(self.frames), self.waiting, len(ids), doc_id is not None))
        self.pending.append(ids.astype("<u4").tobytes())
        self.waiting += len(ids)
        if self.waiting >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            packed = self.packer.compress(raw)
            self.stream.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.waiting = [], 0

    def close(self) -> None:
        self._flush()
        at = np.array(self.index, dtype="<i8").reshape(-1, 5)
        columns = at[:, 0].tobytes() + at[:, 1:4].T.astype("<u4").tobytes() + at[:, 4].astype("u1").tobytes()
        packed = self.packer.compress(columns)
        self.stream.write(struct.pack("<II", SKIP_INDEX, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)
        self.stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(self.size - 9, 9))
        if magic != SEEK_MAGIC or flags & 0x80 == 0:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(self._at(self.size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.lengths, self.sums = table[:, 1], table[:, 2]
        self.packed = table[:, 0]
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])
        end = int(self.starts[-1])
        _, size = struct.unpack("<II", self._at(end, 8))
        raw = zstandard.ZstdDecompressor().decompress(self._at(end + 8, size))
        docs = len(raw) // 21
        self.doc_ids, self.named = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "u1", docs, 20 * docs).astype(bool)
        self.frame_of, self.first, self.count = np.frombuffer(raw, "<u4", 3 * docs, 8 * docs).reshape(3, docs).astype(np.int64)

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.packed[k])), max_output_size=int(self.lengths[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k] or len(raw) != self.lengths[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, each frame decompressed once."""
        held, ids = -1, None
        columns = (self.doc_ids, self.named, self.frame_of, self.first, self.count)
        for doc_id, named, k, first, n in zip(*(x.tolist() for x in columns), strict=True):
            if k != held:
                held, ids = k, self.frame(k)
            yield doc_id if named else None, ids[first : first + n]

    def document(self, doc_id: int) -> np.ndarray:
        """The first document of that id, from its frame alone."""
        unnamed = int(np.count_nonzero(~self.named))
        at = unnamed + int(np.searchsorted(self.doc_ids[unnamed:], doc_id))
        if at == len(self.doc_ids) or self.doc_ids[at] != doc_id:
            raise KeyError(doc_id)
        return self.frame(int(self.frame_of[at]))[self.first[at] : self.first[at] + self.count[at]]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A word with ASCII marks behind it: the tokenizer always cuts between the two. An apostrophe may belong to either side.
_WITH_MARKS = re.compile(r"([^\W_]+)([!-&(-/:-@\[-`{-~]+)")


class WordEncoder:
    """Ids by words between blanks, which the tokenizer drops and never merges across; keeps the ids of up to CACHE_WORDS words.

    An unknown word is looked up in parts: without the marks behind it, and in lower case, as the tokenizer takes it, where
    that is one letter for one letter (below U+0180); not where an added token may stand, which is matched in its own case.
    Parts of letters alone are encoded many at once, and their ids cut where
    a token ends a word.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        parts_of, parts, known = {}, set(), self.known
        for word in new:
            plain = word.lower() if max(word, default="") < "\u0180" and "\u0130" not in word and ADDED not in word else word
            found = _WITH_MARKS.fullmatch(plain)
            parts_of[word] = own = found.groups() if found else (plain,)
            parts.update(own)
        wanted = [p for p in parts if p not in known]
        letters = [p for p in wanted if p.isalpha()]
        for k in range(0, len(letters), 4096):
            part = letters[k : k + 4096]
            ids = self._encoded(" ".join(part))
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part):  # one of them is cut within: each on its own, below
                continue
            raw = ids.tobytes()
            known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1].tolist()], cuts.tolist())), strict=True))
        for p in wanted:
            if p not in known:
                known[p] = self._encoded(p).tobytes()
        for word, own in parts_of.items():
            known[word] = known[own[0]] if len(own) == 1 else known[own[0]] + known[own[1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " ").replace("\t", " ").split(" ") for text in texts]
        new: set[str] = set()
        for words in split:
            new.update(set(words).difference(self.known))
        if new:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
                new = set().union(*split)
            self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One for each worker, with its cache."""
    return WordEncoder(path)


def _by_size(texts: pa.Array) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text.as_py() or "")
        held += len(part[-1])
        if held >= TEXT_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Encode docs (doc_id, text) and write the files in ascending doc_id order; the manifest, itself written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, totals = TaskContext.get(), None, [0, 0]
        encoder, tail = _encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in _by_size(batch.column("text")):
                for doc_id, raw in zip(doc_ids[at : at + len(texts)], encoder.encode(texts), strict=True):
                    if writer is None:
                        fs, place = pafs.FileSystem.from_uri(path)
                        fs.create_dir(os.path.dirname(place), recursive=True)
                        writer = Writer(fs.open_output_stream(place, compression=None))
                    ids = np.frombuffer(raw + tail, "<u4")
                    writer.add(doc_id, ids)
                    totals = [totals[0] + 1, totals[1] + len(ids)]
                at += len(texts)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path], "n_docs": pa.array([totals[0]], pa.int64()), "n_ids": pa.array([totals[1]], pa.int64())})

    # a hash of the text spreads the documents of one id, or of none, over tasks
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    ordered = hashed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return written(ordered.mapInArrow(run, MANIFEST), "ids-manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone. One task reads whole files, frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = pafs.FileSystem.from_uri(row["path"])
                start, out = row["first"], [[], [], [], []]
                with fs.open_input_file(at) as source:
                    for doc_id, ids in Reader(source).documents():
                        for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = manifest.select("part", "path", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("first"))
    return first.repartition(files).select("path", "first").mapInArrow(run, READ)


def encode_to_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write docs as token-id files in folder (one of its own in the shared folder if None) and read them back."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read_ids(write_ids(docs, folder, vocabulary))
