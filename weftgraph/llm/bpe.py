"""Byte-level BPE encoding and decoding by ranks, on length-bucketed padded numpy matrices.

A text is cut at single blanks between other characters, where the splitting pattern always cuts too; the pieces of pattern
matches in such chunks are encoded once each and kept in a bounded cache. Pieces of like length form one matrix of token
ids. In every round each row merges its leftmost pair of least rank, which takes one cell out of every row, so the matrix
closes up by a column; rows without a pair leave it. Ranks of pairs come from an open-addressing hash table.

A documented exit: a single match of the pattern of more than LONG bytes (a run of so many letters, marks or blanks without a
boundary) would be one row as long as its rounds, n * n cells, so it alone is merged with a heap, in the same order, in n log n.

Defined results: a null text counts as empty; an empty text has no ids, and both digests are those of nothing; null ids stay;
repeated rows are each encoded; of pairs of equal rank the leftmost is merged first; a very long text is encoded alone, whole; an
empty table gives no rows; columns besides doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftgraph.llm.worker import lean

NONE = np.int64(1 << 40)
PAD = 1 << 20
LONG = 512
#: Cells in one matrix, chunks whose ids a worker keeps, and characters of text taken at once.
CELLS, CACHE_CHUNKS, TEXT_CHARS = 1 << 20, 300_000, 1 << 21
_EDGE = re.compile(r"(?<=\S) (?=\S)")


class PairTable:
    """(left id, right id) -> id of the merged token, for every split of every token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * (PAD << 1) + right] = rank
        bits = max(4, len(pairs).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int64)
        for key, home in zip(pairs, self._home(np.array(list(pairs), dtype=np.int64)).tolist(), strict=True):
            while self.keys[home] != -1:
                home = (home + 1) & self.mask
            self.keys[home], self.values[home] = key, pairs[key]

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (PAD << 1) + right
        slot = self._home(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], NONE)
        rows = np.flatnonzero((held != key) & (held != -1))
        key, slot = key.ravel(), slot.ravel()
        flat = out.reshape(-1)
        while len(rows):
            slot[rows] = (slot[rows] + 1) & self.mask
            held = self.keys[slot[rows]]
            hit = held == key[rows]
            flat[rows[hit]] = self.values[slot[rows[hit]]]
            rows = rows[~hit & (held != -1)]
        return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.digits_of = {rank: str(rank) for rank in self.bytes_of}
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = np.array([rank], dtype=np.int32)
            elif len(piece) > LONG:
                out[k] = np.array(self._merge_long(piece), dtype=np.int32)
            else:
                buckets.setdefault(len(piece) if len(piece) <= 16 else -(-len(piece) // 16) * 16, []).append(k)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                rows = members[at : at + step]
                for k, ids in zip(rows, self._merge_rows([pieces[k] for k in rows], width), strict=True):
                    out[k] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        sizes = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], PAD)
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(pieces)
        row_of = np.arange(len(pieces))
        while len(row_of):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row_of), dtype=np.int64)
            every = np.arange(len(row_of))
            best = rank[every, at] if rank.shape[1] else np.full(len(row_of), NONE)
            if len(ended := np.flatnonzero(best == NONE)):
                rows = ids[ended].astype(np.int32)
                for k, row, n in zip(row_of[ended].tolist(), rows, (rows != PAD).sum(axis=1).tolist(), strict=True):
                    out[k] = row[:n]
                live = best != NONE
                ids, rank, row_of, at, best = ids[live], rank[live], row_of[live], at[live], best[live]
                every = np.arange(len(row_of))
                if not len(row_of):
                    break
            ids[every, at] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(len(row_of), -1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[every, at] = False
            rank = rank[keep].reshape(len(row_of), -1)
            if len(inner := np.flatnonzero(at < rank.shape[1])):
                rank[inner, at[inner]] = self.pairs(ids[inner, at[inner]], ids[inner, at[inner] + 1])
            if len(inner := np.flatnonzero(at > 0)):
                rank[inner, at[inner] - 1] = self.pairs(ids[inner, at[inner] - 1], ids[inner, at[inner]])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, in O(n log n): a heap of (rank, place, ends)."""
        ends = list(range(1, len(piece) + 1))  # of the part that starts at each place; 0 where none starts
        prior = list(range(-1, len(piece)))
        heap: list[tuple[int, int, int, int]] = []

        def offer(start: int) -> None:
            mid = ends[start]
            if mid < len(piece) and (rank := self.ranks.get(piece[start : ends[mid]])) is not None:
                heapq.heappush(heap, (rank, start, mid, ends[mid]))

        for start in range(len(piece) - 1):
            offer(start)
        while heap:
            _, start, mid, end = heapq.heappop(heap)
            if ends[start] != mid or ends[mid] != end:
                continue
            ends[start], ends[mid], prior[end] = end, 0, start
            offer(start)
            if prior[start] >= 0:
                offer(prior[start])
        ids, start = [], 0
        while start < len(piece):
            ids.append(self.ranks[piece[start : ends[start]]])
            start = ends[start]
        return ids

    def _learn(self, chunks: list[str]) -> None:
        matches = [[m.encode("utf-8", "surrogatepass") for m in self.pattern.findall(c)] for c in chunks]
        pieces = list({m for each in matches for m in each})
        ids = dict(zip(pieces, self.merge(pieces), strict=True))
        for chunk, each in zip(chunks, matches, strict=True):
            self.known[chunk] = b"".join(ids[m].tobytes() for m in each)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = []
        for text in texts:
            first, *rest = _EDGE.split(text)
            cut.append([first, *[" " + x for x in rest]])
        wanted = {c for chunks in cut for c in chunks}
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        if new := [c for c in wanted if c not in self.known]:
            self._learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), dtype=np.int32) for chunks in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker, with its cache."""
    return Encoder(path, pattern)


def by_size(texts: list, most: int = TEXT_CHARS) -> Iterator[list]:
    """Runs of texts of about most characters; a longer text comes alone."""
    part, held = [], 0
    for text in texts:
        text = text.as_py() or ""
        if part and held + len(text) > most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text and decode the ids: one row for each row of docs (doc_id, text). A narrow map: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts, ids_sha, back_sha = [], [], []
            for texts in by_size(batch.column("text")):
                for ids in own.encode(texts):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(own.digits_of.__getitem__, ids.tolist())).encode()).hexdigest())
                    back_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def token_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether they decode to the text's bytes: what a trainer reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        try:
            for batch in batches:
                at = 0
                for texts in by_size(batch.column("text")):
                    ids = own.encode(texts)
                    intact = [own.decode(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
                    doc_ids = batch.column("doc_id").slice(at, len(texts)).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(intact, pa.bool_())],
                        names=["doc_id", "n_tokens", "ids", "intact"],
                    )
                    at += len(texts)
        finally:
            own.known = {}  # the worker goes on to other stages; a next task's texts hardly share chunks with these

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>, intact boolean")
