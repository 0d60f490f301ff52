"""Cross-entropy difference of two matched bigram models (Moore and Lewis 2010).

The target model is fitted on trusted documents, the background model on all of them; both share one vocabulary and one
smoothing. A document's score is its loss for each token under the target model less that under the background model, in nats:
the lower, the more it is like the target. Words are lower case, between blanks; a start mark stands before a document's first
word, and an end mark is predicted after its last.

P(w | v) = (count(v w) + MASS / V) / (count(v) + MASS), with V outcomes: the distinct words of all documents, and the end mark. For
each v they sum to one. Every bigram of every document counts, and every document with label quality 1 that isn't toxic is trusted.

Counting and pricing are one shuffle there and one back. A task packs some BATCH_TOKENS tokens of documents into one row for each
bucket of first words v: the distinct bigrams with their counts, and the documents that have them. A bucket's task adds up the
counts of all rows and sends each row's documents the losses of their bigrams, rounded to 1 / UNITS nat, so that sums are the same
in any order. There are as many buckets as keep one at about BUCKET_TOKENS. A bucket with more than HOT times the mean, as that of
`the`, is split by the second word, and the counts of its first words are sent to all its parts.

A survey counts tokens by bucket and distinct words first. Words go by 40 bits of their xxHash within their cell or bucket (the bits
before these), second words by 32 within their first word; so with ten million words, less than one pair of them is taken for one.
Counts and losses are packed by zstandard, as most of them are alike. Trusted documents are marked as in quality.marked: a filter of
bounded size is broadcast, and only documents that it lets through are merged with the ids. Nothing else of the corpus is broadcast
or collected but 256 rows of the survey. A batch must come in the same order if its task is run again, as from files or a sorted
shuffle.

Defined results: a text without words (null, empty, blank) has no tokens, and losses and score 0.0; repeated rows each count and
are each scored; labels without an id mark none; without trusted documents the target model is uniform; a very long text makes a
batch of its own, some 100 bytes a word; an empty table gives no rows; columns besides doc_id and text, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.quality import marked, trusted_ids

MASS = 2.0
UNITS = 1000
BATCH_TOKENS, BATCH_DOCS, BUCKET_TOKENS = 1 << 20, 60_000, 1 << 21
HOT = 4
#: Buckets at least; cells of the survey, and parts of each in which tokens are counted.
BUCKETS, CELLS, PARTS = 512, 256, 16
CACHE_WORDS = 500_000
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_STARTS, _ENDS = np.array([START]), np.array([END])


class Survey(NamedTuple):
    outcomes: int  # distinct words and the end mark
    tokens: np.ndarray  # bigrams by the leading bits of their first word's hash


class Hasher:
    """64-bit hashes of words; keeps those of up to CACHE_WORDS words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words, known = text.lower().split() if text else [], self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """Runs of documents of about BATCH_TOKENS words: ids, marks (0 without that column), and hashes of their words."""
    hasher, ids, marks, lines, held = Hasher(), [], [], [], 0
    for batch in batches:
        mark = batch.column("mark").to_pylist() if "mark" in batch.schema.names else [0] * batch.num_rows
        for doc_id, text, m in zip(batch.column("doc_id").to_pylist(), batch.column("text"), mark, strict=True):
            own = hasher.of(text.as_py())
            if lines and (held + len(own) > BATCH_TOKENS or len(lines) == BATCH_DOCS):
                yield ids, marks, lines
                ids, marks, lines, held = [], [], [], 0
            ids.append(doc_id)
            marks.append(m)
            lines.append(own)
            held += len(own)
    if lines:
        yield ids, marks, lines


def _leading(hashes: np.ndarray, count: int) -> np.ndarray:
    """Which of count (a power of two) equal ranges a hash is in."""
    return (hashes >> np.uint64(65 - count.bit_length())).astype(np.int64)


def _forty(hashes: np.ndarray, count: int) -> np.ndarray:
    """The 40 bits of a hash behind those that name its range of count."""
    return (hashes << np.uint64(count.bit_length() - 1)) >> np.uint64(24)


def _five_bytes(numbers: np.ndarray) -> bytes:
    return numbers.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _from_five_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, 3:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.uint64)


def survey(docs: DataFrame) -> Survey:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, lines in _batches(batches):
            words = np.concatenate(lines)
            tokens = np.bincount(_leading(words, CELLS * PARTS), minlength=CELLS * PARTS)
            tokens[_leading(START, CELLS * PARTS)] += sum(len(x) > 0 for x in lines)
            words = np.unique(words)
            cuts = np.searchsorted(_leading(words, CELLS), np.arange(CELLS + 1))
            words = _forty(words, CELLS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(CELLS), pa.int32()), pa.array([_five_bytes(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.array([x.tobytes() for x in tokens.reshape(CELLS, PARTS)], pa.binary())],
                names=["cell", "words", "tokens"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (cell,), rows in _groups(batches, ["cell"]):
            seen, tokens = np.zeros(0, dtype=np.uint64), np.zeros(PARTS, dtype=np.int64)
            for row in rows:
                seen = np.union1d(seen, _from_five_bytes(row["words"]))
                tokens = tokens + np.frombuffer(row["tokens"], dtype=np.int64)
            out.append((cell, len(seen), tokens.tolist()))
        yield pa.RecordBatch.from_pylist([dict(zip(("cell", "words", "tokens"), x, strict=True)) for x in out], pa.schema([("cell", pa.int32()), ("words", pa.int64()), ("tokens", pa.list_(pa.int64()))]))

    rows = docs.select("doc_id", "text").mapInArrow(count, "cell int, words binary, tokens binary").repartition("cell").sortWithinPartitions("cell")
    tokens, words = np.zeros((CELLS, PARTS), dtype=np.int64), 0
    for r in rows.mapInArrow(add, "cell int, words long, tokens array<long>").collect():
        tokens[r.cell], words = r.tokens, words + r.words
    return Survey(words + 1, tokens.ravel())


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, its rows) one after the other; rows of a key follow each other, and are read as they are asked for."""
    rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
    return groupby(rows, lambda row: tuple(row[k] for k in key))


def bucket_parts(tokens: np.ndarray) -> np.ndarray:
    """In how many parts each bucket is split."""
    many, total = BUCKETS, int(tokens.sum())
    while many * BUCKET_TOKENS < total:
        many *= 2
    if many <= len(tokens):
        own = tokens.reshape(many, -1).sum(axis=1)
    else:
        own = np.repeat(tokens, many // len(tokens))  # at most: a first word of many tokens has them all in one bucket
    mean = max(1.0, total / many)
    return np.where(own > HOT * mean, np.ceil(own / mean), 1).astype(np.int64)


#: A row of packed bigrams: first words, how many bigrams each has, second words, counts in all and trusted documents, how many
#: documents each bigram has, these documents' places in their batch, and how often they have it. kind 0 has first words alone.
PACKED = ("firsts", "many", "seconds", "n", "target", "docs", "doc", "times")
ROW = "kind int, bucket int, part int, batch long, ids array<long>, words array<long>, " + ", ".join(f"{x} binary" for x in PACKED)
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), *((x, pa.binary()) for x in PACKED)])
_PLAIN = {"seconds": np.uint32, "doc": np.uint16}
FIRSTS, BIGRAMS, DOCUMENTS = 0, 1, 2


def _zipped(own: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(own.tobytes())


def _unzipped(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def _put(column: str, own: np.ndarray) -> bytes:
    if column == "firsts":
        return _five_bytes(own)
    return own.astype(_PLAIN[column]).tobytes() if column in _PLAIN else _zipped(own.astype(np.uint32))


def _got(column: str, raw: bytes) -> np.ndarray:
    if column == "firsts":
        return _from_five_bytes(raw)
    return np.frombuffer(raw, dtype=_PLAIN[column]) if column in _PLAIN else _unzipped(raw, np.uint32)


def _runs(own: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)


def _packed(marks: list, lines: list[np.ndarray], parts: np.ndarray) -> Iterator[dict]:
    """The rows of one batch."""
    whole = np.concatenate([x for own in lines if len(own) for x in (_STARTS, own, _ENDS)] or [_STARTS[:0]])
    words, place = np.unique(whole, return_inverse=True)
    size = np.array([len(x) + 2 if len(x) else 0 for x in lines])
    doc = np.repeat(np.arange(len(lines)), size)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    bits, low = max(1, len(words).bit_length()), np.uint64(max(1, (len(lines) - 1).bit_length()))
    # one number for first word, second word and document: sorted, runs are bigrams and their documents
    each = np.sort((place[inside].astype(np.uint64) << (low + np.uint64(bits))) | (place[inside + 1].astype(np.uint64) << low) | doc[inside].astype(np.uint64))
    start = _runs(each)
    times, each = np.diff(np.append(start, len(each))), each[start]
    doc = (each & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    mark, pair = np.array(marks, dtype=np.int64)[doc], each >> low
    start = _runs(pair)
    n, target, docs, pair = np.add.reduceat(times, start), np.add.reduceat(times * mark, start), np.diff(np.append(start, len(pair))), pair[start]
    first, second = (pair >> np.uint64(bits)).astype(np.int64), (words[(pair & np.uint64((1 << bits) - 1)).astype(np.int64)] >> np.uint64(32)).astype(np.uint32)
    bucket = _leading(words[first], len(parts))
    edge = np.append(start, len(doc))
    cuts = np.append(_runs(bucket), len(bucket))

    def row(kind: int, part: int, rows: np.ndarray, own: np.ndarray, **more) -> dict:
        heads = _runs(first[rows])
        columns = {"firsts": _forty(words[first[rows][heads]], len(parts)), "many": np.diff(np.append(heads, len(rows))), "seconds": second[rows], "n": n[rows], "target": target[rows], "docs": docs[rows], "doc": doc[own], "times": times[own]} | more
        return {"kind": kind, "bucket": int(bucket[rows[0]]), "part": part} | {k: _put(k, v) for k, v in columns.items()}

    none = np.zeros(0)
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows, k = np.arange(a, b), int(parts[bucket[a]])
        if k == 1:
            yield row(BIGRAMS, 0, rows, np.arange(edge[a], edge[b]))
            continue
        heads = _runs(first[rows])
        sums = {"n": np.add.reduceat(n[rows], heads), "target": np.add.reduceat(target[rows], heads), "many": none, "seconds": none, "docs": none, "doc": none, "times": none}
        side = second[rows] % np.uint32(k)
        for part in range(k):
            yield row(FIRSTS, part, rows, none.astype(np.int64), **sums)
            if len(own := rows[side == part]):
                ends = np.cumsum(docs[own])
                yield row(BIGRAMS, part, own, np.repeat(edge[own] - ends + docs[own], docs[own]) + np.arange(ends[-1]))


def _read(rows: list[dict], column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of all rows, and how much of it each has."""
    own = [_got(column, r[column]) for r in rows]
    return np.concatenate(own) if own else np.zeros(0, dtype=np.uint32), np.array([len(x) for x in own], dtype=np.int64)


def _priced(rows: list[dict], outcomes: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """For each row of bigrams of one bucket's part: batch, documents, times, and the losses under both models."""
    alone, rows = [r for r in rows if r["kind"] == FIRSTS], [r for r in rows if r["kind"] == BIGRAMS]
    firsts, many_firsts = _read(rows, "firsts")
    words, place = np.unique(firsts, return_inverse=True)
    first = np.repeat(place, _read(rows, "many")[0])
    seconds, per_row = _read(rows, "seconds")
    counts = np.stack([_read(rows, "target")[0], _read(rows, "n")[0]]).astype(np.float64)
    pairs, pair = np.unique((first.astype(np.uint64) << np.uint64(32)) | seconds, return_inverse=True)
    of_pair = np.stack([np.bincount(pair, weights=c, minlength=len(pairs)) for c in counts])
    if alone:
        own, _ = _read(alone, "firsts")
        at = np.minimum(np.searchsorted(words, own), max(0, len(words) - 1))
        known = words[at] == own if len(words) else np.zeros(len(own), dtype=bool)
        of_first = np.stack([np.bincount(at[known], weights=_read(alone, c)[0][known].astype(np.float64), minlength=len(words)) for c in ("target", "n")])
    else:
        of_first = np.stack([np.bincount(first, weights=c, minlength=len(words)) for c in counts])
    loss = np.log(of_first[:, (pairs >> np.uint64(32)).astype(np.int64)] + MASS) - np.log(of_pair + MASS / outcomes)
    units = np.rint(loss * UNITS).astype(np.uint16)[:, pair]
    ends = np.cumsum(per_row)
    for r, a, b in zip(rows, ends - per_row, ends, strict=True):
        docs = _got("docs", r["docs"])
        yield r["batch"], r["doc"], r["times"], _zipped(np.repeat(units[0, a:b], docs)), _zipped(np.repeat(units[1, a:b], docs))


ANSWER = "batch long, ids array<long>, words array<long>, doc binary, times binary, target binary, background binary"
_ANSWER = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("doc", "times", "target", "background"))])
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def score(docs: DataFrame, trusted: DataFrame, found: Survey) -> DataFrame:
    """One row for each row of docs (doc_id, text); trusted has the ids of the target's documents, each once."""
    parts, outcomes = bucket_parts(found.tokens), found.outcomes
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = marked(named, trusted)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (ids, mark, lines) in enumerate(_batches(batches)):
            name = {"batch": task << 24 | k}
            out = [row | name for row in _packed(mark, lines, parts)]
            out.append({"kind": DOCUMENTS, "bucket": -1 - task, "part": k, "ids": ids, "words": [len(x) for x in lines]} | name)
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _), rows in _groups(batches, ["bucket", "part"]):
            if bucket < 0:
                answers = [{"batch": r["batch"], "ids": r["ids"], "words": r["words"]} for r in rows]
            else:
                answers = [dict(zip(("batch", "doc", "times", "target", "background"), x, strict=True)) for x in _priced(list(rows), outcomes)]
            yield pa.RecordBatch.from_pylist(answers, _ANSWER)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (batch,), rows in _groups(batches, ["batch"]):
            ids, words, sums = None, None, np.zeros((3, BATCH_DOCS), dtype=np.int64)
            for r in rows:
                if r["ids"] is not None:
                    ids, words = r["ids"], np.array(r["words"], dtype=np.int64)
                    continue
                doc, times = _got("doc", r["doc"]), _got("times", r["times"]).astype(np.int64)
                np.add.at(sums[0], doc, times)
                for k, column in ((1, "target"), (2, "background")):
                    np.add.at(sums[k], doc, times * _unzipped(r[column], np.uint16))
            if ids is None or not np.array_equal(sums[0, : len(ids)], np.where(words > 0, words + 1, 0)):
                raise RuntimeError(f"batch {batch} was packed in two different orders")
            target, background = sums[1:, : len(ids)] / (np.maximum(sums[0, : len(ids)], 1) * UNITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words), *(pa.array(np.round(x, 6)) for x in (target, background, target - background))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
            )

    packed = rows.mapInArrow(pack, ROW).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    answers = packed.mapInArrow(price, ANSWER).repartition("batch").sortWithinPartitions("batch")
    return answers.mapInArrow(add, SCORES)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, trusted_ids(labels), survey(docs))
