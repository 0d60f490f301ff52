"""Benchmark decontamination under edit distance, by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words: lower case, runs of letters, digits and underscores, but single characters of
scripts that are written without blanks (Chinese, Japanese, Thai, Lao, Burmese, Khmer). An item of n words contaminates a text if
some run of the text's words is within EDITS * n word insertions, deletions and replacements of it.

The embedding walks along a sequence: step j copies the word it stands on and then moves on by a random bit of (j, word). Two
sequences at a small edit distance mostly fall back into step, so their embeddings agree at most steps (Chakraborty, Goldenberg
and Koucky 2016). Here a walk starts at every word of a text, so each item-sized window has its embedding, and at the first
word of every item. Of each embedding, TABLES samples of a few steps are hash keys; windows that share a key with an item of
their size class are candidates, which Myers' bit vectors then verify exactly. Every second walk goes from the end backwards.
Each size class has as many walks as find RECALL of TRIALS of its items at the largest distance, by the tables' own keys, and
EMBEDDINGS at least; so it is also met where a large slice has longer keys. Recall is near 1 below that distance. Items of
fewer than WALKED words have too few steps to sample: a run within their one edit at most holds one half of theirs, or all of it,
unchanged, and is looked up by that, which misses none.

Windows that cannot match are left out first without loss. An edit takes two of the pairs of neighbouring words at most, so a run
within k edits of n words holds n - k of the item's words and n - 1 - 2 k of its pairs; so many words of n + k must be in the
benchmark's vocabulary, and so many pairs in those of the size class. Walks start where that holds within k words, as in the trials.

The benchmark is handled in slices of about SLICE_BYTES of text, each broadcast and held against all texts. A narrow map over
the texts for each slice: no shuffle, nothing of the texts reaches the driver.

Defined results: null and empty texts match nothing; items of fewer than least_words words are phrases, not passages, and
contaminate nothing; null or repeated ids are reported as they are, repeated rows each; where runs tie, the distance is the same;
a very long text is walked in one piece, some 50 bytes a word; an empty table gives no rows, an empty benchmark none either;
columns besides the named ones, whatever their names, are ignored, or kept by the filter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.worker import lean

EDITS = 0.2
#: Words that an item needs to count as a passage, and to be found by walks.
LEAST_WORDS, WALKED = 4, 8
EMBEDDINGS = 8
TABLES = 6
RECALL, TRIALS = 0.995, 1000
#: Walks of long items end here: two sequences are the more out of step the longer they are. RECALL holds for them too.
MOST_STEPS = 96
SLICE_BYTES = 8 << 20
#: Words of text taken at once.
WORDS_AT_ONCE = 1 << 17
_WORD = re.compile(r"\w+")
_UNSEGMENTED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD_OR_CHARACTER = re.compile(rf"[{_UNSEGMENTED}]|[^\W{_UNSEGMENTED}]+")


def _western(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (_WORD if _western(text) else _WORD_OR_CHARACTER).findall(text.lower())


def edits_allowed(n: int, edits: float = EDITS) -> int:
    return int(n * edits + 1e-9)


def run_distance(item: list, words: list) -> int:
    """The least edit distance between item and any run of words, by bit vectors."""
    places: dict = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, score = full, 0, len(item)
    best = score
    for w in words:
        eq = places.get(w, 0)
        vertical = eq | minus
        level = (((eq & plus) + plus) ^ plus) | eq
        rise, fall = (minus | ~(level | plus)) & full, plus & level
        score += (1 if rise & top else 0) - (1 if fall & top else 0)
        best = min(best, score)
        rise, fall = rise << 1 & full, fall << 1 & full
        plus, minus = (fall | ~(vertical | rise)) & full, rise & vertical
    return best


#: Words as numbers: 0 stands before and after every text and never lets a walk go on, 1 is a word that no item has.
PAD, UNKNOWN = 0, 1


def walk(line: np.ndarray, starts: np.ndarray, odd: np.ndarray, add: np.ndarray, wanted: set[int]) -> dict[int, np.ndarray]:
    """The embeddings from starts, at the wanted steps. The bit of step j and word w is the top bit of odd[j] * w + add[j]; add is below 2**31."""
    at, out = starts.copy(), {}
    for j in range(max(wanted) + 1):
        word = line[at]
        if j in wanted:
            out[j] = word.copy()
        word *= odd[j]
        word += add[j]
        word >>= np.uint32(31)
        np.add(at, word, out=at, casting="unsafe")
    return out


def edited(rng: np.random.Generator, words: list[int], edits: int) -> list[int]:
    """words after so many replacements, insertions and deletions of random places, by a word that no item has."""
    own = list(words)
    for kind, place in zip(rng.integers(3, size=edits).tolist(), rng.random(edits).tolist(), strict=True):
        p = int(place * len(own))
        own[p : p + (kind != 1)] = [] if kind == 2 else [UNKNOWN]
    return own


def pair_keys(line: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one."""
    keys = line[:-1] * np.uint32(0x9E3779B1)
    keys += line[1:]
    keys *= np.uint32(0x85EBCA6B)
    return keys


class SizeClass(NamedTuple):
    spans: list[tuple[int, int, int, int]]  # a stretch of so many words (third) that may hold an item within so many edits (last) has so many known pairs and words
    pairs: np.ndarray  # by pair_keys without as many last bits as follow: may be a pair of an item
    cut: np.uint32
    walks: list[tuple]  # odd, add, and samples: (steps, words that may stand at each, key -> items); odd walks are reversed


class Index:
    """What one slice of the benchmark is looked up by."""

    def __init__(self, items: list[tuple[object, str]], edits: float = EDITS, seed: int = 1, least_words: int = LEAST_WORDS):
        kept = [(i, w) for i, text in items if len(w := words_of(text)) >= max(1, least_words)]
        self.ids = [i for i, _ in kept]
        self.vocabulary = {w: k + 2 for k, w in enumerate(sorted({w for _, words in kept for w in words}))}
        self.items = [[self.vocabulary[w] for w in words] for _, words in kept]
        self.allowed = [edits_allowed(len(x), edits) for x in self.items]
        self.sets = [frozenset(x) for x in self.items]
        rng, bits = np.random.default_rng(seed), 4 if len(kept) <= 10_000 else 5
        by_class: dict[int, list[int]] = {}
        for k, x in enumerate(self.items):
            if len(x) >= WALKED:
                by_class.setdefault(1 << len(x).bit_length() - 1, []).append(k)
        self.pieces = self._pieces()
        self.classes = [self._size_class(low, members, rng, bits) for low, members in sorted(by_class.items())]

    def _size_class(self, low: int, members: list[int], rng: np.random.Generator, bits: int) -> SizeClass:
        steps, walks = min(low + low // 2, MOST_STEPS), []
        trials = rng.integers(len(members), size=TRIALS)
        lines, near, whose = self._trials([members[t] for t in trials], steps, rng)
        hit = np.zeros(TRIALS, dtype=bool)
        while len(walks) < EMBEDDINGS or hit.mean() < RECALL:
            e = len(walks)
            odd = rng.integers(0, 1 << 31, size=steps, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
            add = rng.integers(0, 1 << 31, size=steps, dtype=np.uint32)
            samples = [np.sort(rng.choice(steps, size=bits, replace=False)).tolist() for _ in range(TABLES)]
            own = [self.items[k][::-1] if e % 2 else self.items[k] for k in members]
            line = np.array([w for x in own for w in (*x, PAD)], dtype=np.uint32)
            starts = np.cumsum([0] + [len(x) + 1 for x in own[:-1]])
            seen = walk(line, starts, odd, add, {j for s in samples for j in s})
            tables, tried = [], walk(lines[e % 2], near[e % 2], odd, add, set(seen))
            for sample in samples:
                passes, by_key = [], {}
                hit[whose[e % 2][np.all([tried[j] == seen[j][trials[whose[e % 2]]] for j in sample], axis=0)]] = True
                for j in sample:
                    may = np.zeros(len(self.vocabulary) + 2, dtype=bool)
                    may[seen[j]] = True
                    passes.append(may)
                for k, key in zip(members, zip(*(seen[j].tolist() for j in sample), strict=True), strict=True):
                    by_key.setdefault(key, []).append(k)
                tables.append((sample, passes, by_key))
            walks.append((odd, add, tables))
        spans: dict[int, list[int]] = {}
        for k in members:
            spans.setdefault(self.allowed[k], []).append(len(self.items[k]))
        keys = np.unique(pair_keys(np.array([w for k in members for w in (*self.items[k], PAD)], dtype=np.uint32)))
        size = (8 * len(keys)).bit_length()
        pairs, cut = np.zeros(1 << size, dtype=bool), np.uint32(32 - size)
        pairs[keys >> cut] = True
        return SizeClass([(min(n) - 1 - 2 * k, min(n) - k, max(n) + k, k) for k, n in sorted(spans.items())], pairs, cut, walks)

    def _pieces(self) -> list[tuple[list[np.ndarray], dict[tuple, list[tuple[int, int]]]]]:
        """Of short items, by length of piece: words that may stand at each place, and piece -> (item, its place in it)."""
        found: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for k, x in enumerate(self.items):
            if len(x) < WALKED:
                parts = self.allowed[k] + 1
                cuts = [len(x) * p // parts for p in range(parts + 1)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    found.setdefault(b - a, {}).setdefault(tuple(x[a:b]), []).append((k, a))
        out = []
        for n, pieces in sorted(found.items()):
            may = np.zeros((n, len(self.vocabulary) + 2), dtype=bool)
            for piece in pieces:
                may[np.arange(n), piece] = True
            out.append((list(may), pieces))
        return out

    def _short(self, flat: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, end, item) of stretches that may hold a short item."""
        pads = np.flatnonzero(flat == PAD)
        for passes, pieces in self.pieces:
            rows = np.arange(max(0, len(flat) - len(passes) + 1))
            for j, may in enumerate(passes):
                rows = rows[may[flat[rows + j]]]
            after = np.searchsorted(pads, rows)
            for at, begin, end in zip(rows.tolist(), (pads[after - 1] + 1).tolist(), pads[after].tolist(), strict=True):
                for item, offset in pieces.get(tuple(flat[at : at + len(passes)].tolist()), ()):
                    n, k = len(self.items[item]), self.allowed[item]
                    yield max(begin, at - offset - k), min(end, at - offset + n + k), item

    def _trials(self, chosen: list[int], steps: int, rng: np.random.Generator) -> tuple:
        """Chosen items at the largest distance, among words that no item has: by direction, a line of them, the places near their starts, and whose these are."""
        lines, near, whose = ([PAD], [PAD]), ([], []), ([], [])
        for t, item in enumerate(chosen):
            k = self.allowed[item]
            own = edited(rng, self.items[item], k)
            for line, places, of, words in zip(lines, near, whose, (own, own[::-1]), strict=True):
                before = min(k, steps)
                start = len(line) + before
                places.extend(range(start - before, start + min(before, len(words) - 1) + 1))
                of.extend([t] * (len(places) - len(of)))
                line.extend([UNKNOWN] * before + words[: 3 * steps] + [UNKNOWN] * steps + [PAD])
        return [np.array(x, dtype=np.uint32) for x in lines], [np.array(x) for x in near], [np.array(x) for x in whose]

    @staticmethod
    def _starts(spans: list[tuple[int, int, int, int]], known: np.ndarray, paired: np.ndarray, pads: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places within the edits of one where a stretch begins that may hold an item, in the same text. known and paired count words and pairs before a place."""
        places, lows, highs = np.arange(len(ends)), [], []
        for pairs, words, span, edits in spans:
            upto = np.minimum(places + span, ends)
            rows = np.flatnonzero(paired[upto - 1] - paired >= pairs)
            rows = rows[(known[upto[rows]] - known[rows] >= words) & (ends[rows] > rows)]
            end = ends[rows]
            lows.append(np.maximum(rows - edits, pads[np.searchsorted(pads, end) - 1] + 1))
            highs.append(np.minimum(rows + edits + 1, end))
        begun, ended = (np.bincount(np.concatenate(x), minlength=len(ends) + 1) for x in (lows, highs))
        return np.flatnonzero(np.cumsum(begun - ended))

    def candidates(self, flat: np.ndarray) -> set[tuple[int, int, int]]:
        """(first word, end, item) of stretches of one text of flat that may hold item. flat has a pad before and after every text."""
        found, keys = set(self._short(flat)), pair_keys(flat)
        in_pairs = [c.pairs[keys >> c.cut] for c in self.classes]
        for backwards in (0, 1):
            line = np.ascontiguousarray(flat[::-1]) if backwards else flat
            pads = np.flatnonzero(line == PAD)
            ends = np.repeat(pads, np.diff(pads, prepend=-1))
            known = np.concatenate([[0], np.cumsum(line > UNKNOWN, dtype=np.int32)])
            for (spans, _, _, walks), hits in zip(self.classes, in_pairs, strict=True):
                paired = np.concatenate([[0], np.cumsum(hits[::-1] if backwards else hits, dtype=np.int32)])
                starts = self._starts(spans, known, paired, pads, ends)
                if not len(starts):
                    continue
                for odd, add, tables in walks[backwards::2]:
                    seen = walk(line, starts, odd, add, {j for sample, _, _ in tables for j in sample})
                    for sample, passes, by_key in tables:
                        rows = np.arange(len(starts))
                        for j, may in zip(sample, passes, strict=True):
                            rows = rows[may[seen[j][rows]]]
                        own = starts[rows]
                        begins = pads[np.searchsorted(pads, own) - 1] + 1
                        for at, begin, key in zip(own.tolist(), begins.tolist(), zip(*(seen[j][rows].tolist() for j in sample), strict=True), strict=True):
                            for item in by_key.get(key, ()):
                                n, k = len(self.items[item]), self.allowed[item]
                                first, end = max(begin, at - k), min(int(ends[at]), at + n + 2 * k)
                                found.add((len(line) - end, len(line) - first, item) if backwards else (first, end, item))
        return found

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, item, distance) for each item that contaminates a text."""
        get, parts, starts = self.vocabulary.get, [PAD], []
        for text in texts:
            starts.append(len(parts))
            parts.extend(map(get, words_of(text), repeat(UNKNOWN)))
            parts.append(PAD)
        stretches: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for first, end, item in self.candidates(np.array(parts, dtype=np.uint32)):
            stretches.setdefault((bisect_right(starts, end - 1) - 1, item), []).append((first, end))
        for (number, item), spans in sorted(stretches.items()):
            best, upto = len(self.items[item]), []
            for first, end in sorted(spans):
                if upto and first <= upto[-1][1]:
                    upto[-1][1] = max(end, upto[-1][1])
                else:
                    upto.append([first, end])
            for first, end in upto:
                words = parts[first:end]
                # a run that near holds all but as many of the item's words
                if sum(map(self.sets[item].__contains__, words)) >= len(self.items[item]) - self.allowed[item]:
                    best = min(best, run_distance(self.items[item], words))
            if best <= self.allowed[item]:
                yield number, item, best


def slices(benchmark: DataFrame, size: int = SLICE_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items, about size bytes of text at once."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = -(-total // size)
    for k in range(many):
        part = items if many == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


SCHEMA = "doc_id long, item_id long, distance long, n_words long, similarity double"


def _by_words(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first, texts): runs of texts of about WORDS_AT_ONCE words at most, or one longer text. Holds one run's texts."""
    first, held, size = 0, [], 0
    for text in texts:
        more = len(text or "") // 5
        if held and size + more > WORDS_AT_ONCE:
            yield first, held
            first, held, size = first + len(held), [], 0
        held.append(text)
        size += more
    if held:
        yield first, held


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of docs (doc_id, text) and each item of benchmark (item_id, text) that contaminates it."""
    spark, out = docs.sparkSession, None
    for items in slices(benchmark):
        held = spark.sparkContext.broadcast(Index(items, edits, least_words=least_words))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                doc_ids, rows = batch.column("doc_id").to_pylist(), []
                for first, texts in _by_words(t.as_py() for t in batch.column("text")):
                    for number, item, distance in index.matches(texts):
                        n = len(index.items[item])
                        rows.append((doc_ids[first + number], index.ids[item], distance, n, round(1 - distance / n, 6)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "n_words", "similarity"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates. A narrow map for each slice of the benchmark."""
    spark = docs.sparkSession
    for items in slices(benchmark):
        held = spark.sparkContext.broadcast(Index(items, edits, least_words=least_words))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [True] * batch.num_rows
                for first, texts in _by_words(t.as_py() for t in batch.column(batch.schema.get_field_index("text"))):
                    for number, _, _ in held.value.matches(texts):
                        clean[first + number] = False
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
