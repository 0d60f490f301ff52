"""Language identification, word first with backoff to character n-grams.

A known word scores by the log of its smoothed frequency in each language. A word that training did not keep scores by the
longest of its character n-grams, from GRAM_MOST down to 1, of which any was kept: the mean of their logs. The language of
the largest sum over the text's words wins, ties going to the first name.

Training reads about SAMPLE documents of each language at most, chosen by a hash of doc_id among those offered; counts are
summed in each task before the shuffle. All words and n-grams that occur twice or more in the sample of a language are kept. The broadcast
model holds an entry for each of these, and one number for each language and length for all that isn't kept; the sample bounds it.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing can be learned;
documents of null language or id teach nothing; repeated rows are each scored; a very long text is scored whole; an empty
table gives no rows; columns besides doc_id, text and lang, whatever their names, are ignored, and the last never enters a
prediction. The filter keeps all columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.worker import lean

SAMPLE = 3_000
GRAM_MOST = 5
SMOOTHING = 0.5
UNKNOWN = "und"
#: Words whose scores a worker keeps, and scores, one for each language.
CACHE_WORDS, CACHE_SCORES = 1 << 16, 1 << 21
#: Numbers of a model, rows times languages, that a worker unfolds into a matrix; the entries of a larger one are read as they are.
DENSE = 1 << 23
#: A pipeline drops documents that score below this.
LEAST_SCORE = 0.35
_WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    edged = f"_{word}_"
    return [edged[k : k + n] for k in range(max(1, len(edged) - n + 1))] if n > 1 else list(word)


class Model(NamedTuple):
    langs: list[str]
    rows: list[dict[str, int]]  # by n-gram length, words at 0: token -> its row
    base: np.ndarray  # by length and language: log frequency of what isn't kept
    starts: np.ndarray  # row -> its first entry
    lang: np.ndarray  # of each entry
    gain: np.ndarray  # of each entry: its log frequency less the base

    def row_logs(self, row: int, n: int) -> np.ndarray:
        """Log frequency of the token in that row, of length n, in each language."""
        out, own = self.base[n].copy(), slice(self.starts[row], self.starts[row + 1])
        out[self.lang[own]] += self.gain[own]
        return out

    def logs_of(self, token: str, n: int) -> np.ndarray:
        return self.row_logs(self.rows[n][token], n)

    def dense(self) -> np.ndarray | None:
        """All rows as one matrix, if that has no more than DENSE numbers."""
        if (len(self.starts) - 1) * len(self.langs) > DENSE:
            return None
        out = np.repeat(self.base, [len(x) for x in self.rows], axis=0)
        out[np.repeat(np.arange(len(out)), np.diff(self.starts)), self.lang] += self.gain
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on docs (doc_id, text, lang), all of which may teach."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    many = docs.groupBy("lang").count()
    part = many.select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("part"))
    chosen = docs.join(F.broadcast(part), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("part") * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text.as_py()))
            for lang, own in words.items():
                for n in range(GRAM_MOST + 1):
                    tally = own
                    if n:
                        tally = Counter()
                        for word, times in own.items():
                            for gram in grams_of(word, n):
                                tally[gram] += times
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([lang] * len(tally), pa.string()), "n": pa.array([n] * len(tally), pa.int32()), "token": pa.array(list(tally), pa.string()), "times": pa.array(list(tally.values()), pa.int64())}
                    )

    counts = chosen.mapInArrow(lean(count), "lang string, n int, token string, times long").groupBy("lang", "n", "token").agg(F.sum("times").alias("times")).persist()
    rows: list[dict[str, int]] = [{} for _ in range(GRAM_MOST + 1)]
    starts, lang_of, times_of, entries = [], [], [], 0
    try:
        totals = {(r.lang, r.n): r.total for r in counts.groupBy("lang", "n").agg(F.sum("times").alias("total")).collect()}
        langs = sorted({lang for lang, _ in totals})
        number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1 if langs else F.lit(0)
        for n, own in enumerate(rows):  # one length after the other, so the driver holds the rows of one beside the model
            kept = counts.where((F.col("times") >= 2) & (F.col("n") == n)).select("token", number.cast("int").alias("lang"), "times").toArrow()
            kept = kept.take(pc.sort_indices(kept, sort_keys=[("token", "ascending"), ("lang", "ascending")]))
            for token in kept.column("token"):
                if (token := token.as_py()) not in own:
                    own[token] = len(starts)
                    starts.append(entries)
                entries += 1
            lang_of.append(kept.column("lang").to_numpy())
            times_of.append(kept.column("times").to_numpy())
            del kept
    finally:
        counts.unpersist()
    total = np.array([[totals.get((lang, n), 0) for lang in langs] for n in range(GRAM_MOST + 1)], dtype=float).reshape(GRAM_MOST + 1, len(langs))
    size = np.array([len(x) for x in rows])
    base = np.log(SMOOTHING / (total + SMOOTHING * (size[:, None] + 1)))
    gain = np.log((np.concatenate(times_of).astype(float) + SMOOTHING) / SMOOTHING)
    return Model(langs, rows, base, np.array([*starts, entries]), np.concatenate(lang_of).astype(np.int32), gain.astype(np.float32))


class Scorer:
    """Scores texts in one worker. Rows of words that it has met are kept in a matrix, which doubles when it is full."""

    def __init__(self, model: Model):
        self.model, self.known, self.dense = model, {}, model.dense()
        self.logs = np.zeros((4096, len(model.langs)))

    def _row(self, word: str) -> int:
        place = self.known.get(word)
        if place is None:
            place = self.known[word] = len(self.known)
            if place == len(self.logs):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            row = self.model.rows[0].get(word)
            self.logs[place] = self._backoff(word) if row is None else self._mean([row], 0)
        return place

    def _mean(self, rows: list[int], n: int) -> np.ndarray:
        if self.dense is None:
            return np.mean([self.model.row_logs(row, n) for row in rows], axis=0)
        return self.dense[rows].mean(axis=0) if len(rows) > 1 else self.dense[rows[0]]

    def _backoff(self, word: str) -> np.ndarray:
        for n in range(min(GRAM_MOST, len(word) + 2), 0, -1):
            known = self.model.rows[n]
            if found := [known[g] for g in grams_of(word, n) if g in known]:
                return self._mean(found, n)
        return np.zeros(len(self.model.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.known) > min(CACHE_WORDS, CACHE_SCORES // len(self.model.langs)):
            self.known = {}
        rows = [self._row(w) for w in words]
        sums = self.logs[rows].sum(axis=0)
        share = np.exp((sums - sums.max()) / len(words) ** 0.5)
        best = int(sums.argmax())
        return self.model.langs[best], float(share[best] / share.sum())


def _mapped(docs: DataFrame, model: Model, put, schema) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            yield put(batch, [scorer.predict(t.as_py()) for t in batch.column("text")])

    return docs.mapInArrow(lean(run), schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs. A narrow map: no shuffle."""

    def put(batch: pa.RecordBatch, found: list[tuple[str, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return _mapped(rows, model, put, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose language is predicted with score least or more."""

    def put(batch: pa.RecordBatch, found: list[tuple[str, float]]) -> pa.RecordBatch:
        return batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return _mapped(docs, model, put, docs.schema)
