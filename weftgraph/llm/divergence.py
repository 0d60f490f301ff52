"""Audit of how sources differ from each other and from their language: divergence of every two sources, and each one's own terms.

Terms are runs of letters (ASCII ones lower-cased) and of characters beyond ASCII. A language keeps the terms of LEAST_DOCS of its
documents or more, V of them. A group (language and source), or a language, that has a kept term count times among its N has it with
p = 1 + SCALE * (count + PRIOR) div (N + PRIOR * V), in whole numbers throughout.

Divergence of two sources is the sum of |p - q| over all kept terms. Most terms are in neither: there p and q are the groups'
baselines, so the sum is V times the difference of the baselines, plus a correction for each term that one or both have. A task
gets a slice of the terms for a block of sources against a block, as rows sorted by term, and makes one number for each two sources.
Terms of one group alone are corrected by a search of the baselines among its sorted values, terms of both pair by pair.

Own terms are those with p above the language's q; the TOP by p - q are found by radix selection: histograms of DIGIT bits of the value,
counted where the rows are, tell a group's digit in which its TOP-th value lies, and rows of that digit alone go on to the next. What is
still tied at the whole value goes on by bytes of UTF-8. At most SORTED rows of a group beside the chosen ones are ever sorted.

Defined results: a null text, lang or source is an empty one; repeated rows count each; a group without terms diverges like any other
and has no own terms; a language that keeps no term has divergences of 0; ties go by UTF-8 bytes; an empty table gives no rows;
columns besides text, lang and source, whatever their names, are ignored. A very long text is one row of one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.skew import joined_by_share
from weftgraph.session import written

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
DIGIT, DIGITS = 10, 3
SORTED = 128
#: Terms that a task counts before it hands its counts on.
HELD = 300_000
#: Sources in a block, rows of one slice of terms, pairs that are summed at once (their sum stays exact in a double).
SOURCES, SLICE_ROWS, AT_ONCE = 512, 1_000_000, 1 << 20

#: Letters as lower case, bytes beyond ASCII as they are, all else a blank.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
COUNTED = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(most: int):
    """Counts of about most terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], dict[bytes, list[int]]] = {}
        size = 0

        def given() -> pa.RecordBatch:
            rows = [(lang, source, term, n, docs) for (lang, source), own in held.items() for term, (n, docs) in own.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in held]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), COUNTED, strict=True)], schema=COUNTED)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                own = held.setdefault((lang.as_py(), source.as_py()), {})
                before = len(own)
                for term, n in Counter(text.as_py().translate(_LETTERS).split()).items():
                    if found := own.get(term):
                        found[0] += n
                        found[1] += 1
                    else:
                        own[term] = [n, 1]
                size += len(own) - before
                if size > most:
                    yield given()
                    held, size = {}, 0
        if held:
            yield given()

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) for each term of each group, and a row without a term for each group."""
    binary = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*binary).mapInArrow(_counted(HELD), "lang binary, source binary, term binary, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")


def _p(count: Column, total: Column, v: Column) -> Column:
    """1 + SCALE * (count + PRIOR) div (total + PRIOR * v), exact for any counts; 0 where that has no terms."""
    wide = lambda x: x.cast("decimal(20,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR)
    under = wide(total + PRIOR * v)
    return F.when(v > 0, F.call_function("div", over, under) + 1).otherwise(F.lit(0)).cast("long")


def priced(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, int]:
    """(entries, groups, number of entries): lang, source, idx, term, p, q of each kept term that a group has; lang, source, idx, blocks, v and base of each group."""
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(kept, "kept-terms")
    own = written(terms.select("lang", "source", "term", "n").join(kept.hint("merge"), ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_n"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("rows"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = counts.where("term is null").select("lang", "source").withColumn("idx", F.row_number().over(by_source) - 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", "idx", *map(zero, ("group_n", "rows", "v", "lang_n")))
    blocks = F.floor(F.max("idx").over(Window.partitionBy("lang")) / SOURCES).cast("int") + 1
    groups = written(groups.withColumn("base", _p(F.lit(0).cast("long"), F.col("group_n"), F.col("v"))).withColumn("blocks", blocks), "groups")
    total = own.count()
    priced_rows = joined_by_share(own, groups.where("rows > 0"), ["lang", "source"], "rows", total)
    p, q = _p(F.col("n"), F.col("group_n"), F.col("v")), _p(F.col("of_lang"), F.col("lang_n"), F.col("v"))
    return written(priced_rows.select("lang", "source", "idx", "blocks", "term", p.alias("p"), q.alias("q")), "priced"), groups, total


class _Block:
    """Sums for the sources of one block against those of another, over one slice of the terms."""

    def __init__(self, headers: list[dict], sources: int, at_once: int):
        self.sources, self.at_once = sources, at_once
        self.idx = np.array([h["idx"] for h in headers])
        self.base = np.array([h["p"] for h in headers], dtype=np.int64)
        self.names, self.v = [h["source"] for h in headers], headers[0]["v"]
        self.apart = np.abs(self.base[:, None] - self.base[None, :])
        self.sums = np.zeros((len(headers), len(headers)), dtype=np.int64)

    def add(self, term: np.ndarray, idx: np.ndarray, p: np.ndarray) -> None:
        """Entries sorted by term (numbered); all of a term at once."""
        at, base, m = np.searchsorted(self.idx, idx), self.base, len(self.base)
        order = np.lexsort((p, at))
        for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            values, a = p[own], at[own[0]]
            ahead = np.concatenate([[0], np.cumsum(values)])
            below = np.searchsorted(values, base)
            self.sums[a] += base * below - ahead[below] + ahead[-1] - ahead[below] - base * (len(values) - below) - len(values) * self.apart[a]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        many = np.diff(np.append(starts, len(term)))
        ends = np.repeat(starts + many, many)
        later = ends - np.arange(len(term)) - 1  # entries of the same term behind each one
        reach = np.cumsum(later)
        begin = 0
        while begin < len(term):
            end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + self.at_once, side="right")))
            some = later[begin:end]
            left = np.repeat(np.arange(begin, end), some)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some)
            a, b, pa_, pb = at[left], at[right], p[left], p[right]
            x = np.abs(pa_ - pb) - np.abs(pa_ - base[b]) - np.abs(pb - base[a]) + self.apart[a, b]
            self.sums += np.bincount(a * m + b, weights=x, minlength=m * m).astype(np.int64).reshape(m, m)
            begin = end

    def pairs(self, i: int, j: int, first: bool) -> tuple[list[str], list[str], list[int]]:
        """Of each two sources of blocks i and j, the sum over the slice, with that of the baselines in the first slice."""
        total = self.sums + self.sums.T + (self.v * self.apart if first else 0)
        block = self.idx // self.sources
        a, b = np.nonzero((block[:, None] == i) & (block[None, :] == j) & (self.idx[:, None] < self.idx[None, :]))
        some = total[a, b]
        if not first:
            a, b, some = a[some != 0], b[some != 0], some[some != 0]
        return [self.names[k] for k in a], [self.names[k] for k in b], some.tolist()


PAIRED = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _paired(sources: int, at_once: int):
    """Rows sorted by lang, i, j, slice and term; those without a term, first in each slice, say what its sources are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, headers, block, term, number, rows = None, [], None, None, -1, ([], [], [])

        def added() -> None:
            nonlocal block, rows
            block = block or _Block(headers, sources, at_once)
            if rows[0]:
                block.add(*(np.array(x, dtype=np.int64) for x in rows))
                rows = ([], [], [])

        def given() -> pa.RecordBatch:
            added()
            a, b, value = block.pairs(key[1], key[2], key[3] == 0)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], schema=PAIRED)

        for batch in batches:
            for r in batch.to_pylist():
                own = (r["lang"], r["i"], r["j"], r["slice"])
                if own != key:
                    if key is not None:
                        yield given()
                    key, headers, block, term, number = own, [], None, None, -1
                if r["term"] is None:
                    headers.append(r)
                    continue
                if r["term"] != term:
                    term, number = r["term"], number + 1
                    if len(rows[0]) > 1 << 16:
                        added()
                for x, v in zip(rows, (number, r["idx"], r["p"]), strict=True):
                    x.append(v)
        if key is not None:
            yield given()

    return run


def divergences(entries: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """lang, source, item, value for each two sources of a language, either way."""
    slices = max(8, total // SLICE_ROWS)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = F.floor(F.col("idx") / SOURCES).cast("int")
    ends = [F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j")]
    heads = groups.withColumn("other", other).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        "lang", *ends, "slice", F.lit(None).cast("string").alias("term"), "idx", F.col("base").alias("p"), "v", "source"
    )
    body = entries.withColumn("other", other).select(
        "lang", *ends, F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice"), "term", "idx", "p", F.lit(None).cast("long").alias("v"), F.lit(None).cast("string").alias("source")
    )
    dealt = heads.unionByName(body).repartition("lang", "i", "j", "slice").sortWithinPartitions("lang", "i", "j", "slice", "term", "idx")
    pairs = written(dealt.mapInArrow(_paired(SOURCES, AT_ONCE), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    return pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def radix_top(rows: DataFrame, groups: list[str], value: str, item: str, k: int = TOP, most_sorted: int = SORTED) -> DataFrame:
    """The k rows of each group with the largest value, then the least item by UTF-8 bytes, with their rank from 1.

    value is a whole number below 2 ** (DIGIT * DIGITS). rows are read several times. Rows equal in both come in any order.
    """
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    total = rows.count()
    is_open = (F.col("among") > F.greatest("need", F.lit(most_sorted))).alias("open")
    begun = sizes.select(*groups, "n", F.lit(0).cast("long").alias("low"), F.lit("").alias("lead"), F.lit(k).cast("long").alias("need"), F.col("n").alias("among"))
    state = written(begun.select("*", is_open), "radix")

    def narrowed(digit: Column, inside: Column, order: list[Column], low: Column, lead: Column, goes_on: Column) -> DataFrame:
        """state after one histogram: its open groups go on with the digit that holds their k-th row."""
        within = joined_by_share(rows, state.where("open"), groups, "n", total).where(inside)
        counted = within.groupBy(*groups, digit.alias("digit")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        chosen = counted.withColumn("upto", upto).join(state.where("open"), groups).where("upto >= need and upto - c < need")
        after = chosen.select(*groups, "n", low.alias("low"), lead.alias("lead"), (F.col("need") - F.col("upto") + F.col("c")).alias("need"), F.col("c").alias("among"), goes_on.alias("more"))
        return written(state.where("not open").unionByName(after.select("*", (is_open & F.col("more")).alias("open")).drop("more")), "radix")

    v, text = F.col(value), F.col(item).cast("binary")
    for at in range(DIGITS - 1, -1, -1):
        if state.where("open").isEmpty():
            break
        shift = at * DIGIT
        inside = (v >= F.col("low")) & (F.shiftright(v - F.col("low"), shift + DIGIT) == 0)
        digit = F.shiftright(v - F.col("low"), shift)
        state = narrowed(digit, inside, [F.col("digit").desc()], F.col("low") + F.shiftleft(F.col("digit"), shift), F.col("lead"), F.lit(True))
    else:
        at, wide = 0, 2
        while not state.where("open").isEmpty():
            inside = (v == F.col("low")) & (F.hex(F.substring(text, 1, at)) == F.col("lead"))
            digit = F.hex(F.substring(text, at + 1, wide))
            state = narrowed(digit, inside, [F.col("digit")], F.col("low"), F.concat("lead", "digit"), F.col("digit") != "")
            at, wide = at + wide, wide * 2
    found = joined_by_share(rows, state, groups, "n", total)
    lead = F.hex(F.substring(text, F.lit(1), (F.length("lead") / 2).cast("int")))
    found = found.where((v > F.col("low")) | (v == F.col("low")) & (lead <= F.col("lead"))).select(*rows.columns)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(v.desc(), F.col(item)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the language, part `term` the top own terms."""
    entries, groups, total = priced(written(term_counts(docs), "term-counts"), least_docs)
    pairs = divergences(entries, groups, total)
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    own = written(entries.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "own-terms")
    terms = radix_top(own, ["lang", "source"], "value", "item", top).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(terms.select(*columns))
