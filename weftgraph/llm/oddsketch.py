"""Near duplicates by MinHash, with odd sketches to verify banded candidates and the full sets to confirm them.

A text's set holds the 64-bit hashes of its runs of SHINGLE words (ASCII letters in lower case, between ASCII blanks); a text with fewer
words has one shingle of all of them. Texts with equal sets are copies and are compared as one set. BANDS * ROWS MinHash samples
of a set give two things: a key for each band of ROWS samples, under which candidates meet, and an odd sketch (Mitzenmacher, Pagh and
Pham 2014), a bitmap of BITS in which each sample flips the bit that it hashes to. Two sketches differ in about BITS / 2 *
(1 - exp(-4 * K * (1 - similarity) / BITS)) bits, so a population count of their XOR estimates high similarities closely; pairs that differ in
more than CUT bits are left, which a pair right at LEAST does with a chance of MISS. The bands miss such a pair with (1 - LEAST **
ROWS) ** BANDS, 0.0005.

Links are wanted for their components only, so a group of n copies isn't compared pair by pair:

1. In each bucket the least set leads, and all others are candidates with it. A set's first leader by id is confirmed on the full sets,
   in groups of about LED sets with one leader. Confirmed links make components.
2. In a bucket that still holds more than one component, sets are compared across components: those outside the bucket's largest
   component with each other, and with the sets of that. Near copies share most of their buckets, so a set is compared with all of a
   largest component at once where that is no more than WIDER times its sets in the buckets that both share, and else bucket by bucket,
   each pair in its first shared bucket; those outside are compared with each other likewise. What the sketches let through is confirmed on the full sets in the task.

Work is dealt by bucket, block and leader's group; leaders and buckets that are hot are joined by share. Blocks grow with what is compared:
a set's row is made SIDES times at most, until blocks have MOST sets.

Defined results: a text without a word (null, empty, blank) has no shingles, no links, and is its own component; repeated rows are copies,
each with a row of its own; the component of rows without an id is that of the least id in it, null if there is none, and such rows are kept
if they have no id to go to; exactly LEAST is a link; an empty table gives no rows; a very long text's set takes 8 bytes a word in its task;
columns besides doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.jaccard import _lists, _mixed, set_digest
from weftgraph.operators.components import connected_components
from weftgraph.operators.skew import joined_by_share
from weftgraph.session import written

SHINGLE = 2
LEAST = 80  # in hundredths
BANDS, ROWS = 32, 7
K = BANDS * ROWS
BITS = 512
MISS = 1e-5
#: Sets of a leader's group, and of a block at least.
LED, GROUP = 64, 256
#: Blocks of what is compared while they have no more than MOST sets.
SIDES, MOST = 16, 4096
#: So many more sketches are compared where that saves the rows of a bucket: a row costs as much as a thousand of them.
WIDER = 8
CACHE_WORDS = 500_000


def sketch_cut(least: float = LEAST / 100, samples: int = K, bits: int = BITS, miss: float = MISS) -> int:
    """The least number of bits that sketches of sets of similarity least exceed with no more than the chance miss.

    How many samples differ is binomial, and each that does flips two bits; the number of odd bits after m flips is a walk.
    """
    chances = np.zeros(2 * samples + 1)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, samples + 1)))])
    for d in range(samples + 1):
        chances[2 * d] = np.exp(log[samples] - log[d] - log[samples - d] + d * np.log(1 - least) + (samples - d) * np.log(least))
    odd, total, up = np.eye(1, bits + 1)[0], np.zeros(bits + 1), 1 - np.arange(bits + 1) / bits
    for chance in chances:
        total += chance * odd
        step = np.zeros(bits + 1)
        step[1:] += (odd * up)[:-1]
        step[:-1] += (odd * (1 - up))[1:]
        odd = step
    return int(np.flatnonzero(np.cumsum(total[::-1])[::-1] > miss)[-1])


CUT = sketch_cut()
_ODD = np.random.default_rng(13).integers(0, 1 << 63, size=K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(14).integers(0, 1 << 63, size=K, dtype=np.uint64) * np.uint64(2)


class Shingles:
    """Sorted distinct hashes of the shingles of one text after the other."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: ASCII letters and blanks alone
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(SHINGLE, len(h))
        acc = h[: len(h) - n + 1]
        for k in range(1, n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        return np.unique(_mixed(acc))


def samples(tokens: np.ndarray) -> np.ndarray:
    """The least of the tokens under each of K hash functions."""
    least = np.full(K, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(tokens), 1024):
        least = np.minimum(least, (tokens[None, at : at + 1024] * _ODD[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of samples; bands have keys of their own."""
    key = _SALT[:BANDS]
    for sample in least.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ sample) + _ODD[:BANDS]
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Each sample flips the bit that it hashes to: BITS bits as 64-bit numbers."""
    bits = np.bincount((_mixed(least ^ _SALT) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


DOCUMENTS = "doc_id long, row long, set_id binary, size long, sketch array<long>, keys array<long>"


def _rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text as bytes) with a hash, row, that with the id names a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, row, set_id, size, sketch, keys of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, nothing = Shingles(), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, sizes, sketches, keys = [], [], [], []
                for row, text in zip(part.column("row").to_pylist(), part.column("text"), strict=True):
                    tokens = shingles(text.as_py())
                    least = samples(tokens) if len(tokens) else None
                    ids.append(set_digest(tokens, row))
                    sizes.append(len(tokens))
                    sketches.append(nothing if least is None else odd_sketch(least))
                    keys.append(nothing if least is None else band_keys(least))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), _lists(sketches, np.int64, pa.int64()), _lists(keys, np.int64, pa.int64())],
                    names=["doc_id", "row", "set_id", "size", "sketch", "keys"],
                )

    return written(_rows(docs).mapInArrow(run, DOCUMENTS), "sketched")


def _differ(a: str, b: str) -> Column:
    """The number of bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _like_sizes(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * LEAST


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LEAST * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (set_id, leader) whose full sets are similar enough. About LED sets of one leader make a group, which has the leader's text once."""
    led = pairs.groupBy("leader").agg(F.count("*").alias("of"))
    dealt = joined_by_share(pairs, led, "leader", "of", pairs.count())
    part = F.pmod(F.xxhash64("set_id"), F.ceil(F.col("of") / LED)).cast("int")
    dealt = written(dealt.select("leader", part.alias("part"), "set_id"), "led")
    heads = dealt.select("leader", "part").distinct().select("leader", "part", F.col("leader").alias("set_id"), F.lit(0).alias("side"))
    rows = dealt.withColumn("side", F.lit(1)).unionByName(heads).join(texts, "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, leader, own, found = Shingles(), None, None, []
        for batch in batches:
            for head, side, set_id, text in zip(*(batch.column(c) for c in ("leader", "side", "set_id", "text")), strict=True):
                tokens = shingles(text.as_py())
                if side.as_py() == 0:
                    leader, own = head.as_py(), tokens
                elif _linked(tokens, own):
                    found.append({"a": set_id.as_py(), "b": leader})
            if found:
                yield pa.RecordBatch.from_pylist(found)
                found = []

    return written(rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "side").mapInArrow(run, "a binary, b binary"), "confirmed")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one group after the other; the rows of a group follow each other."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, group in groupby(rows, key=lambda r: tuple(r[c] for c in GROUPED)):
        held = list(group)
        if len(held) > 1:
            yield held


def _across(rows: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of a group those after it, nearest first, that are still to be confirmed with it: of another component, alike by their sketches, and not met in an earlier bucket."""
    sketches = np.array([r["sketch"] for r in rows], dtype=np.int64).view(np.uint64)
    size, side = np.array([r["size"] for r in rows]), np.array([r["side"] for r in rows])
    label = np.unique([r["label"] for r in rows], return_inverse=True)[1]
    between, key = rows[0]["i"] != rows[0]["j"], rows[0]["key"]
    keys = None if rows[0]["kind"] in (WHOLE, AROUND) else np.array([r["keys"] for r in rows])
    for k in range(len(rows) - 1):
        may = (label[k + 1 :] != label[k]) & (100 * np.minimum(size[k + 1 :], size[k]) >= LEAST * np.maximum(size[k + 1 :], size[k]))
        if between:
            may &= side[k + 1 :] != side[k]
        other = np.flatnonzero(may) + k + 1
        if not len(other):
            continue
        differ = np.bitwise_count(sketches[other] ^ sketches[k]).sum(axis=1, dtype=np.int64)
        near = other[np.argsort(differ, kind="stable")[: np.count_nonzero(differ <= CUT)]]
        if keys is not None and len(near):
            near = near[keys[k][(keys[near] == keys[k]).argmax(axis=1)] == key]
        if len(near):
            yield k, near


#: What a group compares: sets with all of a component, sets with those of a bucket's largest component; the other sets of all buckets
#: with that largest component with each other, those of one bucket.
WHOLE, BUCKET, AROUND, OUTSIDE = range(4)
GROUPED = ("kind", "key", "head", "i", "j")
DEALT = (*GROUPED, "side", "label", "set_id", "size", "sketch", "keys")
_NUMBERS = pa.list_(pa.int64())
_TYPES = {"key": pa.int64(), "size": pa.int64(), "sketch": _NUMBERS, "keys": _NUMBERS} | dict.fromkeys(("kind", "i", "j", "side"), pa.int32())
_CHOSEN = pa.schema([(c, _TYPES.get(c, pa.binary())) for c in DEALT])
CHOSEN = "kind int, key long, head binary, i int, j int, side int, label binary, set_id binary, size long, sketch array<long>, keys array<long>"


def _blocks(n: str) -> Column:
    """Into how many blocks n sets are cut."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / F.greatest(F.lit(GROUP), F.least(F.col(n) / SIDES, F.lit(MOST))))).cast("int")


def _compared(shared: DataFrame, named: DataFrame) -> DataFrame | None:
    """The sets of each group to compare: kind, key, head, set_id, label, outer, and how many of the group's sets are outer or not; None if there are none."""
    members = written(shared.select("key", "set_id").join(named, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "members")
    by_label = members.groupBy("key", "label").agg(F.count("*").alias("c"))
    keys = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top")).where("labels > 1")
    keys = written(keys.select("key", "n", "labels", F.col("top.label").alias("top"), F.col("top.c").alias("of_top")), "mixed")
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return None
    mixed = written(joined_by_share(members, keys, "key", "n", total), "in-mixed")
    outside = mixed.where("label <> top")

    # each set with the largest components of its buckets: the component's sets in the buckets that both share, and the others there
    beside = F.sum(F.when(F.col("labels") > 2, F.col("n") - F.col("of_top")).otherwise(F.lit(0)))
    met = written(outside.groupBy("set_id", "label", "top").agg(F.sum("of_top").alias("within"), beside.alias("beside")), "met")
    sizes = named.groupBy(F.col("label").alias("top")).agg(F.count("*").alias("n_many"))
    tops = met.groupBy("top").agg(F.count("*").alias("n_met"), F.count_if(F.col("beside") > 0).alias("n_once"), F.sum("beside").alias("pairs")).join(sizes, "top", "left")
    once = F.pow("n_once", F.lit(2)) <= WIDER * F.col("pairs")
    tops = written(tops.select("top", "n_met", F.coalesce("n_many", F.lit(1)).alias("n_many"), once.alias("once")), "tops")
    met = joined_by_share(met, tops, "top", "n_met", met.count()).withColumn("whole", F.col("n_many") <= WIDER * F.col("within"))
    met = written(met, "met-tops")

    def group(rows: DataFrame, kind: int, key: str | Column, n_many: str | Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), (F.col(key) if isinstance(key, str) else key).alias("key"), F.col("top").alias("head"), "set_id", "label", (F.col(n_many) if isinstance(n_many, str) else n_many).cast("long").alias("n_many"))

    none = F.lit(0).cast("long")
    outer = group(met.where("whole"), WHOLE, none, "n_many").unionByName(group(met.where("once and beside > 0"), AROUND, none, none))
    split = met.where("not whole or (not once and beside > 0)").select("set_id", "top", "whole", "once")
    by_bucket = not split.isEmpty()
    if by_bucket:
        split = outside.join(split, ["set_id", "top"])
        outer = outer.unionByName(group(split.where("not whole"), BUCKET, "key", "of_top")).unionByName(group(split.where("not once and labels > 2"), OUTSIDE, "key", none))
    outer = written(outer, "outer")
    name = ["kind", "key", "head"]
    groups = written(outer.groupBy(*name).agg(F.count("*").alias("n_outer"), F.first("n_many").alias("n_many")), "groups")
    n_outer, n_many = groups.agg(F.sum("n_outer"), F.sum("n_many")).first()
    own = named.select(F.lit(WHOLE).alias("kind"), none.alias("key"), F.col("label").alias("head"), "set_id", "label")
    if by_bucket:
        own = own.unionByName(mixed.where("label = top").select(F.lit(BUCKET).alias("kind"), "key", F.col("top").alias("head"), "set_id", "label"))
    own = joined_by_share(own, groups.where(F.col("kind").isin(WHOLE, BUCKET)), name, "n_many", n_many)
    # a component of one set has no label in named
    alone = groups.where((F.col("kind") == WHOLE) & (F.col("n_many") == 1)).withColumn("set_id", F.col("head")).withColumn("label", F.col("head"))
    own = own.unionByName(alone).withColumn("outer", F.lit(False))
    return joined_by_share(outer.drop("n_many"), groups, name, "n_outer", n_outer).withColumn("outer", F.lit(True)).unionByName(own)


def _rest(shared: DataFrame, labels: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join components within buckets: of each group as many as join what it can join."""
    named = labels.select(F.col("node").alias("set_id"), F.col("component").alias("label"))  # a set is in a bucket of each band at most
    rows = _compared(shared, named)
    if rows is None:
        return named.where("false").select(F.col("set_id").alias("a"), F.col("label").alias("b"))
    outer, many, spread = _blocks("n_outer"), _blocks("n_many"), F.xxhash64("set_id")
    across = F.col("outer") & F.col("kind").isin(WHOLE, BUCKET)
    side = F.when(F.col("outer"), F.pmod(spread, outer)).otherwise(outer + F.pmod(spread, many)).cast("int")
    opposite = F.sequence(F.when(across, outer).otherwise(F.lit(0)), F.when(across, outer + many - 1).otherwise(outer - 1))
    rows = rows.withColumn("side", side).withColumn("with", F.explode(opposite))
    rows = rows.withColumn("i", F.least("side", "with")).withColumn("j", F.greatest("side", "with"))
    rows = rows.select(*GROUPED, "side", "label", "set_id").join(sets.select("set_id", "size", "sketch", "keys"), "set_id")
    rows = rows.withColumn("keys", F.when(F.col("kind").isin(BUCKET, OUTSIDE), F.col("keys"))).select(*DEALT)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            wanted = set()
            for k, near in _across(group):
                wanted.add(k)
                wanted.update(near.tolist())
            if wanted := sorted(wanted):
                yield pa.RecordBatch.from_pylist([group[k] for k in wanted], _CHOSEN)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for group in _groups(batches):
            tokens: dict[int, np.ndarray] = {}
            joined: dict[bytes, bytes] = {}  # labels that this group has joined
            found = []

            def head(label: bytes, joined: dict[bytes, bytes] = joined) -> bytes:
                while label in joined:
                    label = joined[label]
                return label

            for k, near in _across(group):
                for m in near.tolist():
                    x, y = head(group[k]["label"]), head(group[m]["label"])
                    if x == y:
                        continue
                    for n in (k, m):
                        if n not in tokens:
                            tokens[n] = shingles(group[n]["text"])
                    if _linked(tokens[k], tokens[m]):
                        joined[y] = x
                        found.append({"a": group[k]["set_id"], "b": group[m]["set_id"]})
            if found:
                yield pa.RecordBatch.from_pylist(found)

    grouped = lambda df: df.repartition(*GROUPED).sortWithinPartitions(*GROUPED, "side")
    chosen = written(grouped(rows).mapInArrow(choose, CHOSEN), "across")
    if chosen.isEmpty():
        return chosen.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))
    return written(grouped(chosen.join(texts, "set_id")).mapInArrow(link, "a binary, b binary"), "rest")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept for each row of docs."""
    rows = sketched(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    sets = rows.groupBy("set_id").agg(first, F.count("*").alias("copies"), F.first(F.struct("size", "sketch", "keys")).alias("body"))
    sets = written(sets.select("set_id", "first", "copies", "body.*"), "distinct-sets")
    many = sets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    pairs = written(sets.where("size > 0").select("set_id", F.explode("keys").alias("key")), "band-keys")
    leaders = written(pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("set_id").alias("leader")).where("n > 1"), "leaders")
    total = leaders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = written(joined_by_share(pairs, leaders, "key", "n", total).select("key", "set_id", "leader", "n"), "shared")
    stars = written(shared.where("set_id <> leader").select("set_id", "leader").distinct(), "stars")

    named = sets.select("set_id", "copies", F.col("first.row").alias("row"), F.coalesce("first.doc_id", F.lit(-1)).alias("id"))
    wanted = written(shared.select("set_id").distinct().join(named, "set_id"), "wanted")
    texts = joined_by_share(_rows(docs).withColumn("id", F.coalesce("doc_id", F.lit(-1))), wanted, ["row", "id"], "copies", many)
    texts = written(texts.select("set_id", "text").dropDuplicates(["set_id"]), "texts")

    body = sets.select("set_id", "size", "sketch")
    heads = stars.groupBy("leader").agg(F.count("*").alias("of")).join(body.select(F.col("set_id").alias("leader"), F.col("size").alias("lead_size"), F.col("sketch").alias("lead_sketch")), "leader")
    stars = joined_by_share(stars, heads, "leader", "of", stars.count()).join(body, "set_id")
    stars = stars.where(_like_sizes("size", "lead_size")).where(_differ("sketch", "lead_sketch") <= CUT)
    stars = written(stars.select("set_id", "leader"), "candidates")

    best = stars.groupBy("set_id").agg(F.min("leader").alias("leader"))
    links = _confirmed(best, texts)
    labels = written(connected_components(links), "labels")
    more = _rest(shared, labels, sets, texts)
    if not more.isEmpty():
        labels = written(connected_components(links.unionByName(more)), "labels")

    found = sets.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select(
        "set_id", F.coalesce("component", "set_id").alias("component"), "first", "copies", "size"
    )
    found = written(found, "classes")
    heads = written(found.groupBy("component").agg(F.min("first.doc_id").alias("component_id"), F.count("*").alias("n")), "heads")
    verdict = joined_by_share(found, heads, "component", "n", many).select("set_id", "component_id", "copies")
    out = joined_by_share(rows.select("doc_id", "set_id", "size"), written(verdict, "verdict"), "set_id", "copies", many)
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
