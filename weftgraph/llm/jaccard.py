"""Similarity join of texts on word shingles by Jaccard similarity, with Chosen Path recursion.

A text's set holds the 64-bit hashes of its runs of SHINGLE words (lower case, between blanks); a text with fewer words has one
shingle of all of them. Texts with equal sets are copies: they are compared once, as one set. Two sets are linked if their
Jaccard similarity is LEAST or more.

A run of the recursion splits the sets on sampled tokens that they share: at each node of the path tree a set of t tokens
follows those whose hash lies in the node's own window of a share SPREAD / t of all hashes, so similar sets tend to follow the
same ones (Christiani and Pagh 2017). Only sets that meet in a bucket of more than SMALL go one level deeper, DEPTH at most
and while that separates them; what is then still together, near copies in the main, is cut in blocks of about BLOCK sets, and every pair of blocks is
compared in a task of its own. RUNS repeats give the target recall RECALL for a pair right at LEAST whose path always goes to
full depth (others have more).

A bucket's sets are first compared by sketches of 64 bytes of min-hashes: pairs that agree in fewer than SKETCH_LEAST can't
be linked but by a chance of 1 in 10,000. Sets that have such a pair left are compared exactly, on all their tokens. A pair
counts only in the first bucket by key that both are in, so links are counted once without ever being listed: a bucket
returns each set's number of links and edges that span what it linked.

Work is spread by bucket and block: all groups in a task are small, whatever a third of the rows may share.

Defined results: a text without a word (null, empty, blank) has no links and is alone in its class; repeated rows are copies,
of which the filter keeps one; an empty table gives no rows; the class of texts without an id is that of the least id in it, null
if there is none; a similarity of exactly LEAST is a link; a very long text's set takes 8 bytes a word in its task; columns besides
doc_id and text, whatever their names, are ignored by the join and kept by the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.worker import lean
from weftgraph.operators.components import connected_components
from weftgraph.operators.skew import joined_by_share
from weftgraph.session import written

SHINGLE = 5
LEAST = 0.8
RECALL = 0.995
SPREAD = 2.0
DEPTH = 3
SMALL = 64
BLOCK = 256
#: A bucket with this share of its parent's sets or more is one that splitting doesn't reduce: near copies, compared in blocks.
STUCK = 0.75
SKETCH = 64
SKETCH_LEAST = 38
#: Words whose hashes a worker keeps.
CACHE_WORDS = 1 << 16
#: Rows that a worker reads, and about as many that it writes, at once.
ROWS_AT_ONCE = 1024


def runs_needed(least: float = LEAST, spread: float = SPREAD, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Repeats until a pair at least shares a full path with chance recall. Of the larger set's tokens a share least or more is in both."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(-spread * least * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


RUNS = runs_needed()
_ODD = np.random.default_rng(7).integers(0, 1 << 63, size=SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST = np.random.default_rng(8).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.known = shingle, {}

    def tokens(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.shingle, len(h))
        acc = h[: len(h) - n + 1]
        for k in range(1, n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        return np.unique(_mixed(acc))


def set_digest(tokens: np.ndarray, row: int) -> bytes:
    """Names a set; one without tokens is named by its row."""
    return xxhash.xxh128_digest(tokens.tobytes() if len(tokens) else b"row" + row.to_bytes(8, "little", signed=True))


def sketch(tokens: np.ndarray) -> bytes:
    """The top byte of the least of the tokens under each of SKETCH hash functions."""
    least = np.full(SKETCH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(tokens), 4096):
        least = np.minimum(least, (tokens[None, at : at + 4096] * _ODD[:, None]).min(axis=1))
    return (_mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def chosen_paths(tokens: np.ndarray, runs: int, spread: float = SPREAD, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level: keys of the set's nodes in the path trees of all runs, and the place of each one's parent in the level above."""
    width = np.uint64(min(int(spread / max(1, len(tokens)) * 2**64), 2**64 - 1))
    nodes, out = _FIRST[:runs], []
    for level in range(depth):
        start = _mixed(nodes ^ np.uint64(0x5851F42D4C957F2D))
        end = start + width
        low, high = np.searchsorted(tokens, start), np.searchsorted(tokens, end)
        wraps = end < start
        many = np.where(wraps, len(tokens) - low + high, high - low)
        parent = np.repeat(np.arange(len(nodes)), many)
        step = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
        token = tokens[(low[parent] + step) % max(1, len(tokens))] if len(parent) else tokens[:0]
        nodes = _mixed(nodes[parent] * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(level))
        out.append((nodes, parent))
    return out


SETS = "doc_id long, row long, set_id binary, size int, sketch binary, key1 array<long>, key2 array<long>, up2 array<int>, key3 array<long>, up3 array<int>"
BODY = ("size", "sketch", "key1", "key2", "up2", "key3", "up3")


def _lists(parts: list[np.ndarray], dtype, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, dtype=np.int64)]).astype(dtype), kind))


def _rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a hash, row, that with the id names a row."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.withColumn("row", F.xxhash64("doc_id", "text"))


def _sets(docs: DataFrame, runs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids, sizes, sketches, levels = [], [], [], [[] for _ in range(DEPTH)]
                for row, text in zip(part.column("row").to_pylist(), part.column("text"), strict=True):
                    tokens = shingler.tokens(text.as_py())
                    ids.append(set_digest(tokens, row))
                    sizes.append(len(tokens))
                    sketches.append(sketch(tokens) if len(tokens) else b"")
                    for own, found in zip(levels, chosen_paths(tokens, runs), strict=True):
                        own.append(found)
                keys = [_lists([k.view(np.int64) for k, _ in own], np.int64, pa.int64()) for own in levels]
                ups = [_lists([u for _, u in own], np.int32, pa.int32()) for own in levels]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), keys[0], keys[1], ups[1], keys[2], ups[2]],
                    names=["doc_id", "row", "set_id", "size", "sketch", "key1", "key2", "up2", "key3", "up3"],
                )

    return written(_rows(docs).mapInArrow(lean(run), SETS), "sets")


def _shared(pairs: DataFrame) -> DataFrame:
    """pairs (set_id, key, parent_n) of keys that two or more sets have, with their number n."""
    pairs = written(pairs, "pairs")
    many = written(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "many")
    total = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return written(joined_by_share(pairs, many, "key", "n", total).select("key", "set_id", "n", "parent_n"), "shared")


def _buckets(sets: DataFrame) -> DataFrame:
    """(key, set_id, n): the buckets in which sets (each once) are compared. A bucket is split on while it is large and splitting helps."""
    shared = _shared(sets.select("set_id", F.explode(F.array_distinct("key1")).alias("key"), F.lit(None).cast("long").alias("parent_n")))
    large = (F.col("n") > SMALL) & F.coalesce(F.col("n") < STUCK * F.col("parent_n"), F.lit(True))
    leaves = shared.where(~large)
    for level in range(2, DEPTH + 1):
        # a set's large buckets are few: its steps from others go before any row is made of them
        hot = shared.where(large).groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("hot"))
        step = F.zip_with(f"key{level}", f"up{level}", lambda key, up: F.struct(key.alias("key"), F.try_element_at("hot", F.element_at(f"key{level - 1}", up + 1)).alias("parent_n")))  # noqa: B023
        steps = F.array_distinct(F.filter(step, lambda s: s["parent_n"].isNotNull()))
        found = sets.select("set_id", f"key{level - 1}", f"key{level}", f"up{level}").join(hot, "set_id").select("set_id", F.explode(steps).alias("s"))
        shared = _shared(found.select("set_id", F.col("s.key").alias("key"), F.col("s.parent_n").alias("parent_n")))
        leaves = leaves.union(shared.where(~large) if level < DEPTH else shared)
    return leaves.select("key", "set_id", "n")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (key, i, j) after the other; the rows of a group follow each other."""
    group, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            for row in batch.slice(at, ROWS_AT_ONCE).to_pylist():
                own = (row["key"], row["i"], row["j"])
                if own != group:
                    if len(held) > 1:
                        yield held
                    group, held = own, []
                held.append(row)
    if len(held) > 1:
        yield held


def _incidence(lists: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Blocks of columns of the 0-1 matrix of lists by the values that two or more of them hold."""
    flat = np.concatenate(lists)
    line = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1
    keep = many[column] > 1
    line, column = line[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    line, column = line[order], column[order]
    wide = 4096
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, wide):
        low, high = np.searchsorted(column, (at, at + wide))
        if high > low:
            block = np.zeros((len(lists), min(wide, int(column[high - 1]) - at + 1)), dtype=np.float32)
            block[line[low:high], column[low:high] - at] = 1
            yield block


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the lists of distinct values share."""
    out = np.zeros((len(lists), len(lists)), dtype=np.float32)
    for block in _incidence(lists):
        out += block @ block.T
    return out


def _comparable(rows: list[dict]) -> np.ndarray:
    """Which pairs of a group count here: not yet in an earlier bucket, of blocks that this group is for, and of like size."""
    key, size, side = rows[0]["key"], np.array([r["size"] for r in rows]), np.array([r["side"] for r in rows])
    may = np.minimum(size[:, None], size[None, :]) >= LEAST * np.maximum(size[:, None], size[None, :]) - 1e-9
    if rows[0]["i"] != rows[0]["j"]:
        may &= side[:, None] != side[None, :]
    earlier = [np.array([k for k in r["keys"] if k < key], dtype=np.int64) for r in rows]
    may &= _common(earlier) == 0
    np.fill_diagonal(may, False)
    return may


def _sketched(rows: list[dict]) -> list[dict]:
    """The rows of a group that have a pair worth comparing."""
    if len(rows) == 2:
        a, b = rows
        if min(a["size"], b["size"]) < LEAST * max(a["size"], b["size"]) - 1e-9 or a["i"] != a["j"] and a["side"] == b["side"]:
            return []
        if min(set(a["keys"]).intersection(b["keys"])) != a["key"] or sum(x == y for x, y in zip(a["sketch"], b["sketch"], strict=True)) < SKETCH_LEAST:
            return []
        return rows
    marks = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype=np.uint8).reshape(len(rows), SKETCH)
    like = np.stack([(marks == m).sum(axis=1) >= SKETCH_LEAST for m in marks])
    np.fill_diagonal(like, False)
    if like.any():
        like &= _comparable(rows)
    return [r for r, some in zip(rows, like.any(axis=1), strict=True) if some]


def _linked(rows: list[dict]) -> Iterator[tuple[bytes, bytes | None, int, int]]:
    """(set, another that it is joined to or None, its links in sets, in documents) of a group's exact links."""
    size = np.array([r["size"] for r in rows], dtype=np.float64)
    both = _common([np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows]).astype(np.float64)
    links = (both >= LEAST * (size[:, None] + size[None, :] - both) - 1e-6) & _comparable(rows)
    copies = np.array([r["copies"] for r in rows], dtype=np.int64)
    of_sets, of_docs = links.sum(axis=1), links @ copies
    root = np.full(len(rows), -1)
    for start in np.flatnonzero(of_sets):
        if root[start] < 0:
            root[start], todo = start, [start]
            while todo:
                new = np.flatnonzero(links[todo.pop()] & (root < 0))
                root[new] = start
                todo.extend(new.tolist())
    for k in np.flatnonzero(of_sets):
        yield rows[k]["set_id"], rows[root[k]]["set_id"] if root[k] != k else None, int(of_sets[k]), int(of_docs[k])


def _grouped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("key", "i", "j", "side", "set_id", "size", "keys", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


CHOSEN = "key long, i int, j int, side int, set_id binary, size int, keys array<long>"
LINKS = "set_id binary, other binary, n_sets long, n_docs long"


def join_sets(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame, int]:
    """(documents, sets, number of documents). documents: doc_id, row and set_id for each row of docs. sets: for each set_id its class (the least set_id
    linked to it, over any number of links), doc_id and row of its first document, copies, and the number of links, n_sets and n_docs."""
    rows = _sets(docs, runs_needed(recall=recall))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    bodies = rows.groupBy("set_id").agg(first, F.count("*").alias("copies"), F.first(F.struct(*BODY)).alias("body"))
    sets = written(bodies.select("set_id", "first", "copies", "body.*"), "distinct-sets")
    many = sets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    leaves = written(_buckets(sets.where("size > 0")), "buckets")
    members = leaves.groupBy("set_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    marks = sets.select("set_id", "size", "sketch").join(members, "set_id")
    parts = leaves.join(marks, "set_id")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    parts = parts.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    parts = parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.withColumn("i", F.least("side", "with")).withColumn("j", F.greatest("side", "with"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("set_id", pa.binary()), ("size", pa.int32()), ("keys", pa.list_(pa.int64()))])
        out: list[dict] = []
        for group in _groups(batches):
            out += [{k: r[k] for k in schema.names} for r in _sketched(group)]
            if len(out) > ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    chosen = written(_grouped(parts, ["sketch"]).mapInArrow(lean(choose), CHOSEN), "chosen")
    named = sets.select("set_id", "copies", F.col("first.row").alias("row"), F.coalesce("first.doc_id", F.lit(-1)).alias("id"))
    wanted = written(chosen.select("set_id").distinct().join(named, "set_id"), "wanted")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                tokens = [shingler.tokens(t.as_py()).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("set_id"), part.column("copies"), pa.array(tokens, pa.binary())], names=["set_id", "copies", "tokens"])

    texts = joined_by_share(_rows(docs).withColumn("id", F.coalesce("doc_id", F.lit(-1))), wanted, ["row", "id"], "copies", many)
    tokens = texts.select("set_id", "copies", "text").dropDuplicates(["set_id"]).mapInArrow(lean(tokenise), "set_id binary, copies long, tokens binary")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("set_id", pa.binary()), ("other", pa.binary()), ("n_sets", pa.int64()), ("n_docs", pa.int64())])
        for group in _groups(batches):
            if found := list(_linked(group)):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema)

    links = written(_grouped(chosen.join(tokens, "set_id"), ["copies", "tokens"]).mapInArrow(lean(link), LINKS), "links")
    classes = connected_components(links.where("other is not null"), "set_id", "other").select(F.col("node").alias("set_id"), F.col("component").alias("class"))
    numbers = links.groupBy("set_id").agg(F.sum("n_sets").alias("n_sets"), F.sum("n_docs").alias("n_docs"))
    found = sets.select("set_id", "first", "copies").join(numbers, "set_id", "left").join(classes, "set_id", "left").select(
        "set_id", F.coalesce("class", "set_id").alias("class"), "first", "copies",
        F.coalesce("n_sets", F.lit(0).cast("long")).alias("n_sets"), F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"),
    )
    return rows.select("doc_id", "row", "set_id"), written(found, "classes"), many


def similar_documents(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_links (other documents at or above LEAST) for each row of docs."""
    documents, sets, many = join_sets(docs, recall)
    heads = written(sets.groupBy("class").agg(F.min("first.doc_id").alias("class_id"), F.count("*").alias("n")), "heads")
    verdict = joined_by_share(sets, heads, "class", "n", many)
    verdict = written(verdict.select("set_id", "class_id", "copies", (F.col("n_docs") + F.col("copies") - 1).alias("n_links")), "verdict")
    return joined_by_share(documents, verdict, "set_id", "copies", many).select("doc_id", "class_id", "n_links")


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    """names, made longer until docs has no such column."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in have:
            name += "_"
        out.append(name)
    return out


def first_of_each_class(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of docs, with all their columns, but for each class only that of its least doc_id (and of equal rows only one)."""
    row, own, copies = _free_names(docs, "row", "own", "copies")
    _, sets, many = join_sets(docs, recall)
    kept = written(sets.groupBy("class").agg(F.min(F.struct("first", "copies")).alias("head")).select(
        F.col("head.first.row").alias(row), F.coalesce("head.first.doc_id", F.lit(-1)).alias(own), F.col("head.copies").alias(copies)
    ), "kept")
    marked = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    return joined_by_share(marked, kept, [row, own], copies, many).dropDuplicates([row, own]).select(*[f"`{c}`" for c in docs.columns])
