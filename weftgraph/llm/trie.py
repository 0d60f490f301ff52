"""Prefix trie of conversations: a node for each distinct sequence of first turns, with what sharing that prefix saves.

A turn is named by 128 bits of the SHA-256 of its role and text, a conversation by the array of its turns' names, so arrays that
begin alike are neighbours in their order. The arrays are range-sorted over the cluster, with the conversation's id last. Each
partition is swept once: the longest common prefix with the row before tells which open nodes end there; they are popped off a
stack, folded into their parents and given out. What is open at a partition's ends, a stack on its left and one on its right, is
stitched with its neighbours' stacks, FAN partitions in one group and in as many rounds as that takes, so no task gets more
than FAN times two stacks.

A node's own conversations are hashed in order of their ids. Of a node that a partition doesn't hold whole their ids travel as packed
runs, which one task streams through the hash: the digest of one string can't be made in parts. A child whose parent isn't done
when its partition ends, or which is beyond HELD children of that parent, gets its parent's id by a join.

Rebuilding: conversation c begins with the first h turns of conversation c - c % BLOCK, h = crc32(c in decimal) % HEADS, in place of
its own first h.

Defined results: a null role or text is an empty one; a null turn comes first; equal turn numbers go by role, then text; repeated rows
are a turn each; rows without a conv_id are left out; a conversation that has no turn left counts for the root; no conversations
give no rows; columns besides conv_id, turn, role and text, whatever their names, are ignored. All turns of one conversation are
one row of one task, at 16 bytes a turn once they are named.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import joined_by_share
from weftgraph.session import written

BLOCK, HEADS = 20, 4
NAME = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Segments that are stitched in one group.
FAN = 64
#: Finished children that wait for their parent in a task's memory.
HELD = 10_000
#: Conversations in one packed run of ids.
RUN = 8192
EMPTY = hashlib.sha256(b"").hexdigest()
NODE, STACK, IDS = 0, 1, 2

SWEPT = pa.schema(
    [
        ("kind", pa.int32()), ("segment", pa.int64()), ("side", pa.int32()), ("left", pa.bool_()), ("depth", pa.int32()), ("pid", pa.binary()), ("parent", pa.binary()),
        ("turn", pa.binary()), ("words", pa.int64()), ("low", pa.int64()), ("parent_low", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
        ("saved", pa.int64()), ("sha", pa.string()), ("asked", pa.bool_()), ("run", pa.int32()), ("ids", pa.binary()),
    ]
)
SWEPT_SQL = (
    "kind int, segment long, side int, left boolean, depth int, pid binary, parent binary, turn binary, words long, low long, parent_low long, n long, "
    "children long, leaves long, saved long, sha string, asked boolean, run int, ids binary"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of name and words): each conversation after its first turns were exchanged."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), text.alias("text")).alias("t")).where("conv_id is not null")
    name = lambda t: F.substring(F.unhex(F.sha2(F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256)), 1, NAME)
    words = lambda t: F.size(F.regexp_extract_all(t["text"], F.lit(WORD), F.lit(0)))
    in_order = F.sort_array(F.collect_list("t"))  # a struct's nulls come first
    arrays = turns.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(name(t).alias("name"), words(t).alias("words"))).alias("own"))
    arrays = written(arrays, "turn-arrays")
    heads = arrays.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    return own.select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))


class Node:
    """An open node: what its subtree has given so far, but for what is still open below it."""

    __slots__ = ("asked", "children", "depth", "ids", "leaves", "left", "low", "n", "parent", "pending", "pid", "saved", "turn", "words")

    def __init__(self, depth: int, turn: bytes, words: int, parent: bytes | None, pid: bytes | None = None, left: bool = False):
        self.depth, self.turn, self.words, self.parent, self.left = depth, turn, words, parent, left
        self.pid = pid or hashlib.blake2b((parent or b"") + turn, digest_size=NAME).digest()
        self.low, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids, self.pending, self.asked = array("q"), [], False

    def add(self, low: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        if low is not None and (self.low is None or low < self.low):
            self.low = low
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved


class Sweep:
    """The stack over sorted arrays, or over the stacks of sorted partitions. Nodes on the first path may go on before it (left)."""

    def __init__(self, hashed: bool, held: int = HELD, run: int = RUN):
        self.path: list[Node] = []
        self.frozen: list[Node] = []
        self.out: list[dict] = []
        self.hashed, self.held, self.run = hashed, held, run

    def close_to(self, depth: int) -> None:
        """Pop the nodes below depth, deepest first."""
        while len(self.path) > depth + 1:
            node = self.path.pop()
            if node.left:
                self.frozen.append(node)
            else:
                self._done(node, self.path[-1] if self.path else None)

    def _done(self, node: Node, parent: Node | None) -> None:
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.words
        for row in node.pending:
            row["parent_low"] = node.low
        self.out += node.pending
        sha = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest() if self.hashed else None
        row = {
            "kind": NODE, "depth": node.depth, "pid": node.pid, "parent": node.parent, "low": node.low, "n": node.n, "children": node.children,
            "leaves": leaves, "saved": saved, "sha": sha, "asked": node.asked or not self.hashed,
        }
        if parent is None:
            self.out.append(row)
            return
        parent.add(node.low, node.n, 1, leaves, saved)
        parent.pending.append(row)
        if len(parent.pending) > self.held:
            self._flush(parent)

    def _flush(self, node: Node) -> None:
        node.asked = True
        self.out += node.pending
        node.pending = []

    def row(self, conv_id: int, names: list[bytes], words: list[int]) -> None:
        path = self.path
        first = not path
        if first:
            path.append(Node(0, b"", 0, None, left=True))
        same = 0
        while same < len(names) and same + 1 < len(path) and path[same + 1].turn == names[same]:
            same += 1
        self.close_to(same)
        for d in range(same, len(names)):
            path.append(Node(d + 1, names[d], words[d], path[-1].pid, left=first))
        path[-1].ids.append(conv_id)
        path[-1].add(conv_id, 1, 0, 0, 0)

    def segment(self, first_only: list[Node], path: list[Node], whole: bool) -> None:
        """Go on with a segment whose first path is the left ones of path and first_only, and whose last path is path."""
        shared = [x for x in path if x.left]
        begin = not self.path
        own = shared + sorted(first_only, key=lambda x: x.depth)
        same = 0
        while same < len(own) and same < len(self.path) and self.path[same].turn == own[same].turn:
            same += 1
        if not begin:
            self.close_to(same - 1)
        for mine, more in zip(self.path, own[:same], strict=False):
            mine.add(more.low, more.n, more.children, more.leaves, more.saved)
        for x in own[same:]:
            x.left = begin and not whole
            self.path.append(x)
        self.close_to(len(shared) - 1)
        self.path += path[len(shared) :]

    def end(self, segment: int, whole: bool = False) -> None:
        """What is still open: as nodes if this was the whole trie, else as the stacks of one segment."""
        if whole:
            self.close_to(-1)
            return
        for side, nodes in ((0, self.frozen), (1, self.path)):
            for x in nodes:
                self._flush(x)
                self.out.append(
                    {
                        "kind": STACK, "segment": segment, "side": side, "left": x.left, "depth": x.depth, "pid": x.pid, "parent": x.parent, "turn": x.turn,
                        "words": x.words, "low": x.low, "n": x.n, "children": x.children, "leaves": x.leaves, "saved": x.saved,
                    }
                )
                self.out += [
                    {"kind": IDS, "segment": segment, "pid": x.pid, "run": k, "ids": zlib.compress(np.diff(np.array(x.ids[at : at + self.run], dtype=np.int64), prepend=0).tobytes())}
                    for k, at in enumerate(range(0, len(x.ids), self.run))
                ]

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.out) > least:
            out, self.out = self.out, []
            yield pa.RecordBatch.from_pylist(out, SWEPT)


def _swept(held: int, run: int):
    """Sweep one partition of sorted (key, words, conv_id)."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(True, held, run)
        for batch in batches:
            for key, words, conv_id in zip(*(batch.column(c) for c in ("key", "words", "conv_id")), strict=True):
                key = key.as_py()
                sweep.row(conv_id.as_py(), [key[k : k + NAME] for k in range(0, len(key), NAME)], words.as_py())
                yield from sweep.batches(RUN)
        if sweep.path:
            sweep.end(TaskContext.get().partitionId())
        yield from sweep.batches()

    return swept


def _stitched(whole: bool):
    """Stitch the segments of each group (sorted by group, segment, side, depth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, group, segment, stacks = Sweep(hashed=False), None, None, ([], [])
        for batch in batches:
            for r in batch.to_pylist():
                if (r["group"], r["segment"]) != (group, segment):
                    if segment is not None:
                        sweep.segment(*stacks, whole)
                    if r["group"] != group and group is not None:
                        sweep.end(group, whole)
                        yield from sweep.batches()
                        sweep = Sweep(hashed=False)
                    group, segment, stacks = r["group"], r["segment"], ([], [])
                node = Node(r["depth"], r["turn"], r["words"], r["parent"], r["pid"], r["left"])
                node.add(r["low"], r["n"], r["children"], r["leaves"], r["saved"])
                stacks[r["side"]].append(node)
        if segment is not None:
            sweep.segment(*stacks, whole)
            sweep.end(group, whole)
        yield from sweep.batches()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pid, sha of the runs of ids of each pid (sorted by pid, segment, run), one run at a time."""
    pid, sha = None, None
    for batch in batches:
        for own, ids in zip(batch.column("pid"), batch.column("ids"), strict=True):
            if own.as_py() != pid:
                if pid is not None:
                    yield pa.RecordBatch.from_pylist([{"pid": pid, "sha": sha.hexdigest()}])
                pid, sha, between = own.as_py(), hashlib.sha256(), b""
            text = ",".join(map(str, np.cumsum(np.frombuffer(zlib.decompress(ids.as_py()), dtype=np.int64)).tolist()))
            sha.update(between + text.encode())
            between = b","
    if pid is not None:
        yield pa.RecordBatch.from_pylist([{"pid": pid, "sha": sha.hexdigest()}])


def _dealt(stacks: DataFrame) -> DataFrame:
    return stacks.repartition("group").sortWithinPartitions("group", "segment", "side", "depth")


def prefix_trie(conversations: DataFrame, fan: int = FAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), ""))
    arrays = rebuilt(conversations).select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words"))
    arrays = written(arrays, "rebuilt")  # read twice: for the bounds of the ranges, and to be sorted
    swept = arrays.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_swept(HELD, RUN), SWEPT_SQL)
    swept = written(swept, "swept")
    stacks, done = swept.where(F.col("kind") == STACK), []
    while True:
        whole = (stacks.agg(F.max("segment")).first()[0] or 0) < fan
        grouped = stacks.withColumn("group", F.floor(F.col("segment") / fan).cast("long"))
        merged = written(_dealt(grouped).mapInArrow(_stitched(whole), SWEPT_SQL), "stitched")
        done.append(merged.where(F.col("kind") == NODE))
        if whole:
            break
        stacks = merged.where(F.col("kind") == STACK)
    runs = swept.where(F.col("kind") == IDS).select("pid", "segment", "run", "ids")
    digests = runs.repartition("pid").sortWithinPartitions("pid", "segment", "run").mapInArrow(_digests, "pid binary, sha string")
    columns = ("pid", "parent", "low", "parent_low", "depth", "n", "children", "leaves", "saved", "sha", "asked")
    stitched = functools.reduce(DataFrame.unionByName, done).drop("sha").join(digests, "pid", "left").withColumn("sha", F.coalesce("sha", F.lit(EMPTY)))
    nodes = written(swept.where(F.col("kind") == NODE).select(*columns).unionByName(stitched.select(*columns)), "nodes")
    waits = F.col("parent").isNotNull() & F.col("parent_low").isNull()
    waiting = nodes.where(waits).drop("parent_low")
    parents = nodes.where("asked and children > 0").select(F.col("pid").alias("parent"), F.col("low").alias("parent_low"), F.col("children").alias("of"))
    found = joined_by_share(waiting, parents, "parent", "of", waiting.count())
    out = nodes.where(~waits).unionByName(found.select(*nodes.columns))
    return out.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )
