"""Byte-balanced sharding by Karmarkar-Karp differencing.

Documents of equal text stay together: the text's hash picks one of CELLS cells, and cells are what is dealt. Cell sizes are
summed in each task before the shuffle, so a text that a third of all rows share costs one row a task. The differencing
starts from one partial partition for each cell and repeatedly combines the two of largest spread, the largest shard of one
with the smallest of the other. It sees CELLS sums whatever the corpus holds, and its result, a shard for each cell, is of
the same fixed size.

Slots: ids are spread over blocks by hash; counts of (shard, block) give each block its first slot, and a window over the
block numbers the rows in it, so no task gets a whole shard.

Defined results: a null text has no bytes and the CRC of none, and stays with empty texts; repeated rows get a slot each;
an empty table gives no rows; ties between partial partitions go by cell number, between rows of a block by id and text;
columns besides doc_id and text, whatever their names, are ignored. A single text, or cell, larger than a shard's share makes its
shard that much larger: groups are indivisible.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import written

SHARDS = 24
CELLS = 1 << 16
#: Bytes that a document takes besides its text.
OVERHEAD = 8


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by the largest differencing method for any number of shards."""
    heap = []
    for item, size in enumerate(sizes):
        if shards == 1:
            return [0] * len(sizes)
        heap.append((-size, item, [size] + [0] * (shards - 1), [item] + [None] * (shards - 1)))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a_sums, a_sets = heapq.heappop(heap)
        _, _, b_sums, b_sets = heapq.heappop(heap)
        pairs = sorted(
            ((x + y, p, q) for x, y, p, q in zip(a_sums, reversed(b_sums), a_sets, reversed(b_sets), strict=True)), key=lambda t: -t[0]
        )
        least = pairs[-1][0]
        sets = [p if q is None else q if p is None else (p, q) for _, p, q in pairs]
        heapq.heappush(heap, (least - pairs[0][0], serial, [s - least for s, _, _ in pairs], sets))
        serial += 1
    out = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3] if heap else []):
        todo = [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node)
            elif node is not None:
                out[node] = shard
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digest = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"),
        ),
        "shard-digest",
    )
    cells = sorted((r.cell, r.bytes, r.rows) for r in digest.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    dealt = differencing([b for _, b, _ in cells], shards)
    shard_of = spark.createDataFrame([(c, s) for (c, _, _), s in zip(cells, dealt, strict=True)], "cell int, shard int")
    blocks = max(256, sum(n for _, _, n in cells) // 1_000_000)
    placed = digest.join(F.broadcast(shard_of), "cell").withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(first, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
