"""From documents to a partitioned property graph of text nodes and weighted, typed edges.

documents  doc_id, part, text; doc_id is unique, and a document without one, a part or a text is left out
chunks     doc_id, part, pos, chunk
nodes      part, node_id, content, node_type; content is unique in its part
tags       part, node_id, tag, weight
edges      src_part, src_id, dst_part, dst_id, weight, co_firings, edge_type, role; one for each pair of nodes

A node's id is the place where its content first occurs, doc_id * DOC_PLACES + pos * CHUNK_PLACES + rank in the chunk: unique in
its part, in order of first occurrence, and found by an aggregate, without numbering a part in one task. Concepts beyond the places of
a long chunk have negative ids.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import morphology, routing
from weftgraph.session import settled, written

CHUNK_PLACES = 1 << 7
DOC_PLACES = 1 << 27
MOST_CHUNKS, MOST_DOCS = DOC_PLACES // CHUNK_PLACES, 1 << 36
SEQUENCE_WEIGHT, ROLE_WEIGHT = 0.85, 0.8
SEQUENTIAL, SEMANTIC = "Sequential", "Semantic"
LANGUAGE_PART = "core_language"
EDGE_COLUMNS = ("src_part", "src_id", "dst_part", "dst_id", "weight", "co_firings", "edge_type", "role")
KEY = ("src_part", "src_id", "dst_part", "dst_id")


#: Kinds of events in the order in which a chunk makes them; its own step comes before or after the others.
STEPS_FIRST, FOLLOWS, AS_SUBJECT, AS_OBJECT, STEPS_LAST = range(5)


class Graph(NamedTuple):
    nodes: DataFrame
    tags: DataFrame
    edges: DataFrame


def place(doc_id: Column, pos: Column, rank: Column | int = 0) -> Column:
    """The number of a place; an error for ids or chunks beyond MOST_DOCS and MOST_CHUNKS (sources.files.numbered gives ids)."""
    fits = (doc_id >= 0) & (doc_id < MOST_DOCS) & (pos < MOST_CHUNKS)
    return F.when(fits, doc_id * DOC_PLACES + pos * CHUNK_PLACES + rank).otherwise(F.raise_error(F.lit("a doc_id or chunk number is out of range")).cast("long"))


def chunked(docs: DataFrame, chunker: Callable[[Column], Column] | None = None, parts: DataFrame | None = None) -> DataFrame:
    """chunks of docs (doc_id, part, text), in order from 0, by chunker or as text.chunks cuts them. A narrow map. With parts,
    documents without a part have chunks without one."""
    named = docs.where("doc_id is not null and part is not null" if parts is None else "doc_id is not null")
    return named.select("doc_id", "part", F.posexplode((chunker or T.chunks)(F.col("text"))).alias("pos", "chunk"))


def nodes_of(contents: DataFrame, dedupe: str = "part") -> DataFrame:
    """nodes of contents (part, content, place): one for each content of a part, or with dedupe="global" one in the part where it comes first."""
    first = F.min(F.struct("place", "part")).alias("first")
    if dedupe == "global":
        found = contents.groupBy("content").agg(first).select(F.col("first.part").alias("part"), F.col("first.place").alias("node_id"), "content")
    else:
        found = contents.groupBy("part", "content").agg(F.min("place").alias("node_id")).select("part", "node_id", "content")
    return found.withColumn("node_type", T.node_kind(F.col("content")))


def word_tags(nodes: DataFrame) -> DataFrame:
    """Each node's words and how often it has them: runs in the sorted words. A narrow map, linear but for the sort."""
    words = nodes.select("part", "node_id", F.sort_array(T.words_of(F.col("content"))).alias("words"))
    first = lambda x: (x["i"] == 0) | (F.get("words", x["i"] - 1) != x["tag"])
    runs = words.select("part", "node_id", F.size("words").alias("n"), F.filter(F.transform("words", lambda w, i: F.struct(w.alias("tag"), i.alias("i"))), first).alias("runs"))
    counted = F.zip_with("runs", F.slice("runs", F.lit(2), F.greatest(F.size("runs"), F.lit(1))), lambda a, b: F.struct(a["tag"].alias("tag"), (F.coalesce(b["i"], F.col("n")) - a["i"]).cast("double").alias("weight")))
    return runs.select("part", "node_id", F.inline(counted))


def chunk_steps(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge events from each chunk's node to the next one's in its document (src_part, src_id, dst_part, dst_id, ord)."""
    found = chunks.join(nodes.select("part", "node_id", F.col("content").alias("chunk")), ["part", "chunk"])
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = found.select("doc_id", "pos", "part", "node_id", F.lag("part").over(order).alias("src_part"), F.lag("node_id").over(order).alias("src_id"))
    return before.where("src_id is not null").select(
        "src_part", "src_id", F.col("part").alias("dst_part"), F.col("node_id").alias("dst_id"),
        F.struct(place(F.col("doc_id"), F.col("pos")).alias("place"), F.lit(3).alias("phase"), F.lit(0).alias("seq")).alias("ord"),
    )


def _made(weight: Column, kind: Column, role: Column) -> list[Column]:
    """What a new edge has besides its ends."""
    return [weight.alias("weight"), F.lit(0).cast("long").alias("co_firings"), kind.alias("edge_type"), role.alias("role")]


def upserted(events: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Edges after events (KEY, weight, edge_type, role, ord), on top of edges if given.

    The last event gives weight, cut to 0..1, and type; the last event with a role gives the role; co-firings stay.
    """
    last = F.max_by(F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight"))).alias("weight"), "edge_type"), "ord")
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("ord")))
    new = events.groupBy(*KEY).agg(last.alias("last"), role.alias("role"))
    new = new.select(*KEY, F.col("last.weight").alias("weight"), F.lit(0).cast("long").alias("co_firings"), F.col("last.edge_type").alias("edge_type"), "role")
    if edges is None:
        return new
    old = edges.select(*EDGE_COLUMNS, F.lit(0).alias("age")).unionByName(new.select(*EDGE_COLUMNS, F.lit(1).alias("age")))
    latest = F.max_by(F.struct("weight", "edge_type"), "age").alias("last")
    kept = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("age"))).alias("role")
    merged = old.groupBy(*KEY).agg(latest, kept, F.max("co_firings").alias("co_firings"))
    return merged.select(*KEY, F.col("last.weight").alias("weight"), "co_firings", F.col("last.edge_type").alias("edge_type"), "role")


def chunk_nodes(docs: DataFrame, dedupe: str = "part") -> DataFrame:
    """The nodes of docs' chunks."""
    return _nodes_of_chunks(chunked(docs), dedupe)


def _nodes_of_chunks(chunks: DataFrame, dedupe: str) -> DataFrame:
    return nodes_of(chunks.select("part", F.col("chunk").alias("content"), place(F.col("doc_id"), F.col("pos")).alias("place")), dedupe)


def chunk_graph(docs: DataFrame, dedupe: str = "part") -> Graph:
    """The graph of chunks alone: their nodes, words and sequence. Chunks are written, as nodes and steps both read them; who reads nodes
    more than once writes them."""
    return graph_of_chunks(written(chunked(docs), "chunks", small=True), dedupe)


def graph_of_chunks(chunks: DataFrame, dedupe: str = "part") -> Graph:
    """As chunk_graph, of chunks. Its edges are all alike, so it doesn't matter which event of one comes last."""
    nodes = _nodes_of_chunks(chunks, dedupe)
    steps = chunk_steps(chunks, nodes if dedupe == "part" else _everywhere(chunks, nodes)).select(*KEY).distinct()
    return Graph(nodes, word_tags(nodes), steps.select(*KEY, *_made(F.lit(SEQUENCE_WEIGHT), F.lit(SEQUENTIAL), F.lit(None).cast("string"))))


def _everywhere(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes under every part that has their content; node_id alone then names the node."""
    parts = chunks.select(F.col("part"), F.col("chunk").alias("content")).distinct()
    return parts.join(nodes.select("node_id", "content"), "content").select("part", "node_id", "content")


def word_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """word, freq, edge_weight: how many nodes have that content, and the weight of their edges, either way; lower-case contents
    count all cases together, other spellings on their own as well."""
    named = nodes.select("part", "node_id", F.explode(F.array_distinct(F.array(T.lower_tr(F.col("content")), "content"))).alias("word"))
    ends = edges.select(F.col("src_part").alias("part"), F.col("src_id").alias("node_id"), "weight").unionByName(
        edges.select(F.col("dst_part").alias("part"), F.col("dst_id").alias("node_id"), "weight")
    )
    weight = ends.groupBy("part", "node_id").agg(F.sum("weight").alias("weight"))
    return named.join(weight, ["part", "node_id"], "left").groupBy("word").agg(
        F.count("*").cast("double").alias("freq"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("edge_weight")
    )


def _occurs(at: Column, rank: Column, own: Column) -> list[Column]:
    """Where a content occurs: its chunk, its rank there, and the id that it has if this is its first occurrence."""
    return [at.alias("at"), rank.cast("int").alias("rank"), own.alias("place")]


def _placed(concepts: DataFrame, any_length: bool) -> DataFrame:
    """concepts with the id of their place. Chunks of any length can have more concepts than a chunk has places: a document's concepts
    beyond these are numbered, and their ids are negative. A chunk of sentence pieces has no room for so many."""
    inside = F.col("rank") + 1 < CHUNK_PLACES
    near = concepts.where(inside).withColumn("place", F.col("id") + F.col("rank") + 1)
    if not any_length:
        return near
    doc_id = F.shiftright("id", DOC_PLACES.bit_length() - 1)
    number = F.row_number().over(Window.partitionBy(doc_id).orderBy("id", "rank")).cast("long")
    beyond = F.when(number < DOC_PLACES, -1 - (doc_id * DOC_PLACES + number)).otherwise(F.raise_error(F.lit("a document has too many concepts")).cast("long"))
    return near.unionByName(concepts.where(~inside).withColumn("place", beyond))


def routed_chunks(chunks: DataFrame, parts: DataFrame, stats: DataFrame, index: routing.Index | None = None) -> DataFrame:
    """chunks, each without a part in the one of parts (part) that it matches best as a query, or in `general`."""
    lost = chunks.where("part is null").select(place(F.col("doc_id"), F.col("pos")).alias("query_id"), F.col("chunk").alias("query"))
    best = routing.route(lost, parts, stats, 1, index).select("query_id", F.col("part").alias("found"))
    placed = chunks.withColumn("query_id", place(F.col("doc_id"), F.col("pos"))).join(best, "query_id", "left")
    return placed.select("doc_id", F.coalesce("part", "found").alias("part"), "pos", "chunk")


class _Contents(NamedTuple):
    """What a graph's edges are made from."""

    nodes: DataFrame
    tags: DataFrame
    chunks: DataFrame
    concepts: DataFrame


def build_graph(
    docs: DataFrame, stats: DataFrame, order: str = "text", chunker: Callable[[Column], Column] | None = None, parts: DataFrame | None = None,
    index: routing.Index | None = None,
) -> Graph:
    """The whole graph of docs: chunks, concepts with their roles, sentence templates.

    Documents without a part are left out, or with parts (part) each of their chunks goes to the one that it is routed to, by index if
    there is one.
    chunker cuts a text column into an array of chunks. stats is the snapshot of word_stats that the stemmer reads. order "text" writes a chunk's own sequence edge last and leaves
    out concepts of chunks without a template; "wiki" writes it first, keeps all concepts and makes no template nodes.
    """
    nodes, tags, chunks, concepts = _contents(docs, stats, order, chunker, parts, index)
    named = concepts.join(nodes.select("part", F.col("content").alias("concept"), "node_id"), ["part", "concept"])
    named = named.select("id", "last", "part", "rank", "node_id", F.col("concept").rlike(r"(?s)^\[.*\]$").alias("is_verb"))
    in_chunk, whole = Window.partitionBy("id").orderBy("rank"), Window.partitionBy("id")
    named = named.select(
        "last", "part", "rank", "node_id", "is_verb",
        F.lag("node_id").over(in_chunk).alias("before"),
        F.min(F.when(F.col("is_verb"), F.struct("rank", "node_id"))).over(whole)["node_id"].alias("verb"),
        F.min(F.when(~F.col("is_verb"), F.col("rank"))).over(whole).alias("first_noun"),
    )
    # a concept follows the one before, and as a noun has a role for the verb: one pass over the rows makes both
    event = lambda src, dst, what: F.struct(F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), (F.col("last") + what).alias("at"))
    role = F.when(F.col("rank") == F.col("first_noun"), AS_SUBJECT).otherwise(AS_OBJECT)
    ends = F.array_compact(F.array(
        F.when(F.col("before").isNotNull(), event("before", "node_id", F.lit(FOLLOWS))),
        F.when(~F.col("is_verb") & F.col("verb").isNotNull(), event("node_id", "verb", role)),
    ))
    events = named.select(F.col("part").alias("src_part"), F.explode(ends).alias("e")).select("src_part", "e.src_id", F.col("src_part").alias("dst_part"), "e.dst_id", "e.at")
    events = written(events, "events", small=True)  # what was shuffled for their nodes goes before they are shuffled themselves
    steps = chunk_steps(chunks, nodes).select(*KEY, (F.col("ord.place") + (STEPS_FIRST if order == "wiki" else STEPS_LAST)).alias("at"))
    return Graph(nodes, tags, _last_events(events.unionByName(steps)))


def build_nodes(docs: DataFrame, stats: DataFrame, order: str = "text") -> tuple[DataFrame, DataFrame]:
    """The nodes and tags of build_graph, for whoever needs no edges."""
    own = _contents(docs, stats, order)
    return own.nodes, own.tags


def _contents(
    docs: DataFrame, stats: DataFrame, order: str, chunker: Callable[[Column], Column] | None = None, parts: DataFrame | None = None,
    index: routing.Index | None = None,
) -> _Contents:
    chunks = written(chunked(docs, chunker, parts), "chunks", small=True)
    if parts is not None:
        chunks = written(routed_chunks(chunks, parts, stats, index), "chunks", small=True)
    at = place(F.col("doc_id"), F.col("pos"))
    # a chunk that its part has already adds neither nodes nor edges: its contents come first where it does, their edges last where it
    # does last
    each = chunks.groupBy("part", "chunk").agg(F.min(at).alias("id"), F.max(at).alias("last")) if chunker is None else chunks.select("part", "chunk", at.alias("id"), at.alias("last"))
    said = written(each, "said", small=True)
    texts = settled(docs.sparkSession, lambda: morphology.concepts_of(said, stats, ("id", "part", "last")), "texts")
    kept = texts if order == "wiki" else texts.where(F.col("template") != "")
    concepts = kept.select("id", "last", "part", F.posexplode("concepts").alias("rank", "concept"))
    contents = said.select("part", F.col("chunk").alias("content"), *_occurs(F.col("id"), F.lit(0), F.col("id")), F.lit("chunk").alias("kind"))
    contents = contents.unionByName(_placed(concepts, chunker is not None).select("part", F.col("concept").alias("content"), *_occurs(F.col("id"), F.col("rank") + 1, F.col("place")), F.lit("concept").alias("kind")))
    if order == "text":
        contents = contents.unionByName(kept.select(F.lit(LANGUAGE_PART).alias("part"), F.col("template").alias("content"), *_occurs(F.col("id"), F.lit(0), F.col("id")), F.lit("template").alias("kind")))
    nodes = written(_first_occurrences(contents, chunker is not None).select("part", "node_id", "content", T.node_kind(F.col("content")).alias("node_type"), "kind"), "nodes", small=True)
    bare = F.lower(F.regexp_replace("content", r"^[\[\]]+|[\[\]]+$", ""))
    one = F.lit(1.0).alias("weight")
    tags = word_tags(nodes.where("kind = 'chunk'")).unionByName(nodes.where("kind = 'concept'").select("part", "node_id", bare.alias("tag"), one))
    tags = tags.unionByName(nodes.where("kind = 'template'").select("part", "node_id", F.explode(F.array(F.lit("template"), F.lit("şablon"))).alias("tag"), one))
    nodes = nodes.drop("kind")
    return _Contents(nodes, tags, chunks, concepts)


def _first_occurrences(contents: DataFrame, any_length: bool) -> DataFrame:
    """part, content, node_id, kind: where each content of a part comes first, and as what. Places order chunks and ranks, but for those
    beyond the places of chunks of any length."""
    if any_length:
        found = contents.groupBy("part", "content").agg(F.min(F.struct("at", "rank", "place", "kind")).alias("first"))
        return found.select("part", "content", F.col("first.place").alias("node_id"), "first.kind")
    kinds = ("chunk", "concept", "template")
    found = contents.groupBy("part", "content").agg(*[F.min(F.when(F.col("kind") == k, F.col("place"))).alias(k) for k in kinds])
    first = F.least(*kinds)
    return found.select("part", "content", first.alias("node_id"), F.when(F.col("chunk") == first, "chunk").when(F.col("concept") == first, "concept").otherwise("template").alias("kind"))


def _last_events(events: DataFrame) -> DataFrame:
    """The edges that events make (KEY, at: the place of the chunk and on it the kind of event), as upserted() would: the last event gives
    weight and type, the last with a role the role. A noun that a chunk has again is an object from then on."""
    role_at = F.when(_kind(F.col("at")).isin(AS_SUBJECT, AS_OBJECT), F.col("at"))
    last = events.groupBy(*KEY).agg(F.max("at").alias("at"), F.max(role_at).alias("role_at"))
    semantic, role = F.col("at") == F.col("role_at"), _kind(F.col("role_at"))
    named = F.when(role == AS_SUBJECT, T.ROLE_SUBJECT).when(role == AS_OBJECT, T.ROLE_OBJECT)
    return last.select(*KEY, *_made(F.when(semantic, ROLE_WEIGHT).otherwise(SEQUENCE_WEIGHT), F.when(semantic, SEMANTIC).otherwise(SEQUENTIAL), named))


def _kind(at: Column) -> Column:
    return at.bitwiseAND(CHUNK_PLACES - 1)


def merged(old: Graph, new: Graph) -> Graph:
    """old with new added: contents that a part has already keep their node, new ones come after, edges are upserted."""
    known = old.nodes.select("part", "content", F.col("node_id").alias("known"))
    names = new.nodes.join(known, ["part", "content"], "left").select("part", "node_id", "content", "node_type", F.coalesce("known", "node_id").alias("to"), "known")
    taken = old.nodes.select("part", F.col("node_id").alias("to"))
    clash = names.where("known is null").join(taken, ["part", "to"], "left_semi")
    if not clash.isEmpty():
        raise ValueError("new documents reuse the ids of other documents")
    nodes = old.nodes.unionByName(names.where("known is null").select("part", "node_id", "content", "node_type"))
    fresh = names.where("known is null").select("part", "node_id")
    tags = old.tags.unionByName(new.tags.join(fresh, ["part", "node_id"], "left_semi"))
    to = names.select("part", "node_id", "to")
    ends = new.edges.join(to.toDF("src_part", "src_id", "src_to"), ["src_part", "src_id"]).join(to.toDF("dst_part", "dst_id", "dst_to"), ["dst_part", "dst_id"])
    events = ends.select("src_part", F.col("src_to").alias("src_id"), "dst_part", F.col("dst_to").alias("dst_id"), "weight", "edge_type", "role", F.lit(0).alias("ord"))
    return Graph(nodes, tags, upserted(events, old.edges))


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, node_id) of edge targets that are not among nodes."""
    targets = edges.select(F.col("dst_part").alias("part"), F.col("dst_id").alias("node_id")).distinct()
    return targets.join(nodes.select("part", "node_id"), ["part", "node_id"], "left_anti")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with both contents; those without both nodes are left out."""
    src = nodes.select(F.col("part").alias("src_part"), F.col("node_id").alias("src_id"), F.col("content").alias("src_content"))
    dst = nodes.select(F.col("part").alias("dst_part"), F.col("node_id").alias("dst_id"), F.col("content").alias("dst_content"))
    return edges.join(src, ["src_part", "src_id"]).join(dst, ["dst_part", "dst_id"])
