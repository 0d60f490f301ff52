"""The stored graph: split buckets, statistics and index kept by ingests, two writers, vacuum."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import api
from weftgraph.operators import graph, routing
from weftgraph.sources import store

DOCS = "doc_id long, part string, text string"


def rows(frame, *columns):
    return sorted(map(str, frame.select(*columns).collect()))


def stats_of(frame):
    return {r.word: (r.freq, round(r.edge_weight, 6)) for r in frame.collect()}


def same_as_made_anew(spark, path):
    """Statistics, catalog and index of the store are those of its whole graph."""
    own = store.load_graph(spark, path)
    want = stats_of(graph.word_stats(own.nodes, own.edges))
    assert stats_of(store.load_stats(spark, path, phrases=True)) == want
    assert stats_of(store.load_stats(spark, path)) == {k: v for k, v in want.items() if len(k.split()) == 1 and k.strip() == k}
    assert rows(store.load_catalog(spark, path), "part") == rows(own.nodes.select("part").distinct(), "part")
    assert rows(store.load_index(spark, path), "key", "part") == rows(routing.part_index(routing.catalog(own.nodes)), "key", "part")


def made(spark, docs):
    return graph.chunk_graph(spark.createDataFrame(docs, DOCS))


def drawn(r, first, n):
    words = "alpha beta gamma delta owl ice sea code gold silver".split()
    text = lambda: ". ".join(" ".join(r.choices(words, k=r.choice([1, 1, 2, 4]))) for _ in range(6))
    return [(first + k, r.choice(["sea", "ice_cold", "general", "x_y"]), text()) for k in range(n)]


def test_statistics_and_index_follow_ingests(spark, tmp_path, monkeypatch):
    r, path = random.Random(4), f"file://{tmp_path}/g"
    monkeypatch.setattr(store, "MOST_DELTAS", 3)
    for k in range(3):
        store.add_to_store(made(spark, drawn(r, 100 * k, 5)), path)
    same_as_made_anew(spark, path)
    own = store.load_graph(spark, path)
    # edges between parts, and then one of these parts replaced: its contents change under edges of other buckets
    ends = own.nodes.groupBy("part").agg(F.min("node_id").alias("id")).collect()
    across = [(a.part, a.id, b.part, b.id, 0.4, 2, "Semantic", None) for a in ends for b in ends if a.part != b.part]
    store.add_to_store(graph.Graph(own.nodes, own.tags, spark.createDataFrame(across, own.edges.schema)), path)
    same_as_made_anew(spark, path)
    store.add_to_store(made(spark, [(900, "sea", "alpha. quite new. beta"), (901, "new_part", "alpha")]), path, replace_parts=True)
    same_as_made_anew(spark, path)
    assert len(store.held(spark, path).appended["words"]) <= 4
    assert {x.content for x in store.load_graph(spark, path, ["sea"]).nodes.collect()} == {"alpha", "quite new"}  # pieces of four bytes go


def test_buckets_split_and_parts_read_few_files(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/g"
    monkeypatch.setattr(store, "MOST_ROWS", 40)
    store.save_graph(made(spark, [(k, f"part{k}", f"text of {k}. and more of {k}") for k in range(2000)]), path)
    first = store.current_version(spark, path)
    assert len(first) > 90 and max(store.held(spark, path).rows.values()) <= 80
    store.add_to_store(made(spark, [(5000 + k, "part7", f"a further text {k}") for k in range(100)]), path)
    after = store.current_version(spark, path)
    assert sum(v in first.values() for v in after.values()) >= len(first) - 1  # all other buckets' files are as they were
    for part, n in (("part7", 102), ("part8", 2), ("part1999", 2)):
        assert store.load_graph(spark, path, [part]).nodes.count() == n
        assert len(store.files_of(spark, path, "nodes", [part])) == 1
    assert store.load_graph(spark, path).nodes.count() == 4100 and store.load_catalog(spark, path).count() == 2000
    assert store.load_graph(spark, path, []).nodes.count() == 0


@pytest.mark.parametrize("same_part", [False, True])
def test_two_writers_both_land(spark, tmp_path, monkeypatch, same_part):
    """The other commits after this one has read and written, and before it commits."""
    path, other = f"file://{tmp_path}/g", []
    store.save_graph(made(spark, [(1, "a", "the first text. its second")]), path)
    commit = store._commit

    def slower(*args):
        if not other:
            other.append(True)
            store.add_to_store(made(spark, [(2, "a" if same_part else "far_away", "from the other writer")]), path)
        return commit(*args)

    monkeypatch.setattr(store, "_commit", slower)
    store.add_to_store(made(spark, [(3, "a", "from this writer")]), path)
    said = {x.content for x in store.load_graph(spark, path).nodes.collect()}
    assert said == {"the first text", "its second", "from the other writer", "from this writer"}
    same_as_made_anew(spark, path)


def test_vacuum_deletes_what_no_commit_needs(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    for k in range(3):
        store.save_graph(made(spark, [(k, "a", f"text {k}")]), path)
    assert not store.vacuum(spark, path)  # too young
    assert len(store.vacuum(spark, path, older_than=0)) == 2 and len(os.listdir(tmp_path / "g" / "data")) == 1
    assert {x.content for x in store.load_graph(spark, path).nodes.collect()} == {"text 2"}


def test_an_ingest_reads_only_what_it_touches(spark, tmp_path):
    """All files of other buckets are taken away, and the ingest doesn't miss them."""
    path = f"file://{tmp_path}/g"
    api.ingest_documents(spark.createDataFrame([(k, f"part{k}", f"a text of number {k}. and more") for k in range(64)], DOCS), path)
    held = store.current_version(spark, path)
    touched = set(store.buckets_of(spark.createDataFrame([("part3",), ("core_language",)], "part string"), held))
    (version,) = set(held.values())
    for table in ("nodes", "tags", "edges"):
        for folder in (tmp_path / "g" / "data" / version / table).glob("bucket=*"):
            if int(folder.name.split("=")[1]) not in touched:
                for file in folder.iterdir():
                    file.unlink()
    api.ingest_documents(spark.createDataFrame([(100, "part3", "one more text")], DOCS), path)
    assert "one more text" in {r.content for r in store.load_graph(spark, path, ["part3"]).nodes.collect()}


def test_asking_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    docs = [(1, "ownership", "Ownership is a set of rules. It governs memory."), (2, "sea", "The sea is deep. It is cold.")]
    api.ingest_documents(spark.createDataFrame(docs, DOCS), path)
    queries = spark.createDataFrame([(1, "what is ownership?"), (2, "zzz")], "query_id long, query string")
    own = store.load_graph(spark, path)
    stored, plain = api.ask_store(queries, path), api.ask(queries, own, graph.word_stats(own.nodes, own.edges))
    assert rows(stored.routed, "query_id", "part", "rank") == rows(plain.routed, "query_id", "part", "rank")
    active = lambda turn: rows(turn.activation.withColumn("act", F.round("act", 6)), "query_id", "part", "node_id", "act")
    assert active(stored) == active(plain) and rows(stored.answers, "query_id", "answer") == rows(plain.answers, "query_id", "answer")
