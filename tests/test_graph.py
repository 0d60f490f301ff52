"""Graph operators on small graphs."""

import math
import random

import pytest

from weftgraph.operators import activation, answers, graph, learning, morphology, paths, routing
from weftgraph.operators.components import connected_components
from weftgraph.operators.pages import running_text
from weftgraph.sources import files, store

EDGE = "src_part string, src_id long, dst_part string, dst_id long, weight double, co_firings long, edge_type string, role string"
SEED = "hafıza güvenlik sağla işletim isletim sistem sistemi indirme şekildeki kümeleme mekanik davranış".split()
DOCS = "doc_id long, part string, text string"


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame([(w, 1.0, 1.0) for w in SEED], "word string, freq double, edge_weight double")


def test_noun_stems(spark, stats):
    words = "indirme şekildeki kümeleme indirmeden şekildekinden mekaniği davranışını Hamburg'daki proton'larla işletim isletim çalışacağı".split()
    found = {r.word: (r.stem, r.suffix) for r in morphology.noun_stems(spark.createDataFrame([(w,) for w in words], "word string"), stats).collect()}
    assert found["indirme"] == ("indirme", "") and found["işletim"] == ("işletim", "") and found["kümeleme"] == ("kümeleme", "")
    assert found["indirmeden"] == ("indirme", "-den") and found["şekildekinden"] == ("şekildeki", "-den")
    assert found["mekaniği"] == ("mekanik", "-i") and found["davranışını"] == ("davranış", "-i")
    assert found["Hamburg'daki"] == ("Hamburg", "-de") and found["proton'larla"] == ("proton", "-e")
    assert found["çalışacağı"][1] == "-i"


def plain_stem(word, stats):
    """A word's stem and suffix, one ending after the other."""
    lower = lambda x: x.translate(str.maketrans("İI", "iı")).lower()
    stem, suffix = word, ""
    while True:
        low = lower(stem)
        freq, tied = stats.get(low, (0, 0))
        for name, ending in morphology.ENDINGS:
            if not low.endswith(ending) or len(stem) < len(ending) + 3 or len(ending) == 1 and (not stats or low[-2:] in morphology.WHOLE_ENDINGS):
                continue
            shorter = stem[: len(stem) - len(ending)]
            shorter = shorter[:-1] + shorter[-1].translate(str.maketrans("ğdbc", "ktpç"))
            other = stats.get(lower(shorter), (0, 0))
            if freq <= 0 or other[0] > 0 and tied <= 2 * other[1]:
                break
        else:
            return stem, suffix
        stem, suffix = shorter, suffix or name
        if freq > 0:
            return stem, suffix


@pytest.mark.parametrize("nodes", [0, 40, 400])
def test_stems_against_one_ending_after_the_other(spark, nodes):
    drawn = random.Random(nodes)
    bases = ["ev", "araba", "kitap", "KITAB", "İSTANBUL", "sistem", "a", "kağıd", "renk", "ler", "é", "x" * 60]
    words = {"", "a" * 300, *("".join([drawn.choice(bases), *(drawn.choice(morphology.ENDINGS)[1] for _ in range(drawn.randint(0, 5)))]) for _ in range(600))}
    stats = {}
    for word in drawn.sample(sorted(words), nodes):
        stats[word.lower()[: drawn.randint(1, 12)]] = (float(drawn.randint(0, 2)), float(drawn.randint(0, 4)))
    table = spark.createDataFrame([(w, *x) for w, x in stats.items()], "word string, freq double, edge_weight double")
    found = morphology.noun_stems(spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string"), table)
    rows = found.collect()
    assert len(rows) == len(words) and {r.word: (r.stem, r.suffix) for r in rows} == {w: plain_stem(w, stats) for w in words}


def test_verbs_give_way_to_longer_nodes(spark, stats):
    words = spark.createDataFrame([("işletim",), ("sağlar",), ("yazmalı",), ("masa",), ("eder",)], "word string")
    assert {(r.word, r.verb, r.tense) for r in morphology.verbs(words, stats).collect()} == {("sağlar", "sağla", "-r"), ("yazmalı", "yaz", "-meli"), ("eder", "et", "-r")}


def test_concepts(spark, stats):
    texts = spark.createDataFrame([("Rust hafıza güvenliğini sağlar.",), ("E = mc^2",), ("+",)], "chunk string")
    found = {r.chunk: (r.concepts, r.template) for r in morphology.concepts_of(texts, stats).collect()}
    assert found["Rust hafıza güvenliğini sağlar."] == (["Rust", "hafıza", "güvenlik", "[sağla]"], "[Özne] + [Nesne] + [Nesne]-i + [Eylem]-r")
    assert found["E = mc^2"] == (["E = mc^2"], "") and found["+"] == (["+"], "")


def test_build_graph_roles_and_upsert(spark, stats):
    docs = spark.createDataFrame([(1, "a", "Rust hafıza güvenliğini sağlar. Rust hafıza güvenliğini sağlar")], DOCS)
    own = graph.build_graph(docs, stats)
    name = {(r.part, r.node_id): r.content for r in own.nodes.collect()}
    edges = {(name[r.src_part, r.src_id], name[r.dst_part, r.dst_id]): (r.weight, r.edge_type, r.role) for r in own.edges.collect()}
    assert edges["Rust", "[sağla]"] == (0.8, "Semantic", "Özne") and edges["hafıza", "[sağla]"] == (0.8, "Semantic", "Nesne")
    assert edges["güvenlik", "[sağla]"] == (0.8, "Semantic", "Nesne")  # the role comes after the sequence edge
    assert edges["Rust", "hafıza"] == (0.85, "Sequential", None)
    whole = "Rust hafıza güvenliğini sağlar"
    assert edges[whole, whole] == (0.85, "Sequential", None)


def test_merging_keeps_known_nodes(spark, stats):
    one = graph.chunk_graph(spark.createDataFrame([(1, "a", "first piece. second piece")], DOCS))
    two = graph.chunk_graph(spark.createDataFrame([(2, "a", "second piece. third piece")], DOCS))
    both = graph.merged(one, two)
    assert sorted(r.content for r in both.nodes.collect()) == ["first piece", "second piece", "third piece"]
    assert both.edges.count() == 2 and graph.unresolved(both.edges, both.nodes).count() == 0


def test_routing_rare_before_common(spark):
    names = [f"part_{i}" for i in range(200)] + [f"part_ortak_{i}" for i in range(5)] + ["part_nadir"]
    parts = spark.createDataFrame([(n,) for n in names], "part string")
    queries = spark.createDataFrame([(1, "ortak nadir"), (2, "qqq")], "query_id long, query string")
    none = morphology.no_stats(spark)
    tags = {r.tag: r.weight for r in routing.query_tags(queries.where("query_id = 1"), parts, none).collect()}
    assert tags["ortak"] < tags["nadir"] == 1.0
    routed = routing.route(queries, parts, none).orderBy("query_id", "rank").collect()
    assert routed[0].part == "part_nadir" and routed[-1].part == "general"


def test_synonyms_only_where_absent(spark):
    parts = spark.createDataFrame([("x",)], "part string")
    queries = spark.createDataFrame([(1, "yap run"), (2, "run yap")], "query_id long, query string")
    found = {(r.query_id, r.tag): r.weight for r in routing.query_tags(queries, parts, morphology.no_stats(spark)).collect()}
    assert math.isclose(found[1, "yap"], 1 / 1.8) and math.isclose(found[1, "run"], 1.0) and math.isclose(found[1, "start"], 0.8 / 1.8)
    assert found[2, "run"] == found[2, "yap"] == 1.0


def test_propagation_by_hand(spark):
    tags = spark.createDataFrame([("a", 1, "apple", 0.5)], "part string, node_id long, tag string, weight double")
    edges = spark.createDataFrame([("a", 1, "a", 2, 0.8, 0, "Sequential", None), ("a", 2, "a", 3, 0.5, 0, "Semantic", None)], EDGE)
    query = spark.createDataFrame([(7, "apple", 1.0), (8, "banana", 1.0)], "query_id long, tag string, weight double")
    act = {r.node_id: round(r.act, 9) for r in activation.propagate(tags, edges, query).collect()}
    assert act == {1: round(0.5 * 0.95**2, 9), 2: round(0.4 * 0.95 + 0.475 * 0.8, 9), 3: round(0.4 * 0.5, 9)}


def test_reinforce_and_maintain(spark):
    edges = spark.createDataFrame([("a", 1, "a", 2, 0.5, 2, "Sequential", None), ("a", 2, "a", 3, 0.18, 0, "Semantic", None)], EDGE)
    kept = learning.consolidated(edges).collect()
    assert len(kept) == 1 and math.isclose(kept[0].weight, 0.7) and kept[0].co_firings == 0
    act = spark.createDataFrame([(1, "a", 1, 0.9), (1, "a", 2, 0.8)], "query_id long, part string, node_id long, act double")
    after = {(r.src_id, r.dst_id): (round(r.weight, 6), r.co_firings) for r in learning.reinforced(edges, act).collect()}
    assert after == {(1, 2): (round(0.5 + 0.072 - 0.01, 6), 3), (2, 3): (round(0.18 - 0.0036, 6), 0), (2, 1): (0.15, 0)}


def test_components_of_a_long_chain(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    found = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_eviction_respects_locks(spark):
    act = spark.createDataFrame([(1, "x", 1, 0.1), (1, "y", 2, 0.5)], "query_id long, part string, node_id long, act double")
    resident = spark.createDataFrame([("x",), ("y",), ("general",)], "part string")
    locked = spark.createDataFrame([("x",)], "part string")
    assert [r.part for r in learning.evicted(act, resident, locked, most=1).collect()] == ["y"]
    assert learning.evicted(act, resident, locked, most=2).count() == 0


def test_walk_goes_back_to_the_start(spark):
    nodes = spark.createDataFrame([("a", 0, "one", "Concept"), ("a", 1, "two", "Concept")], "part string, node_id long, content string, node_type string")
    edges = spark.createDataFrame([("a", 0, "a", 1, 0.8, 0, "Sequential", None)], EDGE)
    act = spark.createDataFrame([(1, "a", 0, 0.8), (1, "a", 1, 0.9)], "query_id long, part string, node_id long, act double")
    walked = paths.walks(act, edges, nodes)
    assert [r.node_id for r in walked.orderBy("path", "step").collect()] == [0, 1]
    lang = spark.createDataFrame([(1, "en")], "query_id long, lang string")
    assert paths.woven(walked, edges, nodes, lang).first().sentence == "One two."
    assert math.isclose(paths.walk_scores(walked, edges).first().score, 0.66)


def test_walks_go_back_to_where_a_long_sequence_begins(spark):
    """From the 31st of 34 nodes in a chain; an edge without weight isn't gone back over."""
    edges = [("a", k, "a", k + 1, 0.0 if k == 2 else 0.9, 0, "Sequential", "") for k in range(34)]
    nodes = spark.createDataFrame([("a", k, f"content of node {k}") for k in range(35)], "part string, node_id long, content string")
    act = spark.createDataFrame([(1, "a", 31, 1.0)], "query_id long, part string, node_id long, act double")
    found = paths.walks(act, spark.createDataFrame(edges, EDGE), nodes).orderBy("path", "step").collect()
    assert [r.node_id for r in found if r.path == 0] == list(range(3, 11))


def test_running_text(spark):
    rows = [("f", n, f"HEAD LINE\nBody text of page {w} stands here\n{n}\n1. Intro ........ 5\nFOOT LINE") for n, w in ((1, "one"), (2, "two"), (3, "three"))]
    text = running_text(spark.createDataFrame(rows, "path string, page_no int, page_text string")).first().content
    assert text == "Body text of page one stands here \nBody text of page two stands here \nBody text of page three stands here"


def test_store_round_trip(spark, tmp_path):
    own = store.seed_graph(spark)
    store.save_graph(own, f"file://{tmp_path}/g")
    back = store.load_graph(spark, f"file://{tmp_path}/g", ["rust"])
    assert back.nodes.count() == 2 and back.edges.count() == 1 and store.load_catalog(spark, f"file://{tmp_path}/g").count() == 3
    assert store.status(store.load_graph(spark, f"file://{tmp_path}/g")).first().asDict() == {"nodes": 5, "edges": 2, "parts": 3}


def test_files_and_wiki(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "one.txt").write_text("Merhaba dünya")
    (tmp_path / "in" / "sub" / "TWO.TXT").write_text("ikinci")
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe")
    read = files.text_files(spark, f"{tmp_path}/in")
    assert sorted(r.content for r in read.collect()) == ["Merhaba dünya", "ikinci"]
    none = files.empty_registry(spark)
    registry = files.updated_registry(none, files.file_documents(files.changed_files(read, none), none))
    assert files.changed_files(read, registry).count() == 0 and sorted(r.doc_id for r in registry.collect()) == [0, 1]
    pages = [("A b", "x" * 120, 1), ("A b", "y" * 120, 2), ("C", "#redirect [[A]]", 3), ("D", "short", 4)]
    wiki = spark.createDataFrame(pages, "title string, text string, ord long")
    assert [(r.part, r.text[0]) for r in files.wiki_documents(wiki).collect()] == [("a_b", "y")]
    assert files.page_counts(wiki).first().asDict() == {"processed": 2, "skipped": 2}


def test_ask_without_memory(spark):
    own = graph.chunk_graph(spark.createDataFrame([(1, "rust", "Rust is memory safe. It has no collector")], DOCS))
    queries = spark.createDataFrame([(1, "rust memory"), (2, "zzz")], "query_id long, query string")
    said = {r.query_id: r.answer for r in answers.ask(queries, own, morphology.no_stats(spark)).answers.collect()}
    assert said[1].startswith("[Mod: DETERMINISTIC]") and "Rust is memory safe" in said[1] and said[2] == answers.NOTHING
