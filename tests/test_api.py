"""The engine as a user sees it, on small inputs."""

import bz2
import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import api
from weftgraph.operators import activation, answers, graph, learning, morphology, paths
from weftgraph.operators.components import connected_components
from weftgraph.operators.skew import joined_by_share
from weftgraph.plans import queries
from weftgraph.sources import files, store
from weftgraph.streaming.ingest import ingest_stream

DOCS = "doc_id long, part string, text string"
EDGE = "src_part string, src_id long, dst_part string, dst_id long, weight double, co_firings long, edge_type string, role string"
SF = "/root/testdata/sf0.001"


def contents(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_numbers_follow_the_key(spark):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.lpad((F.col("id") * 7919 % 1000).cast("string"), 4, "0")).alias("key"))
    got = files.numbered(rows.repartition(5), "key", first=7).orderBy("key").collect()
    assert [r.doc_id for r in got] == list(range(7, 1007)) and files.numbered(rows.limit(0), "key").count() == 0


def test_join_by_share_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, k) for k in range(500)] + [(k, 0) for k in range(2, 300)], "key long, x long")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("top"))
    assert contents(joined_by_share(rows, counted, "key", "n", 798), "key", "x", "n", "top") == contents(rows.join(counted, "key"), "key", "x", "n", "top")


def test_folder_is_read_once_and_again_where_it_changed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rust_what_is_ownership.txt").write_text("Ownership rules memory. Every value has an owner.")
    (tmp_path / "in" / "other.txt").write_text("Quite another text stands here.")
    at, folder = f"file://{tmp_path}/graph", str(tmp_path / "in")
    registry = api.ingest_folder(spark, folder, at)
    own = store.load_graph(spark, at)
    assert {"Ownership rules memory", "Quite another text stands here"} <= {r.content for r in own.nodes.collect()}
    assert {"ownership", "other"} <= {r.part for r in store.load_catalog(spark, at).collect()}
    before = store.current_version(spark, at)
    assert contents(api.ingest_folder(spark, folder, at, registry), *registry.columns) == contents(registry, *registry.columns)
    assert store.current_version(spark, at) == before
    (tmp_path / "in" / "other.txt").write_text("A third text came instead. Quite another text stands here.")
    registry = api.ingest_folder(spark, folder, at, registry)
    after = store.current_version(spark, at)
    assert registry.count() == 2 and registry.agg(F.max("doc_id")).first()[0] == 2
    assert 0 < sum(after[b] != before[b] for b in after) <= 2  # the buckets of `other` and of templates
    nodes = [r.content for r in store.load_graph(spark, at, ["other"]).nodes.collect()]
    assert "A third text came instead" in nodes and nodes.count("Quite another text stands here") == 1
    assert store.load_graph(spark, at, ["ownership"]).nodes.count() > 0


def wiki_xml(pages):
    rows = "".join(f"<page><title>{t}</title><revision><text>{x}</text></revision></page>" for t, x in pages)
    return f"<mediawiki>{rows}</mediawiki>".encode()


def test_dump_becomes_a_part_for_each_page(spark, tmp_path):
    body = "Kuantum sistemi kullanır. Rust hafıza güvenliğini sağlar. " * 3
    pages = [("Kuantum Fiziği", f"'''Kuantum''' [[Fizik|fiziği]] {{{{kutu}}}} {body}"), ("Yön", "#REDIRECT [[X]]"), ("Taslak", "kısa"), ("Rust (dil)", body + "== KAYNAKÇA == gizli")]
    (tmp_path / "dump.xml").write_bytes(wiki_xml(pages))
    (tmp_path / "dump2.xml.bz2").write_bytes(bz2.compress(wiki_xml([("Rust (dil)", "Yeni metin burada durur ve yeterince uzundur. " * 4)])))
    at = f"file://{tmp_path}/graph"
    assert api.ingest_dump(spark, f"{tmp_path}/dump.xml", at).first().asDict() == {"processed": 2, "skipped": 2}
    own = store.load_graph(spark, at)
    assert {r.part for r in own.nodes.select("part").distinct().collect()} == {"kuantum_fizigi", "rust_dil"}
    text = {r.content for r in own.nodes.collect()}
    assert "Rust hafıza güvenliğini sağlar" in text and not any("gizli" in t or "{{" in t or "[[" in t for t in text)
    assert "[sağla]" in text and own.edges.where("role is not null").count() > 0
    api.ingest_dump(spark, f"{tmp_path}/dump2.xml.bz2", at)
    assert "Rust hafıza güvenliğini sağlar" not in {r.content for r in store.load_graph(spark, at, ["rust_dil"]).nodes.collect()}
    assert "Rust hafıza güvenliğini sağlar" in {r.content for r in store.load_graph(spark, at, ["kuantum_fizigi"]).nodes.collect()}


def test_chunks_without_a_part_are_routed(spark):
    docs = spark.createDataFrame([(1, None, "Ownership of values is strict. Nothing of the kind. The quantum world"), (2, "given", "Ownership stays where it is")], DOCS)
    parts = spark.createDataFrame([("ownership",), ("quantum",)], "part string")
    own = graph.build_graph(docs, morphology.no_stats(spark), parts=parts)
    chunks = own.nodes.where(F.col("content").isin("Ownership of values is strict", "Nothing of the kind", "The quantum world", "Ownership stays where it is"))
    assert contents(chunks, "content", "part") == [("Nothing of the kind", "general"), ("Ownership of values is strict", "ownership"), ("Ownership stays where it is", "given"), ("The quantum world", "quantum")]
    steps = own.edges.where("src_part = 'ownership' and dst_part = 'general' and edge_type = 'Sequential'")
    assert steps.count() == 1
    by_word = graph.build_graph(docs, morphology.no_stats(spark), chunker=lambda text: F.split(text, " "), parts=parts)
    assert by_word.nodes.where("content = 'Ownership'").count() == 2


def test_stream_adds_documents_once(spark, tmp_path):
    source, at = f"file://{tmp_path}/in", f"file://{tmp_path}/graph"
    for rows in ([(1, "rust", "Rust is memory safe. It has no collector.")], [(2, "rust", "Another document arrives. It has no collector."), (3, "sea", "The sea is deep.")]):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(source)
        ingest_stream(spark.readStream.schema(DOCS).parquet(source), at, f"file://{tmp_path}/state").awaitTermination(300)
    own = store.load_graph(spark, at)
    nodes = [(r.part, r.content) for r in own.nodes.collect()]
    assert len(nodes) == len(set(nodes)) and {("rust", "Rust is memory safe"), ("rust", "Another document arrives"), ("sea", "The sea is deep")} <= set(nodes)
    before = contents(own.edges, *graph.EDGE_COLUMNS)
    from weftgraph.streaming.ingest import ingest_batch

    ingest_batch(spark.createDataFrame([(3, "sea", "The sea is deep.")], DOCS), at)
    assert contents(store.load_graph(spark, at).edges, *graph.EDGE_COLUMNS) == before


def test_learning_and_maintenance(spark):
    own = graph.chunk_graph(spark.createDataFrame([(1, "general", "First thing here. Second thing here. Third thing here"), (2, "general", "Lonely thing")], DOCS))
    act = own.nodes.select(F.lit(1).cast("long").alias("query_id"), "part", "node_id", F.lit(0.9).alias("act"))
    learned = api.reinforce(own, act)
    assert learned.edges.count() == 4 * 3 and learned.edges.where("co_firings = 1").count() == 2
    some = learning.new_pairs(own.edges, act, most=2).count()
    assert some in (1, 2)
    kept = api.maintain(learned)
    assert kept.edges.where("weight >= 0.9").count() == 2 and {r.part for r in kept.nodes.collect()} == {"general", "here"}
    grown = api.add_documents(own, spark.createDataFrame([(3, "general", "Second thing here. Fourth thing here")], DOCS))
    assert grown.nodes.where("content = 'Second thing here'").count() == 1 and grown.edges.count() >= 3


def test_nan_is_never_active(spark):
    nan = float("nan")
    act = spark.createDataFrame([(1, "a", 4, nan), (1, "a", 2, 0.5), (1, "a", 3, 0.1)], "query_id long, part string, node_id long, act double")
    edges = spark.createDataFrame([("a", 1, "a", 2, 0.5, 0, "Sequential", None), ("a", 2, "a", 3, 0.5, 0, "Sequential", None)], EDGE)
    nodes = spark.createDataFrame([("a", k, f"c{k}") for k in (1, 2, 3, 4)], "part string, node_id long, content string")
    assert [r.node_id for r in activation.strongest(act).orderBy("act").collect()] == [3, 2]
    assert contents(activation.shown(act, nodes), "node_id") == [(2,)]
    assert learning.new_pairs(edges, act).count() == 0
    tags = spark.createDataFrame([("a", 1, "x", nan), ("a", 2, "x", 1.0)], "part string, node_id long, tag string, weight double")
    assert contents(activation.seeds(tags, spark.createDataFrame([(1, "x", 1.0)], "query_id long, tag string, weight double")), "node_id") == [(2,)]
    assert {r.node_id for r in paths.walks(act, edges, nodes).collect()} == {1, 2, 3}  # back from 2 to where its sequence begins
    free = learning.part_activation(act, spark.createDataFrame([("a",)], "part string")).first().act
    assert math.isclose(free, 0.6)


def plain_walks(active, edges, hidden):
    """Deterministic walks over all edges, by their definition."""
    act, seen, out = dict(active), set(), []
    order = sorted(act, key=lambda n: (-act[n], n))
    while len(seen) < len(order) and any(n not in seen for n in order):
        at = next(n for n in order if n not in seen)
        behind = {at}
        while before := [(-w, u) for u, v, w, _, kind in edges if v == at and kind == "Sequential" and w > 0 and u not in seen and u not in behind]:
            at = min(before)[1]
            behind.add(at)
        path = [at]
        seen.add(at)
        while len(path) < 8:
            energy = lambda v, kind: 0.05 if kind == "Sequential" and act.get(v, 0.0) == 0 else act.get(v, 0.0)
            ahead = [(-w * (1 + math.log1p(c)) * energy(v, kind), v) for u, v, w, c, kind in edges if u == at and v not in seen and v not in hidden]
            ahead = [x for x in ahead if x[0] < 0]
            if not ahead:
                break
            at = min(ahead)[1]
            path.append(at)
            seen.add(at)
        out.append(path)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_against_their_definition(spark, seed, monkeypatch):
    """Random graphs with a hub and chains of more than 12 nodes."""
    rng = random.Random(seed)
    edges = {(k, k + 1): (0.85, 0, "Sequential") for k in range(60) if k % 20 != 19}
    for _ in range(60):
        edges[rng.randrange(60), rng.randrange(60)] = (round(rng.random(), 3), rng.randrange(4), rng.choice(["Sequential", "Semantic"]))
    edges |= {(5, 100 + k): (0.5 + k / 1000, 0, "Sequential") for k in range(300)}
    plain = [(u, v, *x) for (u, v), x in edges.items() if u != v]
    active = [(n, round(rng.random(), 3)) for n in rng.sample(range(60), 12)]
    frame = spark.createDataFrame([("a", u, "a", v, w, c, kind, None) for u, v, w, c, kind in plain], EDGE)
    hidden = {7, 31}
    nodes = spark.createDataFrame([("a", k, "x + y" if k in hidden else f"node {k}") for k in range(400)], "part string, node_id long, content string")
    act = spark.createDataFrame([(1, "a", n, x) for n, x in active], "query_id long, part string, node_id long, act double")
    found = {}
    for r in paths.walks(act, frame, nodes).orderBy("path", "step").collect():
        found.setdefault(r.path, []).append(r.node_id)
    assert list(found.values()) == plain_walks(active, plain, hidden)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1700)] + [(9000, 9001 + k) for k in range(400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()) == {x: find(x) for x in list(root)}


def test_clusters_of_all_documents(spark):
    """The query against a plain pass over its own graph."""
    docs = queries._docs(spark, SF).withColumn("part", F.lit("general"))
    own = graph.chunk_graph(docs)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in own.edges.where("weight > 0.3").collect():
        a, b = sorted((find(r.src_id), find(r.dst_id)))
        root[b] = a
    members, weight = {}, {}
    for x in list(root):
        members.setdefault(find(x), []).append(x)
    for r in own.tags.where(F.col("node_id").isin(list(root)) if len(root) < 100 else F.lit(True)).collect():
        if r.node_id in root:
            key = find(r.node_id), r.tag
            weight[key] = weight.get(key, 0) + r.weight
    want = set()
    for cluster, nodes in members.items():
        if len(nodes) >= 3:
            tags = [(-w, t) for (c, t), w in weight.items() if c == cluster]
            want.add((cluster, len(nodes), min(tags)[1] if tags else f"part_{cluster}"))
    assert set(map(tuple, queries.document_clusters(spark, SF).collect())) == want


def test_creative_answers(spark):
    text = "Rust hafıza güvenliğini sağlar. Sistem hafıza kullanır. Kuantum sistemi güvenliği destekler"
    words = "hafıza güvenlik sağla sistem kullan destekle kuantum rust".split()
    stats = spark.createDataFrame([(w, 1.0, 1.0) for w in words], "word string, freq double, edge_weight double")
    own = graph.build_graph(spark.createDataFrame([(1, "hafıza", text)], DOCS), stats)
    own = own._replace(**{name: spark.createDataFrame(rows.collect(), rows.schema) for name, rows in own._asdict().items()})
    asked = spark.createDataFrame([(1, "hafıza güvenliği anlat"), (2, "hafıza nedir"), (3, "zzz hayat")], "query_id long, query string")
    turn = answers.ask(asked, own, stats)
    said = {r.query_id: r for r in turn.answers.collect()}
    assert said[1]["mode"] == "creative" and said[1].answer.startswith(("[Mod: CREATIVE", "[Mod: DETERMINISTIC FALLBACK")) and said[2].answer.startswith("[Mod: DETERMINISTIC]")
    assert said[3].answer == answers.NOTHING
    again = {r.query_id: r.answer for r in answers.ask(asked, own, stats).answers.collect()}
    assert again == {k: r.answer for k, r in said.items()}
    named = turn.activation.join(own.nodes.select("part", "node_id", "content"), ["part", "node_id"])
    lang = spark.createDataFrame([(1, "tr"), (2, "tr")], "query_id long, lang string")
    made = answers.realised_sentences(named, own, lang).where("query_id = 1").collect()
    assert made and all(r.text[0].isupper() and r.text.endswith(".") for r in made)


def test_templates_are_drawn_from_all(spark):
    shape = "[Özne] + w%d + [Eylem]-r"
    nodes = [("core_language", k, shape % k, "Concept") for k in range(700)] + [("a", 1000, "[sağla]", "Concept")]
    own = graph.Graph(spark.createDataFrame(nodes, "part string, node_id long, content string, node_type string"), None, spark.createDataFrame([], EDGE))
    active = spark.createDataFrame([(q, "a", 1000, 1.0, "[sağla]") for q in range(300)], "query_id long, part string, node_id long, act double, content string")
    lang = spark.createDataFrame([(q, "tr") for q in range(300)], "query_id long, lang string")
    got = answers.realised_sentences(active, own, lang).collect()
    drawn = {r.text for r in got}
    assert len(got) == 300 * answers.MOST_TEMPLATES and len(drawn) > 500


def test_sql_functions(spark):
    api.register_sql(spark)
    row = spark.sql("SELECT weft_folded('ĞIİş') a, weft_words('Ab I c d-e') b, weft_is_operator(' + ') c, weft_last_vowel('güvenlik') d, weft_narrow_vowel('kuş') e, weft_wide_vowel('Rust') f, weft_is_verb_stem('sağla') g").first()
    assert tuple(row) == ("giis", ["ab", "ı", "d-e"], True, "i", "u", "a", True)
    assert [r.chunk for r in spark.sql("SELECT * FROM weft_chunks('First one. Second one')").collect()] == ["First one", "Second one"]


def test_typed_text_and_pdf_pages(spark, tmp_path):
    assert files.typed_text(spark, [" one ", "two", "", "three"]).first().content == "one two"
    (tmp_path / "a.PDF").write_bytes(b"p1\fp2")
    rows = files.pdf_pages(spark, str(tmp_path), lambda raw: raw.decode().split("\f")).orderBy("page_no").collect()
    assert [(r.page_no, r.page_text) for r in rows] == [(1, "p1"), (2, "p2")]


def test_ids_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="out of range"):
        graph.chunk_graph(spark.createDataFrame([(1 << 36, "a", "Too large an id")], DOCS)).nodes.collect()
