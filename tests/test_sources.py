"""Dumps in pieces, PDFs in a folder, and the SQL surface."""

import bz2

from pyspark.sql import functions as F

from weftgraph import api
from weftgraph.operators import graph, morphology
from weftgraph.sources import files, store

DOCS = "doc_id long, part string, text string"


def test_a_dump_is_read_in_pieces(spark, tmp_path):
    """One file by many tasks, in order, with broken pages among the others; the same compressed, and with a header and attributes."""
    page = lambda k, text: f'<page>\n<title>Title {k % 150}</title><ns>0</ns>\n<revision><id>1</id><text xml:space="preserve">{text}</text></revision></page>\n'
    body = "A &amp; B &lt;i&gt;said&lt;/i&gt; it, and then they went on at some length about it all. " * 3
    rows = [page(k, f"{body} number {k}.") for k in range(300)]
    rows.insert(7, "<page><title>Broken</title><revision><text>no end")
    text = "<mediawiki><siteinfo><sitename>x</sitename></siteinfo>\n" + "".join(rows) + "</mediawiki>"
    (tmp_path / "d.xml").write_text(text)
    (tmp_path / "d2.xml.bz2").write_bytes(bz2.compress(text.encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        found = files.wiki_pages(spark, f"{tmp_path}/d.xml")
        assert found.rdd.getNumPartitions() > 5
        docs = files.wiki_documents(found).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    zipped = files.wiki_documents(files.wiki_pages(spark, f"{tmp_path}/d2.xml.bz2")).collect()
    said = {r.part: r.text for r in docs}
    assert said == {r.part: r.text for r in zipped} and len(said) == 150
    assert all(said[f"title_{k}"].endswith(f"number {k + 150}.") for k in range(150)) and "A & B" in said["title_3"]


def test_folder_with_pdfs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Plain text stands here.")
    (tmp_path / "in" / "b.pdf").write_bytes(b"The first page has this.\fThe second page has that.")
    at = f"file://{tmp_path}/graph"
    registry = api.ingest_folder(spark, str(tmp_path / "in"), at, read_pages=lambda raw: raw.decode().split("\f"))
    assert registry.count() == 2
    said = {r.content for r in store.load_graph(spark, at).nodes.collect()}
    assert {"Plain text stands here", "The first page has this", "The second page has that"} <= said


def test_chunks_of_any_length(spark):
    """A chunk of 400 words: each concept has a node of its own."""
    words = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400))
    docs = spark.createDataFrame([(1, "a", words), (2, "a", words.replace("worda", "otha") + " wordaa"), (3, "a", "wordba")], DOCS)
    own = graph.build_graph(docs, morphology.no_stats(spark), chunker=lambda text: F.array(text))
    nodes = own.nodes.where("part = 'a'").collect()
    assert len({r.node_id for r in nodes}) == len(nodes) == len({r.content for r in nodes}) > 400
    ids = {r.content: r.node_id for r in nodes}
    ends = {(r.src_id, r.dst_id) for r in own.edges.where("src_part = 'a' and edge_type = 'Sequential'").collect()}
    assert (ids["wordfa"], ids["wordfb"]) in ends and (ids["wordok"], ids["wordol"]) in ends


def test_sql_says_what_the_columns_say(spark):
    api.register_sql(spark)
    text = "Bir cümle. kısa; " + " ".join(f"kelime{k}" for k in range(60)) + "! son" + "u" * 200
    docs = spark.createDataFrame([(1, "a", text), (2, "a", None), (3, "a", "")], DOCS)
    got = sorted(map(tuple, spark.sql("SELECT d.doc_id, pos, chunk FROM {docs} AS d, LATERAL weft_chunks(d.text)", docs=docs).collect()))
    assert got == sorted(map(tuple, graph.chunked(docs).select("doc_id", "pos", "chunk").collect()))
    said = spark.sql("SELECT weft_with_case('güvenlik', '-i') a, weft_with_case('Rust', '-in') b, weft_with_tense('et', '-r') c, weft_with_copula('kuş') d").first()
    assert tuple(said) == ("güvenliği", "Rust'ın", "eder", "kuştur")
    words = spark.createDataFrame([("sistemler",), ("sağlar",)], "word string")
    api.register_words(spark, words, spark.createDataFrame([("sistem", 1.0, 1.0)], "word string, freq double, edge_weight double"))
    got = spark.sql("SELECT word, s.stem, s.suffix, v.verb, v.tense FROM weft_stems s LEFT JOIN weft_verbs v USING (word) ORDER BY word").collect()
    assert [(r.word, r.verb, r.tense) for r in got] == [("sağlar", "sağla", "-r"), ("sistemler", None, None)] and got[1].stem == "sistem"
