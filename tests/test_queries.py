"""Queries over small tables against their SQL."""

import duckdb
import pytest

from weftgraph.plans.registry import ORACLE, QUERIES


def rows_of(spark, name, folder, docs):
    """The rows of a query over docs (doc_id, text, lang, source), by Spark and by its SQL."""
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    found = QUERIES[name](spark, str(folder))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        wanted = db.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE[name]})").fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    return order(found.collect()), order(wanted)


@pytest.mark.parametrize("first", ["ßen und der rest", "Ist ein satz", "ärger mit worten"])
def test_a_capital_is_the_same_in_sql(spark, tmp_path, first):
    found, wanted = rows_of(spark, "document_sentences", tmp_path, [(1, f"{first}. Und noch einer", "de", "src1")])
    assert found == wanted
    assert found[0][1].startswith(first[0].upper())


def test_concepts_need_no_text_in_their_shuffles(spark):
    """Chunks of one text under many ids: what a word's row carries doesn't grow with its chunk."""
    from weftgraph.operators import morphology

    texts = spark.range(3).selectExpr("id", "repeat('kitaplar masa ', 5 + cast(id as int)) AS chunk")
    found = morphology.concepts_of(texts, morphology.no_stats(spark), ("id",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk" not in plan
    assert {r.id: r.concepts for r in found.collect()} == {k: ["kitap", "masa"] for k in range(3)}


@pytest.mark.parametrize("order", ["text", "wiki"])
def test_a_chunk_said_again_moves_its_edges_last(spark, order):
    """a b, then b a in a chunk of its own, then a b again: edges as if every chunk's events were put in one after the other."""
    from weftgraph.operators import graph, morphology

    docs = [(1, "p", "kitap yazdı kalem. kalem yazdı kitap"), (2, "p", "kitap yazdı kalem. kitap. yazdı"), (3, "q", "kalem yazdı kitap"), (4, "p", "kitap kalem")]
    own = graph.build_graph(spark.createDataFrame(docs, "doc_id long, part string, text string"), morphology.no_stats(spark), order)
    ids = {(r.part, r.content): r.node_id for r in own.nodes.collect()}
    edges = {(r.src_part, r.src_id, r.dst_id): (r.edge_type, r.role, r.weight) for r in own.edges.collect()}
    p = lambda a, b: edges.get(("p", ids["p", a], ids["p", b]))
    assert p("kitap", "[yaz]") == ("Semantic", "Özne", 0.8)
    assert p("kalem", "[yaz]") == ("Semantic", "Nesne", 0.8)
    assert p("kitap", "kalem") == ("Sequential", None, 0.85)
    assert p("[yaz]", "kalem") == ("Sequential", None, 0.85)


def test_nodes_without_edges_are_the_graphs_nodes(spark):
    from weftgraph.operators import graph, morphology

    docs = spark.createDataFrame([(1, "p", "evler kitap yazdı. evler kitap yazdı; a = b"), (2, "q", "evler kitap yazdı")], "doc_id long, part string, text string")
    own = graph.build_graph(docs, morphology.no_stats(spark))
    nodes, tags = graph.build_nodes(docs, morphology.no_stats(spark))
    assert sorted(nodes.collect()) == sorted(own.nodes.collect())
    assert sorted(tags.collect()) == sorted(own.tags.collect())


def test_tables_made_on_the_way_go(spark):
    from weftgraph.session import settled, written

    shuffled = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = spark.conf.get(shuffled, "false"), []
    out = settled(spark, lambda: kept.append(written(spark.range(9), "way")) or kept[0].where("id > 5"), "end")
    assert sorted(r.id for r in out.collect()) == [6, 7, 8]
    assert spark.conf.get(shuffled, "false") == before
    with pytest.raises(Exception, match="(?i)path|exist|found"):
        kept[0].collect()
