"""The engine as a user sees it: build a graph, ask, let it learn, maintain it; and its functions in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.turkish import NARROW_VERBS, VERB_STEMS
from weftgraph.operators import learning, morphology, pages, routing
from weftgraph.operators.answers import Turn, ask
from weftgraph.operators.graph import Graph, build_graph, merged, word_stats
from weftgraph.session import scratch, written
from weftgraph.sources import files, store

__all__ = ["Chunker", "Graph", "Turn", "add_documents", "ask", "ask_store", "build_graph", "ingest_documents", "ingest_dump", "ingest_folder", "maintain", "reinforce", "register_sql", "register_words"]


class Chunker(Protocol):
    """Cuts a text column into an array of chunks; build_graph takes one."""

    def __call__(self, text: Column) -> Column: ...


def add_documents(graph: Graph, docs: DataFrame, chunker: Chunker | None = None) -> Graph:
    """graph with docs (doc_id, part, text) added; chunks of documents without a part go where they are routed to."""
    stats = written(word_stats(graph.nodes, graph.edges), "stats", small=True)
    return merged(graph, build_graph(docs, stats, chunker=chunker, parts=routing.catalog(graph.nodes)))


def _stored_index(spark: SparkSession, graph_path: str) -> routing.Index:
    return lambda stems: store.load_index(spark, graph_path, stems)


def ingest_documents(docs: DataFrame, graph_path: str) -> None:
    """Add docs (doc_id, part, text) to the graph at graph_path, of which only the affected buckets are read and written anew. Word
    statistics and the routing index are those that the store keeps."""
    spark = docs.sparkSession
    with scratch(spark):
        parts = store.load_catalog(spark, graph_path).where(~F.col("part").isin(*T.RESERVED_PARTS))
        stats = written(store.load_stats(spark, graph_path), "stats", small=True)
        store.add_to_store(build_graph(docs, stats, parts=parts, index=_stored_index(spark, graph_path)), graph_path)


def ask_store(queries: DataFrame, graph_path: str, spike: bool = True) -> Turn:
    """Answer queries (query_id, query) from the graph at graph_path: only the buckets of the parts that they are routed to, and of
    the resident ones, are read."""
    spark = queries.sparkSession
    parts = store.load_catalog(spark, graph_path).where(~F.col("part").isin(*T.RESERVED_PARTS))
    stats, index = written(store.load_stats(spark, graph_path), "stats", small=True), _stored_index(spark, graph_path)
    routed = routing.route(queries, parts, stats, index=index).select("part").union(spark.createDataFrame([(p,) for p in T.RESERVED_PARTS], "part string"))
    own = store.load_graph(spark, graph_path, only=store.buckets_of(routed, store.current_version(spark, graph_path)))
    return ask(queries, own, stats, spike, parts, index)


def ingest_folder(
    spark: SparkSession, folder: str, graph_path: str, registry: DataFrame | None = None, read_pages: Callable[[bytes], list[str]] | None = None
) -> DataFrame:
    """Add the folder's new and changed text files, and with read_pages its PDFs, to the graph at graph_path; the updated registry.

    read_pages gives the texts of a PDF's pages; they are cleaned, and follow each other as one document. What a changed file said
    before stays.
    """
    registry = files.empty_registry(spark) if registry is None else registry
    found = files.text_files(spark, folder)
    if read_pages:
        found = found.unionByName(pages.running_text(files.pdf_pages(spark, folder, read_pages)))
    docs = written(files.file_documents(files.changed_files(found, registry), registry), "docs", small=True)
    if not docs.isEmpty():
        ingest_documents(docs, graph_path)
    return files.updated_registry(registry, docs)


def ingest_dump(spark: SparkSession, dump: str, graph_path: str) -> DataFrame:
    """Read a wiki dump (.xml or .xml.bz2) into the graph at graph_path, a part for each page, in place of a part of its name; how
    many pages were processed and skipped, one row."""
    pages = written(files.wiki_pages(spark, dump), "pages", small=True)
    with scratch(spark):
        docs = files.numbered(files.wiki_documents(pages), "part")
        store.add_to_store(build_graph(docs, written(store.load_stats(spark, graph_path), "stats", small=True), order="wiki"), graph_path, replace_parts=True)
    return files.page_counts(pages)


def reinforce(graph: Graph, activation: DataFrame) -> Graph:
    """graph after one query whose activation this is."""
    return graph._replace(edges=learning.reinforced(graph.edges, activation))


def maintain(graph: Graph) -> Graph:
    """Consolidate, decay and prune edges, then give strong clusters of the general part parts of their own."""
    return learning.repartitioned(graph._replace(edges=learning.consolidated(graph.edges)))


#: Pieces of sentences; of a long one the words, one after the other, packed into chunks of 150 bytes.
_CHUNKS = r"""flatten(transform(filter(transform(split(text, r'[.?!\n;]'), p -> regexp_replace(p, r'(?U)^\s+|\s+$', '')), p -> octet_length(p) >= 5),
    p -> CASE WHEN octet_length(p) <= 150 THEN array(p) ELSE aggregate(filter(split(p, r'(?U)\s+'), w -> w <> ''), named_struct('done', CAST(array() AS ARRAY<STRING>), 'open', ''),
      (a, w) -> CASE WHEN a.open = '' THEN named_struct('done', a.done, 'open', w) WHEN octet_length(a.open) + octet_length(w) + 1 > 150 THEN named_struct('done', array_append(a.done, a.open), 'open', w)
        ELSE named_struct('done', a.done, 'open', concat(a.open, ' ', w)) END, a -> CASE WHEN a.open = '' THEN a.done ELSE array_append(a.done, a.open) END) END))"""
SQL_FUNCTIONS = (
    "weft_lower_tr(text STRING) RETURNS STRING RETURN lower(translate(text, 'İI', 'iı'))",
    "weft_last_vowel(word STRING) RETURNS STRING RETURN nullif(CASE lower(word) WHEN 'rust' THEN 'a' WHEN 'wgpu' THEN 'u' ELSE translate(regexp_extract(word, '([aeıioöuüAEIİOÖUÜ])[^aeıioöuüAEIİOÖUÜ]*$', 1), 'AEIİOÖUÜ', 'aeıioöuü') END, '')",
    "weft_narrow_vowel(word STRING) RETURNS STRING RETURN CASE WHEN weft_last_vowel(word) IN ('a', 'ı') THEN 'ı' WHEN weft_last_vowel(word) IN ('o', 'u') THEN 'u' WHEN weft_last_vowel(word) IN ('ö', 'ü') THEN 'ü' ELSE 'i' END",
    "weft_wide_vowel(word STRING) RETURNS STRING RETURN CASE WHEN weft_last_vowel(word) IN ('a', 'ı', 'o', 'u') THEN 'a' ELSE 'e' END",
    "weft_is_verb_stem(word STRING) RETURNS BOOLEAN RETURN weft_lower_tr(word) IN (" + ", ".join(f"'{v}'" for v in VERB_STEMS) + ")",
    "weft_folded(text STRING) RETURNS STRING RETURN translate(weft_lower_tr(text), 'ığüşöçĞÜŞÖÇ', 'igusocGUSOC')",
    r"weft_words(text STRING) RETURNS ARRAY<STRING> RETURN filter(split(weft_lower_tr(text), r'[^\p{IsAlphabetic}_$-]'), w -> octet_length(w) > 1)",
    "weft_is_operator(text STRING) RETURNS BOOLEAN RETURN trim(text) IN ('+', '-', '*', '/', '=')",
    r"weft_is_equation(text STRING) RETURNS BOOLEAN RETURN contains(text, '=') OR (length(regexp_replace(text, r'[^+*/-]', '')) >= 2 AND text RLIKE '[0-9]')",
    r"weft_single_blanks(text STRING) RETURNS STRING RETURN trim(regexp_replace(text, r'(?U)\s+', ' '))",
    r"weft_plain_html(text STRING) RETURNS STRING RETURN weft_single_blanks(regexp_replace(regexp_replace(text, r'(?s)<!--.*?(-->|\z)', ''), r'(?s)<[^>]*(>|\z)|>', ''))",
    f"weft_chunk_list(text STRING) RETURNS ARRAY<STRING> RETURN {_CHUNKS}",
    f"weft_chunks(text STRING) RETURNS TABLE (pos INT, chunk STRING) RETURN SELECT pos, chunk FROM (SELECT posexplode({_CHUNKS}) AS (pos, chunk))",
    "weft_dental(word STRING) RETURNS STRING RETURN CASE WHEN word RLIKE '[fstkçşhpFSTKÇŞHP]$' THEN 't' ELSE 'd' END",
    "weft_link(word STRING, letter STRING) RETURNS STRING RETURN CASE WHEN word RLIKE '[aeıioöuüAEIİOÖUÜ]$' THEN letter ELSE '' END",
    """weft_case_ending(word STRING, ending STRING) RETURNS STRING RETURN CASE ending WHEN '-i' THEN weft_link(word, 'y') || weft_narrow_vowel(word) WHEN '-e' THEN weft_link(word, 'y') || weft_wide_vowel(word)
    WHEN '-de' THEN weft_dental(word) || weft_wide_vowel(word) WHEN '-den' THEN weft_dental(word) || weft_wide_vowel(word) || 'n' WHEN '-in' THEN weft_link(word, 'n') || weft_narrow_vowel(word) || 'n'
    WHEN '-ler' THEN 'l' || weft_wide_vowel(word) || 'r' ELSE '' END""",
    r"""weft_with_case(word STRING, ending STRING) RETURNS STRING RETURN CASE WHEN word = '' THEN word WHEN word RLIKE r'^\p{Lu}|\p{N}|[wqxWQX]' THEN concat(word, chr(39), weft_case_ending(word, ending))
    WHEN ending IN ('-i', '-e', '-in') AND NOT word RLIKE '[aeıioöuüAEIİOÖUÜ]$' THEN concat(left(word, length(word) - 1), translate(right(word, 1), 'ktpç', 'ğdbc'), weft_case_ending(word, ending))
    ELSE concat(word, weft_case_ending(word, ending)) END""",
    """weft_with_tense(verb STRING, ending STRING) RETURNS STRING RETURN CASE WHEN ending = '-meli' THEN concat(verb, CASE WHEN weft_wide_vowel(verb) = 'a' THEN 'malı' ELSE 'meli' END)
    WHEN ending = '-di' THEN concat(verb, weft_dental(verb), weft_narrow_vowel(verb)) WHEN verb RLIKE '[aeıioöuü]$' THEN concat(verb, 'r') WHEN verb = 'et' THEN 'eder'
    ELSE concat(verb, CASE WHEN length(regexp_replace(verb, '[^aeıioöuüAEIİOÖUÜ]', '')) > 1 OR verb IN (""" + ", ".join(f"'{v}'" for v in NARROW_VERBS) + """) THEN weft_narrow_vowel(verb) ELSE weft_wide_vowel(verb) END, 'r') END""",
    "weft_with_copula(word STRING) RETURNS STRING RETURN CASE WHEN word = '' THEN word ELSE concat(word, weft_dental(word), weft_narrow_vowel(word), 'r') END",
)


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions: SELECT weft_folded(name), weft_with_case(word, '-de'), and SELECT * FROM docs, LATERAL weft_chunks(text)."""
    for text in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


def register_words(spark: SparkSession, words: DataFrame, stats: DataFrame) -> None:
    """Temporary views of words (word), to be joined in SQL: weft_stems (word, stem, suffix) and weft_verbs (word, verb, tense)."""
    written(morphology.noun_stems(words, stats), "stems", small=True).createOrReplaceTempView("weft_stems")
    written(morphology.verbs(words, stats), "verbs", small=True).createOrReplaceTempView("weft_verbs")
