"""Which parts a query goes to, and the tags it goes with, weighted by how few parts know a word.

queries  query_id, query
parts    part: the catalog

A stem of more than four bytes also matches what it begins, so the catalog is turned into an index of beginnings, and the match is an
equi-join instead of a comparison of every stem with every part. A store keeps that index; whoever has one passes index, which gives
the rows for stems (stem), and no index is made of all parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import morphology

MOST_PARTS = 15
SHORT_STEM = 4
SYNONYM_SHARE = 0.8
#: Words and what else they ask for.
SYNONYMS = (
    (("başlat", "çalıştır", "yap"), ("run", "start", "execute", "main", "init")),
    (("kodla", "yaz", "oluştur"), ("code", "write", "create", "struct", "fn")),
    (("göster", "yazdır", "bas"), ("print", "println", "show", "display")),
)


def catalog(nodes: DataFrame) -> DataFrame:
    return nodes.select("part").distinct().where(~F.col("part").isin(*T.RESERVED_PARTS))


def part_index(parts: DataFrame) -> DataFrame:
    """(key, part): the components of part names, and their beginnings of more than SHORT_STEM bytes."""
    names = parts.select("part", F.explode(F.split(T.folded(F.col("part")), "_")).alias("name")).distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))
    keys = F.filter(cuts, lambda k: (k == F.col("name")) | (F.octet_length(k) > SHORT_STEM))
    return names.where("name <> ''").select("part", F.explode(keys).alias("key")).distinct()


def stems_of(words: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, stem): what each of words (word) is matched by."""
    found = words.select("word").distinct().withColumn("plain", T.folded(F.col("word")))
    stems = morphology.noun_stems(found.select(F.col("plain").alias("word")), stats)
    return found.join(stems.select(F.col("word").alias("plain"), T.folded(F.col("stem")).alias("stem")), "plain").select("word", "stem").where("stem <> ''")


def rarity(matches: Column, parts: Column) -> Column:
    """1 for a word that no part knows, less the more do."""
    return 1.0 / (1.0 + matches / F.greatest(parts, F.lit(1)) + F.log(matches + 1.0))


def matches(stems: DataFrame, index: DataFrame) -> DataFrame:
    """(stem, n): how many parts match, 0 included."""
    found = stems.select("stem").distinct().join(index.withColumnRenamed("key", "stem"), "stem", "left")
    return found.groupBy("stem").agg(F.countDistinct("part").alias("n"))


def _with_count(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.crossJoin(parts.agg(F.countDistinct("part").alias("parts")))  # one row


Index = Callable[[DataFrame], DataFrame]


def query_tags(queries: DataFrame, parts: DataFrame, stats: DataFrame, index: Index | None = None) -> DataFrame:
    """(query_id, tag, weight): each query's words by rarity, synonyms at SYNONYM_SHARE of it, the heaviest at 1.

    A word that occurs again adds up; a synonym counts only if its tag wasn't there before.
    """
    words = queries.select("query_id", F.posexplode(T.words_of(F.col("query"))).alias("pos", "word"))
    stems = stems_of(words, stats)
    found = _with_count(matches(stems, index(stems) if index else part_index(parts)), parts)
    heavy = stems.join(found, "stem").select("word", rarity(F.col("n"), F.col("parts")).alias("a"))
    words = words.join(heavy, "word", "left").select("query_id", "pos", "word", F.coalesce("a", F.lit(1.0)).alias("a"))
    also = F.create_map(*[x for given, asked in SYNONYMS for w in given for x in (F.lit(w), F.array(*map(F.lit, asked)))])
    own = words.select("query_id", F.col("word").alias("tag"), F.struct("pos", F.lit(0).alias("rank")).alias("ord"), F.lit(True).alias("is_word"), "a")
    more = words.select("query_id", F.explode(F.try_element_at(also, F.col("word"))).alias("tag"), F.struct("pos", F.lit(1).alias("rank")).alias("ord"), F.lit(False).alias("is_word"), (F.col("a") * SYNONYM_SHARE).alias("a"))
    summed = own.unionByName(more).groupBy("query_id", "tag").agg(
        F.sum(F.when(F.col("is_word"), F.col("a")).otherwise(0.0)).alias("words"), F.min_by(F.struct("is_word", "a"), "ord").alias("first")
    )
    weight = F.col("words") + F.when(F.col("first.is_word"), 0.0).otherwise(F.col("first.a"))
    return summed.select("query_id", "tag", (weight / F.max(weight).over(Window.partitionBy("query_id"))).alias("weight"))


def route(queries: DataFrame, parts: DataFrame, stats: DataFrame, most: int = MOST_PARTS, index: Index | None = None) -> DataFrame:
    """(query_id, part, score, rank): the best parts for each query by the summed rarity of its stems; `general` if none matches."""
    words = queries.select("query_id", F.explode(T.routing_words(F.col("query"))).alias("word"))
    stems = words.join(stems_of(words, stats), "word").select("query_id", "stem").distinct()
    names = index(stems) if index else part_index(parts)
    heavy = _with_count(matches(stems, names), parts).select("stem", rarity(F.col("n"), F.col("parts")).alias("a"))
    scored = stems.join(names.withColumnRenamed("key", "stem"), "stem").join(heavy, "stem").groupBy("query_id", "part").agg(F.sum("a").alias("score"))
    # ties by name: sums of the same numbers in another order differ in their last bits
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "part")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("query_id", "part", "score", "rank")
    none = queries.select("query_id").join(ranked, "query_id", "left_anti")
    return ranked.unionByName(none.select("query_id", F.lit("general").alias("part"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")))


def matched_parts(queries: DataFrame, parts: DataFrame, stats: DataFrame) -> DataFrame:
    """As route, but without the default part."""
    return route(queries, parts, stats).where("score > 0")
