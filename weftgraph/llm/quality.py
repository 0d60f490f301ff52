"""Quality rules by hashed n-gram log-likelihood ratio, in DataFrame functions only.

Every word and word pair of a text falls in one of BUCKETS hash buckets. The buckets' counts over trusted documents and
over all documents give two smoothed multinomials; a text's score is the mean over its n-grams of the log of their ratio.
A text is kept if the base rules pass and the score is at or above a fixed threshold: no random draw.

What is collected is one weight for each bucket, a fixed number. Trusted documents are all those with label quality 1 and not
toxic. A Bloom filter of their ids, FILTER_BITS at most, is broadcast at every size; documents that it rules out stay where they are,
and only the others are merged with the ids. The raw counts cover all documents.

Defined results: a null or blank text has no words, scores 0.0 and fails the base rules; without trusted documents all
weights are 0; labels without an id or a quality mark none; repeated rows are each scored (and counted); ties don't arise, as each
text is judged alone; a very long text takes memory in proportion to its words; an empty table gives no rows; columns besides doc_id
and text, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16384
#: Pseudo-count of each bucket.
SMOOTHING = 1.0
#: Mean log ratio that a kept document reaches, in nats for each n-gram.
LEAST_SCORE = -0.1
#: Bits of the filter of trusted ids, 4 MB in maps of 4 KB: at four million ids 12 % of the other documents pass it too.
FILTER_BITS, MAP_BITS = 1 << 25, 1 << 15
BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the words, and of each word with the next (the last with the empty string)."""
    spread = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    single = F.transform(words, lambda w: spread(F.xxhash64(w)))
    pair = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: spread(F.xxhash64(a, F.coalesce(b, F.lit("")))))
    return F.concat(single, pair)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents, each once."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def _bit(doc_id: Column) -> Column:
    """The bit of an id, from 1."""
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS)) + 1


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id and text of docs with mark, 1 for trusted documents and 0 for others.

    Those that the filter lets through are merged with the trusted ids, each task's in the order of id and text's hash; all others,
    and those without an id, stay in their place.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("id"))
    maps = ids.select(_bit(F.col("id")).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("map_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("map"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("map_no", F.bitmap_bucket_number(_bit(F.col("doc_id"))))
    place = F.bitmap_bit_position(_bit(F.col("doc_id")))
    byte = F.conv(F.hex(F.substring(F.col("map"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    passes = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    # FILTER_BITS / MAP_BITS maps at most
    rows = rows.join(F.broadcast(maps), "map_no", "left").select("doc_id", "text", passes.alias("passes"))
    near = rows.where("passes").select("text", F.col("doc_id").alias("id")).repartition("id").sortWithinPartitions("id", F.xxhash64("text"))
    marks = near.join(ids.withColumn("mark", F.lit(1)).hint("merge"), "id", "left").select(F.col("id").alias("doc_id"), "text", F.coalesce("mark", F.lit(0)).alias("mark"))
    return rows.where("not passes").select("doc_id", "text", F.lit(0).alias("mark")).unionByName(marks)


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of the trusted to the raw multinomial for each bucket. Counts are summed in each task before the shuffle."""
    words = marked(docs, trusted).select(words_of(F.col("text")).alias("words"), "mark")
    counts = (
        words.select(F.explode(buckets_of(F.col("words"), buckets)).alias("bucket"), "mark")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("mark").alias("target"))
        .collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not sum(target):
        return [0.0] * buckets
    shift = math.log(sum(raw) + smoothing * buckets) - math.log(sum(target) + smoothing * buckets)
    return [math.log(t + smoothing) - math.log(r + smoothing) + shift for r, t in zip(raw, target, strict=True)]


def _repeats(docs: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in windows of WINDOW words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only texts with an equal pair sort their windows; the covered words are then the
    sum over the repeated windows' positions of the distance to the next one, WINDOW at most.
    """
    n = F.size("words")
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW))))
    docs = docs.select("*", hashes.alias("windows"))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    order = F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    docs = docs.select("*", order.alias("order")).drop("windows")
    order = F.col("order")
    before = F.concat(F.slice(order, F.size(order), 1), F.slice(order, 1, F.size(order) - 1))
    after = F.concat(F.slice(order, 2, F.size(order) - 1), F.slice(order, 1, 1))
    near = F.zip_with(order, before, lambda a, b: F.struct(a["i"].alias("i"), a["h"].alias("h"), (a["h"] == b["h"]).alias("same")))
    at = F.array_sort(F.filter(F.zip_with(near, after, lambda a, b: F.when(a["same"] | (a["h"] == b["h"]), a["i"])), lambda i: i.isNotNull()))
    docs = docs.select("*", at.alias("places")).drop("order")
    steps = F.zip_with("places", F.slice("places", 2, F.size("places")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return docs.select("*", F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words")).drop("places")


def score_documents(docs: DataFrame, weight: list[float], least: float = LEAST_SCORE) -> DataFrame:
    """One row for each row of docs: the base counts, the score, and both verdicts. A narrow map: no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    base = base.select(
        "doc_id", "words", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    base = _repeats(base)
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weight)), ",").cast("array<double>")
    total = F.aggregate(buckets_of(F.col("words"), len(weight)), F.lit(0.0), lambda acc, b: acc + table[b])
    base = base.select("*", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words"))).otherwise(F.lit(0.0)).alias("score"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= least)).alias("kept"), F.round("score", 6).alias("score"),
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, weights(docs, trusted_ids(labels)))
