"""The training-data pipeline over documents: language, near duplicates, benchmark passages, personal data, token ids.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of documents. Stages are
written as Parquet in the shared folder and read again, so a lost executor costs only the running stage. Stages with Python workers
make the session hand them small batches, so that long rows don't fill an executor.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontaminate, jaccard, langid, pii, queries
from weftgraph.session import in_small_batches, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty. The model learns from those of docs that are not held out.

    Texts that are null or without a letter go; repeated rows stay each; all columns stay, whatever their names; no rows give none.
    """
    in_small_batches(spark)
    return langid.identified(docs, langid.learn(docs.where(~langid.held_out(docs.doc_id))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that of the least id, of equal rows one; a null text is a group of its own."""
    in_small_batches(spark)
    return jaccard.first_of_each_class(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none."""
    in_small_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the new text, and is null where that is."""
    return pii.pseudonymise(docs, queries.pseudonym_key(spark), counts=False).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text: one row for each document; a null text counts as empty, with no ids."""
    in_small_batches(spark)
    return bpe.token_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("pii", personal_data),
    ("token_ids", token_ids),
]

#: Language models, edit distances and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
