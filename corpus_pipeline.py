"""A training corpus from raw documents: toxicity, exact and near duplicates, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``; the last has a
row for each document left, with the number and digests of its tokens.

Cases: a null text is empty in every stage and keeps its null; empty texts are equal, so exact dedup leaves one;
null ids are rows like others, below every id; of repeated rows exact dedup leaves one, and of ids that tie one
row stays; very long texts pass whole; further columns of ``documents``, whatever their names, pass through all
stages but the last, which returns its four columns only; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import bpe, decontam, exact_dedup, minmax, store, toxicity

BATCH_ROWS = 2000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stage(spark: SparkSession, number: int):
    """Drops the temporary tables of the stage before, whose result is written by now, frees what it left in the driver
    (one JVM plans hundreds of queries, and its heap grew with garbage alone), and opens a scope for this stage's tables.

    Stages' results are written with zstd, whose codec needs no direct buffers beside the executors' heap. Texts go to and from
    Python BATCH_ROWS at a time, for the operators work in blocks of 2 MB, and a batch is held several times over outside the heap."""
    store.drop_scope(f"stage {number - 1}")
    store.release(spark)
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return store.in_scope(f"stage {number}")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    with _stage(spark, 1):
        return toxicity.ordinary(docs, _table(spark, sf_dir, "labels"))


def not_copied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    with _stage(spark, 2):
        return exact_dedup.deduplicate(docs)


def not_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    with _stage(spark, 3):
        return minmax.deduplicate(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    with _stage(spark, 4):
        return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    with _stage(spark, 5):
        return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("exact dedup", not_copied),
    ("MinHash near-dedup", not_near),
    ("benchmark decontamination", not_leaked),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with store.in_scope("pipeline"):
            docs = store.write_table(made, "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
