"""Labelled rows for the classifiers: folds by crc32 and a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm import store

#: Labelled rows that a classifier is fitted on at most (in expectation; the sample is by a hash of the id).
MAX_LABELLED = 24_000


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, label, fold) of labelled documents outside the held-out fold; held-out labels are never read on.

    A document with several labels has the largest; rows without an id or a label are left out."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    own = own.filter(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = own.count()
    if n > bound:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    own = store.broadcast_if_small(own, own.count(), 24)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(own, "doc_id").select("text", "label", fold("doc_id", folds).alias("fold"), "doc_id")
