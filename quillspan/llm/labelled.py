"""Labelled rows to learn from: never those held out, at most a stated number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, TRAIN_ROWS = 5, 20_000


def held_out(doc_id: str | Column = "doc_id", folds: int = FOLDS, fold: int = 0) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``most`` labelled rows outside the held-out fold, chosen by a hash of the id.

    Labels other than 0 and 1 count as none; of several labels of an id the greatest holds.  Only the ids of
    the chosen rows, whose number is bounded, are sent to every task.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(chosen), "doc_id")


def in_one_task(features: DataFrame) -> DataFrame:
    """The bounded training rows in one partition and a fixed order."""
    return features.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.hash("features"))
