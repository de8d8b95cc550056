"""A training-data pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and reread as the next
stage's ``docs``.  All but the last return the columns of ``documents``; in repeated columns nothing changes but
``text`` and, where a text lost lines, ``n_chars``.  Stages pass on null texts and empty tables as their operators do.

A row is a document of its own, whatever its doc_id: null and repeated ids neither take other rows with them nor keep
copies.  Stages that look for rows number them by file and place, so their ``docs`` are to be read from files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontamination, line_dedup, near_dedup, packing, quality
from quillspan.llm.queries import TOKENIZER, importable, labels
from quillspan.llm.tables import documents, settle

SHINGLE, PERCENT, SIDE, K = 5, 80, 8, 2


def _prepared(spark: SparkSession) -> None:
    """Workers find the library; few texts at a time go to them, as long ones wait on both sides."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_row", F.monotonically_increasing_id())


def _by_number(rows: DataFrame) -> DataFrame:
    """The rows as operators see them: their number is the id."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject."""
    _prepared(spark)
    return quality.accepted(docs, labels(spark, sf_dir))


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one of which nothing but white space is left goes."""
    _prepared(spark)
    cut = line_dedup.without_recurring_lines(docs)
    touched = F.size("_dropped") > 0
    cut = cut.filter(~touched | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least doc_id, a null being the greatest."""
    _prepared(spark)
    rows = _numbered(docs)
    found = near_dedup.near_duplicates(_by_number(rows), size=SHINGLE, percent=PERCENT, side=SIDE, k=K)
    groups = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    kept = groups.groupBy("component_id").agg(first).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, exact or edited."""
    _prepared(spark)
    rows = _numbered(docs)
    found = decontamination.contaminated(_by_number(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length, none across documents."""
    _prepared(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), lean=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_templates),
    ("minhash near-dedup", minhash),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
