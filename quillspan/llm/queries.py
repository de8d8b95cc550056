"""The operators applied to the whole driver tables, under the names of their result contracts."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import collocations, decontamination, fingerprints, hard_negatives, language_model, line_dedup, near_dedup, packing, quality, substring_dedup, token_counts, token_files, toxicity
from quillspan.llm.oracle import ORACLE as ORACLE
from quillspan.llm.tables import documents

TOKENIZER = "byte_bpe_50k.json"


def importable(spark: SparkSession) -> None:
    """Python workers import this library from where the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return language_model.score_documents(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), keep_ids=False, cache_cuts=1_200_000).drop("ids")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items of which they hold a copy, exact or edited."""
    importable(spark)
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its recurring lines."""
    importable(spark)
    out = line_dedup.without_recurring_lines(documents(spark, sf_dir))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.size("_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line's end counts where most of its bytes are."""
    importable(spark)
    return token_counts.section_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return collocations.collocations(documents(spark, sf_dir))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids lie in the files, and their checksum as read back."""
    importable(spark)
    path = token_files.write_ids(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), cache_cuts=1_200_000)
    return token_files.read_ids(spark, path, keep_ids=False).drop("ids")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are shifted by one, as noise; every hundredth id is an anchor."""
    importable(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_lm_scoring, op3_packing, op4_fingerprints, op5_suffix_dedup, op6_decontamination, op7_toxicity,
        op8_line_dedup, op9_quality, op10_token_counts, op11_collocations, op12_token_files, op13_hard_negatives,
    )
}
