"""Tables that several registered queries share, built once per application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import alignment, lemgrams, relations
from quillspan.operators.relations import WordPictures
from quillspan.session import shared_folder
from quillspan.sources.corpora import Corpora, prepare

_BUILT: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


def word_pictures(spark: SparkSession, sf_dir: str) -> WordPictures:
    text = prepare(spark, sf_dir, "text")
    path = _once(spark, sf_dir, "relations", lambda p: relations.write_tables(relations.adjacency(text), p))
    return relations.read_tables(spark, path)


def sentence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the sentences of a user's turn and those of the answer."""
    both = prepare(spark, sf_dir, "conversation")

    def build(path: str) -> None:
        links = alignment.by_sentence_order(both.select("CONV-USER"), both.select("CONV-ASSISTANT"))
        links.repartitionByRange("corpus", "first").sortWithinPartitions("corpus", "first").write.mode("overwrite").parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, "links", build))


def lemgram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = prepare(spark, sf_dir, "text")
    path = _once(spark, sf_dir, "lemgrams", lambda p: _build_index(text).write.mode("overwrite").parquet(p))
    return spark.read.parquet(path)


def _build_index(text: Corpora) -> DataFrame:
    """Lemgrams are the values of ``lex``; prefixes and suffixes the outer three letters of longer words."""
    none = F.array().cast("array<string>")
    longer = (F.length("lemma") > 3) & (F.col("pos") != "NUM")
    prefix = F.when(longer, F.array(F.substring("lemma", 1, 3))).otherwise(none)
    suffix = F.when(longer, F.array(F.right("lemma", F.lit(3)))).otherwise(none)
    return lemgrams.lemgram_index(text.tokens("lemma", "pos", "lex"), F.col("lex"), prefix, suffix)
