"""Values of attributes, flat or as hierarchies with one column per level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillspan.functions.keys import set_text
from quillspan.sources.corpora import Corpora


def attr_values(corpora: Corpora, path: str, split: Sequence[str] = (), with_count: bool = False) -> DataFrame:
    """Distinct values per corpus, with token counts on request.

    ``path`` names an attribute or a hierarchy such as ``text_lang>text_quality>pos``.  Tokens
    without a value count under ``''``; an empty value set has no values once it is split.
    """
    levels = path.split(">")
    positional = [a for a in levels if a in corpora.attrs]
    structural = [a for a in levels if a not in corpora.attrs]
    unknown = [a for a in structural if a not in corpora.structs]
    if unknown:
        raise KeyError(", ".join(unknown))
    if positional:
        rows = corpora.tokens(*positional, structs=structural).withColumn("_n", F.lit(1))
    else:
        rows = corpora.texts.filter(F.col("n_tokens") > 0).select("corpus", *structural, F.col("n_tokens").alias("_n"))
    for a in levels:
        if isinstance(rows.schema[a].dataType, ArrayType):
            undefined = F.array(F.lit("")) if a in split else F.lit("")
            known = F.explode(F.coalesce(a, undefined)) if a in split else F.coalesce(set_text(F.col(a)), undefined)
            rows = rows.withColumn(a, known)
        else:
            rows = rows.withColumn(a, F.coalesce(a, F.lit("")))
    if not with_count:
        return rows.select("corpus", *levels).distinct()
    return rows.groupBy("corpus", *levels).agg(F.sum("_n").alias("count"))


def merge_corpora(values: DataFrame) -> DataFrame:
    """Values over all corpora: counts add up, plain values are united."""
    levels = [c for c in values.columns if c not in ("corpus", "count")]
    if "count" in values.columns:
        return values.groupBy(*levels).agg(F.sum("count").alias("count"))
    return values.select(*levels).distinct()
