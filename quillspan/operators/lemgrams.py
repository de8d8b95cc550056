"""Index of lemgrams: how often each occurs, as a whole, as a prefix, as a suffix."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.sources.corpora import parse_corpora

# Where a token stands: not part of what is counted.
_PLACE = ("text_id", "sent_no", "sent_off", "i")

_COLUMNS = {"lemgram": "freq", "prefix": "freq_prefix", "suffix": "freq_suffix"}


def lemgram_index(tokens: DataFrame, lemgrams: Column, prefixes: Column, suffixes: Column) -> DataFrame:
    """``corpus, lemgram, freq, freq_prefix, freq_suffix`` from three set-valued columns over the attributes of a token.

    Equal tokens are added up, wherever they stand, before they take their entries.
    """
    attributes = [c for c in tokens.columns if c not in _PLACE]
    tokens = tokens.groupBy(*attributes).agg(F.count("*").alias("_n"))

    def entries(values: Column, kind: str) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("lemgram"), F.lit(kind).alias("_kind")))

    every = F.concat(*[entries(v, k) for v, k in ((lemgrams, "lemgram"), (prefixes, "prefix"), (suffixes, "suffix"))])
    rows = tokens.select("corpus", "_n", F.inline(every))
    none = F.lit(0).cast("bigint")
    return rows.groupBy("corpus", "lemgram").agg(*[F.sum(F.when(F.col("_kind") == k, F.col("_n")).otherwise(none)).alias(c) for k, c in _COLUMNS.items()])


def lemgram_count(index: DataFrame, lemgrams: Iterable[str], corpora: Iterable[str] | str | None = None, count: Iterable[str] = ("lemgram",)) -> DataFrame:
    """Sum of the chosen frequencies of each lemgram that occurs at all; exact spelling."""
    wanted = sorted(set(count))
    if not wanted or any(c not in _COLUMNS for c in wanted):
        raise ValueError(f"count is any of {', '.join(_COLUMNS)}")
    rows = index.filter(F.col("lemgram").isin(sorted(set(lemgrams))))
    if corpora:
        rows = rows.filter(F.col("corpus").isin(parse_corpora(corpora)))
    total = sum((F.col(_COLUMNS[c]) for c in wanted[1:]), F.col(_COLUMNS[wanted[0]]))
    return rows.groupBy("lemgram").agg(F.sum(total).alias("freq")).filter(F.col("freq") > 0)
