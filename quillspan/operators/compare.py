"""Comparing two frequency lists by log-likelihood."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.count import key_columns
from quillspan.operators.paging import ranked
from quillspan.sources.corpora import parse_corpora


def two_sets(counts: DataFrame, set1: Iterable[str] | str, set2: Iterable[str] | str) -> DataFrame:
    """``*keys, freq1, freq2`` from one counted frame; a corpus may be in both sets."""
    keys = key_columns(counts)
    in1, in2 = F.col("corpus").isin(parse_corpora(set1)), F.col("corpus").isin(parse_corpora(set2))
    rows = counts.filter(in1 | in2).groupBy(*keys)
    return rows.agg(
        F.sum(F.when(in1, F.col("absolute")).otherwise(0)).alias("freq1"),
        F.sum(F.when(in2, F.col("absolute")).otherwise(0)).alias("freq2"),
    )


def two_queries(counts1: DataFrame, counts2: DataFrame) -> DataFrame:
    """``*keys, freq1, freq2`` from the counts of two different queries, added over corpora.

    Both lists go through one aggregation, so no key is shuffled twice.
    """
    keys = key_columns(counts1)
    zero = F.lit(0).cast("bigint")
    one = counts1.select(*keys, F.col("absolute").alias("freq1"), zero.alias("freq2"))
    two = counts2.select(*keys, zero.alias("freq1"), F.col("absolute").alias("freq2"))
    return one.unionByName(two).groupBy(*keys).agg(F.sum("freq1").alias("freq1"), F.sum("freq2").alias("freq2"))


def log_likelihood(freqs: DataFrame) -> DataFrame:
    """Adds ``loglike``: negative when the value is relatively more frequent in set 1."""
    totals = freqs.agg(F.sum("freq1").cast("double").alias("t1"), F.sum("freq2").cast("double").alias("t2"))
    t1, t2 = totals.select("t1").scalar(), totals.select("t2").scalar()
    rows = freqs.withColumns({"_t1": t1, "_t2": t2})
    f1, f2 = F.col("freq1"), F.col("freq2")
    both = f1 + f2

    def term(f: Column, total: Column) -> Column:
        expected = both * (total / (F.col("_t1") + F.col("_t2")))
        return F.when(f > 0, f * F.ln(f / expected)).otherwise(F.lit(0.0))

    ll = F.round(2 * (term(f1, F.col("_t1")) + term(f2, F.col("_t2"))), 2)
    # With no value in set 2 at all, its share is 0 and never divided.
    share2 = F.when(f2 > 0, f2 / F.col("_t2")).otherwise(F.lit(0.0))
    side1 = (f1 > 0) & ((f2 == 0) | (f1 / F.col("_t1") > share2))
    return rows.withColumns({"_ll": ll, "side": F.when(side1, 1).otherwise(2)}).select(
        *freqs.columns, "side", F.when(F.col("side") == 1, -F.col("_ll")).otherwise(F.col("_ll")).alias("loglike")
    )


def strongest(scored: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` strongest values of each side (0 keeps all), ties by value from the end."""
    if not n:
        return scored
    keys = [c for c in scored.columns if c not in ("freq1", "freq2", "side", "loglike")]
    scored = scored.withColumn("_strength", F.abs("loglike"))
    order = [F.desc("_strength"), *[F.desc(k) for k in keys]]
    return ranked(scored, ["side"], order, n - 1, "_rank").drop("_rank", "_strength")


def average(scored: DataFrame) -> DataFrame:
    """Mean strength of all values, whatever their side."""
    return scored.agg(F.coalesce(F.round(F.avg(F.abs("loglike")), 2), F.lit(0.0)).alias("average"))
