"""Matches over time, absolute and relative to the amount of text of the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.calendar import Calendar, parse_time
from quillspan.functions.keys import per_million
from quillspan.operators.timespan import combine, in_range, over_time, time_key
from quillspan.operators.timespan import spans as text_spans
from quillspan.sources.corpora import Corpora

_UNIT = {"y": "YEAR", "m": "MONTH", "d": "DAY", "h": "HOUR", "n": "MINUTE", "s": "SECOND"}


def corpora_in_range(corpora: Corpora, start: str | None, end: str | None) -> Corpora:
    """Corpora whose dates meet the range; corpora without dates stay."""
    if not start and not end:
        return corpora
    if not start or not end:
        raise ValueError("'from' and 'to' go together")
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (parse_time(start), parse_time(end, end=True)))
    meets = (F.col("first_date") <= hi) & (F.col("last_date") >= lo)
    # One name per corpus: a list of the catalogue's size.
    names = corpora.info.filter(F.coalesce(meets, F.lit(True))).select("corpus")
    return corpora.mapped(lambda df: df.join(names, "corpus", "left_semi"))


def check_points(corpora: Corpora, granularity: str, start: str | None = None, end: str | None = None, max_points: int = 3600) -> None:
    """ValueError when the range has more than ``max_points`` buckets; for callers that want such a limit.

    Reads at most the small ``info`` table, before anything else runs.
    """
    if start and end:
        ends = corpora.info.sparkSession.range(1).select(
            F.lit(parse_time(start)).cast("timestamp_ntz").alias("first_date"), F.lit(parse_time(end, end=True)).cast("timestamp_ntz").alias("last_date")
        )
    else:
        ends = corpora.info.agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    if ends.select(_too_long(granularity, max_points)).first()[0]:
        raise ValueError("the time range is too long for this granularity; use 'from' and 'to'")


def _too_long(granularity: str, max_points: int) -> Column:
    unit = _UNIT[Calendar(granularity).granularity]
    return F.col("last_date") > F.col("first_date") + F.expr(f"INTERVAL '{max_points}' {unit}")


def too_many_points(corpora: Corpora, max_points: int = 3600) -> DataFrame:
    """``corpus, granularity, refused``: whether a trend of the whole corpus would have more points; null without dates."""
    rows = [corpora.info.select("corpus", F.lit(g).alias("granularity"), _too_long(g, max_points).alias("refused")) for g in _UNIT]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def spans_of(matches: DataFrame, calendar: Calendar) -> DataFrame:
    """Matches per dated span; ``matches`` must keep ``datefrom`` and ``dateto``."""
    by = ["query_no"] if "query_no" in matches.columns else []
    ends = [calendar.resolve(F.col(c)).alias(c) for c in ("datefrom", "dateto")]
    return matches.select("corpus", *by, *ends).groupBy("corpus", *by, "datefrom", "dateto").agg(F.count("*").alias("hits"))


def count_time(
    matches: DataFrame,
    corpora: Corpora,
    granularity: str = "y",
    strategy: int = 1,
    start: str | None = None,
    end: str | None = None,
    all_corpora: bool = False,
    max_points: int | None = None,
) -> DataFrame:
    """``corpus, [query_no,] time, absolute, relative`` for buckets that hold text.

    ``max_points`` refuses a range with more buckets; without it any range goes.

    Buckets are where the hits' step function has points.  Hits outside the range vanish with
    their bucket's token count.  With ``all_corpora`` the corpora are taken together (``''``).
    """
    cal = Calendar(granularity)
    if max_points is not None:
        check_points(corpora, granularity, start, end, max_points)
    hits, sizes = _steps(matches, corpora, cal, strategy, start, end, all_corpora)
    same = [hits["corpus"] == sizes["corpus"], hits["bucket"].eqNullSafe(sizes["bucket"])]
    by = [hits[c] for c in hits.columns if c == "query_no"]
    return (
        hits.join(sizes.filter(F.col("tokens") > 0), same)
        .select(
            hits["corpus"],
            *by,
            time_key(cal, hits["bucket"]).alias("time"),
            hits["hits"].alias("absolute"),
            per_million(hits["hits"], sizes["tokens"]).alias("relative"),
        )
    )


def _steps(matches, corpora, cal, strategy, start, end, all_corpora):
    spans = spans_of(matches, cal)
    tokens = in_range(text_spans(corpora, cal.by_date), start, end, strategy)
    by = [c for c in spans.columns if c == "query_no"]
    if all_corpora:
        spans, tokens = combine(spans, "hits", by), combine(tokens, "tokens")
    hits = over_time(spans, "hits", cal.granularity, strategy, ("corpus", *by))
    return hits, over_time(tokens, "tokens", cal.granularity, strategy)


def has_text_marks(
    corpora: Corpora, granularity: str = "y", strategy: int = 1, start: str | None = None, end: str | None = None, all_corpora: bool = False
) -> DataFrame:
    """``corpus, time, mark`` where a corpus starts (0) or stops (null) to have text.

    The undated point comes first in the order.  Points are compared with the one before inside a coarser
    unit of time; the first of each unit meets the last one before it by way of one row for each unit.
    """
    cal = Calendar(granularity)
    rows = in_range(text_spans(corpora, cal.by_date), start, end, strategy)
    if all_corpora:
        rows = combine(rows, "tokens")
    points = over_time(rows, "tokens", granularity, strategy)
    unit = cal.coarser(F.col("bucket"))
    points = points.select("corpus", time_key(cal, F.col("bucket")).alias("time"), (F.col("tokens") > 0).alias("_has"), unit.alias("_unit"))
    units = points.groupBy("corpus", "_unit").agg(F.max_by("_has", "time").alias("_last"))
    ended = F.lag("_last", 1, False).over(Window.partitionBy("corpus").orderBy(F.col("_unit").asc_nulls_first()))
    units = units.select(F.col("corpus").alias("_corpus"), F.col("_unit").alias("_of"), ended.alias("_ended"))
    points = points.join(units, (F.col("corpus") == F.col("_corpus")) & F.col("_unit").eqNullSafe(F.col("_of")))
    before = F.lag("_has", 1).over(Window.partitionBy("corpus", "_unit").orderBy("time"))
    changed = points.withColumn("_before", F.coalesce(before, "_ended")).filter(F.col("_has") != F.col("_before"))
    return changed.select("corpus", "time", F.when(F.col("_has"), F.lit(0)).cast("bigint").alias("mark"))


def with_marks(trend: DataFrame, marks: DataFrame) -> DataFrame:
    """Trend points and marks together; a point with hits wins over a mark."""
    both = marks.join(trend, ["corpus", "time"], "full")
    return both.select(
        "corpus",
        "time",
        F.coalesce("absolute", "mark").alias("absolute"),
        F.coalesce("relative", F.col("mark").cast("double")).alias("relative"),
    )


def trend_sums(trend: DataFrame, requested: Corpora) -> DataFrame:
    """Sums per requested corpus: absolute, and the sum of the buckets' relative values."""
    by = [c for c in trend.columns if c == "query_no"]
    found = trend.groupBy("corpus", *by).agg(F.sum("absolute").alias("absolute"), F.sum("relative").alias("relative"))
    return requested.info.select("corpus").join(found, "corpus", "left").fillna(0, ["absolute", "relative"])


def combined_sums(trend: DataFrame, corpora: Corpora) -> DataFrame:
    """Sums of a combined trend; relative to the size of all searched corpora."""
    by = [c for c in trend.columns if c == "query_no"]
    total = corpora.info.agg(F.sum("size").alias("total")).scalar()
    out = trend.groupBy(*by).agg(F.coalesce(F.sum("absolute"), F.lit(0)).alias("absolute"))
    return out.withColumn("relative", F.coalesce(per_million(F.col("absolute"), total), F.lit(0.0)))
