"""Tokens over time, as step functions over calendar buckets.

Texts are dated by spans.  A step function says how many tokens lie in each bucket; it has a
point wherever it may change, and the value holds until the next point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.calendar import Calendar, parse_time, truncate
from quillspan.operators.running import running_by_block
from quillspan.sources.corpora import Corpora, token_spans

STRATEGIES = (1, 2, 3)


def timedata(corpora: Corpora, by_date: bool = False) -> DataFrame:
    """Tokens per span: ``corpus, datefrom, dateto, tokens``; undated texts under null.

    ``by_date`` drops the time of day.
    """
    rows = spans(corpora, by_date)
    return rows.groupBy("corpus", "datefrom", "dateto").agg(F.sum("tokens").alias("tokens")) if by_date else rows


def spans(corpora: Corpora, by_date: bool) -> DataFrame:
    """The same as rows to be summed up later: what follows aggregates by bucket anyway."""
    rows = corpora.spans if corpora.spans is not None else token_spans(corpora.texts)
    if not by_date:
        return rows
    return rows.select("corpus", *[truncate(F.col(c), "d").alias(c) for c in ("datefrom", "dateto")], "tokens")


def in_range(rows: DataFrame, start: str | None, end: str | None, strategy: int) -> DataFrame:
    """Spans that fit the wanted range; what "fit" means depends on the strategy."""
    if not start and not end:
        return rows
    if not start or not end:
        raise ValueError("'from' and 'to' go together")
    lo, hi, hi_begins = (F.lit(t).cast("timestamp_ntz") for t in (parse_time(start), parse_time(end, end=True), parse_time(end)))
    df, dt = F.col("datefrom"), F.col("dateto")
    if strategy == 1:
        # A span holds the range if it reaches its last day, at whatever hour it ends.
        return rows.filter(((df >= lo) & (dt <= hi)) | ((df <= lo) & (dt >= hi_begins)))
    if strategy == 2:
        return rows.filter((df <= hi) & (dt >= lo))
    return rows.filter((df >= lo) & (dt <= hi))


def _changes(rows: DataFrame, value: str, cal: Calendar, groups: Sequence[str], strategy: int, edge_rule: str) -> DataFrame:
    """What each span adds at its first bucket and takes back after its last one.

    1: a span end that is not on a bucket edge moves inward, unless the span stays in one bucket.
    2: every bucket touched.  3: only spans within one bucket.
    ``edge_rule="reference"`` takes only the 31st for the end of a month.

    Undated rows give one change without a bucket; spans that do not count give none.  All cases
    sit in one generator and not in filters, so the rows are read and truncated once.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = rows.select(*groups, cal.resolve(F.col("datefrom")).alias("_df"), cal.resolve(F.col("dateto")).alias("_dt"), F.col(value).cast("bigint").alias("_n"))
    df, dt = F.col("_df"), F.col("_dt")
    rows = rows.withColumns({"_f": cal.start(df), "_t": cal.start(dt)})
    f, t, counts = F.col("_f"), F.col("_t"), F.lit(True)
    if strategy == 3:
        counts = f == t
    elif strategy == 1:
        last_of_bucket = dt == cal.next(t) - cal.smallest
        if edge_rule == "reference" and cal.granularity == "m":
            last_of_bucket = F.dayofmonth(dt) == 31
        counts = (f == t) | (df < dt)
        first = F.when((f == t) | (df == f), f).otherwise(cal.next(f))
        last = F.when((f == t) | last_of_bucket, t).otherwise(cal.previous(t))
        rows = rows.withColumns({"_f": first, "_t": last, "_counts": counts})
        counts = F.col("_counts")
    amount = F.when(f <= t, F.col("_n")).otherwise(F.lit(0).cast("bigint"))

    def change(bucket: Column, delta: Column) -> Column:
        return F.struct(bucket.alias("bucket"), delta.alias("_delta"))

    no_bucket = F.lit(None).cast("timestamp_ntz")
    undated = df.isNull() | dt.isNull()
    both = F.array(change(f, amount), change(cal.next(t), -amount))
    every = F.when(undated, F.array(change(no_bucket, F.col("_n")))).when(counts, both).otherwise(F.slice(both, 1, 0))
    return rows.select(*groups, F.inline(every)).groupBy(*groups, "bucket").agg(F.sum("_delta").alias("_delta"))


def over_time(
    rows: DataFrame, value: str, granularity: str = "y", strategy: int = 1, groups: Sequence[str] = ("corpus",), edge_rule: str = "calendar"
) -> DataFrame:
    """``*groups, bucket, <value>``: the sum of ``value`` over the spans covering each bucket.

    The running total over the changes is the step function.  What is undated has its own point
    without a bucket.
    """
    cal = Calendar(granularity)
    never = F.lit("0001-01-01").cast("timestamp_ntz")
    changes = _changes(rows, value, cal, groups, strategy, edge_rule).withColumns(
        {"_dated": F.col("bucket").isNotNull(), "_block": F.coalesce(cal.coarser(F.col("bucket")), never)}
    )
    steps = running_by_block(changes, [*groups, "_dated"], "_block", [F.col("bucket")], "_delta", value, rows_out="_points")
    # Spans that moved inward until nothing was left give a single point, and then there is none.
    return steps.filter((F.col("_points") > 1) | ~F.col("_dated")).select(*groups, "bucket", value)


def combine(rows: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """The same spans with all corpora taken together; ``corpus`` becomes ``''``."""
    others = [g for g in groups if g != "corpus"]
    out = rows.groupBy(*others, "datefrom", "dateto").agg(F.sum(value).alias(value))
    return out.withColumn("corpus", F.lit(""))


def timespan(
    corpora: Corpora,
    granularity: str = "y",
    strategy: int = 1,
    start: str | None = None,
    end: str | None = None,
    per_corpus: bool = True,
    all_corpora: bool = False,
    edge_rule: str = "calendar",
) -> DataFrame:
    """Tokens per bucket: ``corpus, time, tokens``; ``corpus = ''`` for all corpora together."""
    cal = Calendar(granularity)
    rows = in_range(spans(corpora, cal.by_date), start, end, strategy)
    parts = [rows] if per_corpus else []
    if all_corpora:
        parts.append(combine(rows, "tokens").select(*rows.columns))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    steps = over_time(both, "tokens", granularity, strategy, ("corpus",), edge_rule)
    return steps.select("corpus", time_key(cal, F.col("bucket")).alias("time"), "tokens")


def time_key(calendar: Calendar, bucket: Column) -> Column:
    return F.coalesce(calendar.key(bucket), F.lit(""))
