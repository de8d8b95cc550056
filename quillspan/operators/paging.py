"""Pages of ordered rows, ``start`` to ``end`` both included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.running import running_by_file
from quillspan.session import new_path

# Fixed value: greatest number of rows per call, unless the caller sets another.
MAX_ROWS = 1000

# A page that ends within so many rows is found with per-task top-k lists.
NEAR = 10_000

# Ranks up to this are cut per task before rows of a group meet.
FEW = 1000


def check_page(start: int, end: int, max_rows: int = MAX_ROWS) -> None:
    """ValueError unless the page has at most ``max_rows`` rows."""
    if start < 0 or end < start:
        raise ValueError(f"bad page {start}..{end}")
    if end - start >= max_rows:
        raise ValueError(f"at most {max_rows} rows per call")


def beyond_cap(hits: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``corpus, hits, refused``: whether all matches of a corpus are more than one call returns."""
    return hits.select("corpus", "hits", (F.col("hits") > max_rows).alias("refused"))


def page(df: DataFrame, order: Sequence[Column], start: int = 0, end: int = 9) -> DataFrame:
    """Rows ``start..end`` of ``df`` in a total order of named columns; ``end = -1`` means to the last."""
    if start < 0 or (end != -1 and end < start):
        raise ValueError(f"bad page {start}..{end}")
    if end == -1 and start == 0:
        return df
    if 0 <= end < NEAR:
        return df.orderBy(*order).offset(start).limit(end - start + 1)
    # Far down the order: sort into files, count per file, and rank only by file.
    rows = df.withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    ranked = running_by_file(rows, ["_all"], order, "_one", "_rank", new_path(df.sparkSession, "pages"))
    wanted = F.col("_rank") >= start
    if end != -1:
        wanted = wanted & (F.col("_rank") <= end)
    return ranked.filter(wanted).drop("_all", "_one", "_rank")


def settled(page_rows: DataFrame) -> DataFrame:
    """The page written to the shared folder and read back.

    Positions, texts around and context are looked up for the same page one after the other.
    Without this, each look-up would search the whole corpus for the page again.
    """
    path = new_path(page_rows.sparkSession, "pages")
    page_rows.write.mode("overwrite").parquet(path)
    return page_rows.sparkSession.read.schema(page_rows.schema).parquet(path)


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[Column], last: int, out: str = "rank") -> DataFrame:
    """Rows that come up to place ``last`` (from 0; -1 for all) of their group, with their place; the order is total.

    Few places are cut in every task before a group meets in one.  Else the rows are sorted into files, counted by
    file and numbered in their file, so that no task holds a group.
    """
    if 0 <= last < FEW:
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
        return df.withColumn(out, place).filter(F.col(out) <= last)
    rows = running_by_file(df.withColumn("_one", F.lit(1)), groups, order, "_one", out, new_path(df.sparkSession, "ranks")).select(*df.columns, out)
    return rows if last == -1 else rows.filter(F.col(out) <= last)


def numbered(page_rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the rows of one page from 0 in column ``row``; the page itself is bounded."""
    return page_rows.withColumn("row", F.row_number().over(Window.orderBy(*order)) - 1)


def corpora_on_page(hits: DataFrame, start: int, end: int) -> DataFrame:
    """Which rows of which corpus lie on the page: ``corpus, first, last`` (0-based, inclusive).

    ``hits`` has one row per corpus, so its single window is as small as the catalogue.
    """
    earlier = Window.orderBy("corpus").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("hits").over(earlier), F.lit(0))
    spans = hits.select("corpus", "hits", before.alias("_before")).select(
        "corpus",
        F.greatest(F.lit(start) - F.col("_before"), F.lit(0)).alias("first"),
        F.least(F.lit(end) - F.col("_before"), F.col("hits") - 1).alias("last"),
    )
    return spans.filter(F.col("first") <= F.col("last"))
