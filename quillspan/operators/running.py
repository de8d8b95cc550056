"""Running totals that never put one large group into one task.

A plain window over a corpus sorts the whole corpus in a single task.  Both functions below
cut the order into runs, aggregate every run, accumulate over the few run totals, and finish
with a window whose partition is one run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_by_block(
    df: DataFrame,
    groups: Sequence[str],
    block: str,
    order: Sequence[Column],
    value: str,
    out: str,
    merge: Callable[[Column], Column] = F.sum,
    descending: bool = False,
    rows_out: str | None = None,
) -> DataFrame:
    """Inclusive running aggregate when a coarser order key ``block`` is at hand.

    ``merge`` is ``sum``, ``min`` or ``max``.  ``descending`` accumulates from the last block
    back; ``order`` must then be descending too.  ``rows_out`` names a column for the number of
    rows of the whole group.
    """
    block_order = F.col(block).desc() if descending else F.col(block).asc()
    earlier = Window.partitionBy(*groups).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    extra = [] if rows_out is None else [F.sum("_rows").over(Window.partitionBy(*groups)).alias(rows_out)]
    carried = (
        df.groupBy(*groups, block)
        .agg(merge(F.col(value)).alias("_part"), F.count("*").alias("_rows"))
        .select(*groups, block, merge(F.col("_part")).over(earlier).alias("_carried"), *extra)
    )
    inside = Window.partitionBy(*groups, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = merge(F.col(value)).over(inside)
    if merge is F.sum:
        total = F.coalesce(F.col("_carried"), F.lit(0)) + local
    else:
        pick = F.least if merge is F.min else F.greatest
        total = pick(F.col("_carried"), local)
    return df.join(carried, [*groups, block]).withColumn(out, total).drop("_carried")


def running_by_file(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, out: str, path: str
) -> DataFrame:
    """Exclusive running sum of ``value`` within ``groups`` for an order without a coarser key.

    The rows are range-partitioned on ``(*groups, *order)`` and written; every file then is one
    consecutive run, and file numbers follow the order.  Writing fixes the run boundaries, so a
    lost executor cannot move them between the two reads.
    """
    keys = [*groups, *order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = df.sparkSession.read.schema(df.schema).parquet(path).withColumn("_run", number)
    earlier = Window.partitionBy(*groups).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*groups, "_run")
        .agg(F.sum(value).alias("_part"))
        .select(*groups, "_run", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_carried"))
    )
    inside = Window.partitionBy(*groups, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        rows.join(carried, [*groups, "_run"])
        .withColumn(out, (F.col("_carried") + local).cast("bigint"))
        .drop("_carried", "_run")
    )
