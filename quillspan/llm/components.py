"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tables import drop, settle


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node below the least of them: the greater ones (large) or the others."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if not large:
        both = both.filter("dst < src")
    least = both.groupBy("src").agg(F.min("dst").alias("least")).withColumn("least", F.least("least", "src"))
    joined = both.join(least, "src")
    out = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    out = out.filter(joined.dst > joined.src) if large else out.unionByName(least.select("src", F.col("least").alias("dst")))
    return out.filter("src <> dst").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(src, dst)``: the least node that it can reach.

    Two joins a round on rows that are combined before they move; a node with very many links is one
    key of a join that adaptive execution can split.  Ends when a round changes nothing, which for
    n nodes takes about log n rounds.  Self-links and repeated links are allowed; nulls are ignored.
    """
    edges = links.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now, before = settle(edges, "links"), None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            break
        before = tuple(sums)
        after = settle(_stars(_stars(now, True), False), "links")
        drop(now)
        now = after
    nodes = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
