"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
``ingest_*`` is the one-off preparation of the corpus tables; every query reads them afterwards.  ``value`` is the
time of the queries, ``with_ingest`` that of everything.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillspan.registry import tables
from quillspan.registry.queries import QUERIES
from quillspan.sources.corpora import KINDS, prepare

HEADLINE = [
    "corpus_info_totals", "count_all", "attr_values_count",
    "pred_contains", "match_sequence", "match_gap", "match_open_gap", "match_within_text", "match_unbounded_region",
    "match_free_order", "match_chain_spans",
    "kwic_words", "kwic_sort_left", "kwic_page", "kwic_page_deep",
    "count_word", "count_ngram", "count_split", "count_relative_to", "count_statistics", "count_subqueries",
    "timespan_year", "timespan_second", "count_time", "count_time_marks",
    "loglike_top", "relations_top", "relation_kwic", "lemgram_count",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    for kind in KINDS:
        timed(f"ingest_{kind}", lambda: prepare(spark, sf_dir, kind))
    timed("ingest_relations", lambda: tables.word_pictures(spark, sf_dir))
    timed("ingest_lemgrams", lambda: tables.lemgram_index(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = sum(v for k, v in seconds.items() if not k.startswith("ingest_"))
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    whole = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(total, 3), "unit": "sec", "with_ingest": whole, "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
