"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

The index over documents is built (and cached) once and timed as index_build;
the search queries then run on it, as they would on a stored index. Each query is
run once to warm up and then three times; the median counts. The value is the sum
of all of them.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodeseek import queries as Q  # noqa: E402

HEADLINE = ("term_bm25", "phrase_score", "prefix_score", "bool_must", "bool_should", "bool_nested", "parsed_query", "topk", "collect_then_fetch", "batch_topk", "ndcg_at_k", "term_dictionary", "corpus_stats_avgdl", "highlight_term", "tokenize_standard")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    def timed(f) -> float:
        start = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    start = time.perf_counter()
    docs = Q.documents(spark, sf_dir)
    for t in docs._tables.values():
        t.count()
    took = {"index_build": time.perf_counter() - start}
    for name in HEADLINE:
        timed(lambda name=name: Q.QUERIES[name](spark, sf_dir))
        took[name] = statistics.median(timed(lambda name=name: Q.QUERIES[name](spark, sf_dir)) for _ in range(3))
    print(json.dumps({"metric": "search engine: index build and headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
