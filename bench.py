"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import mean

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Searches over a cached index: the counterpart of the published search latencies.
SEARCHES = ("that this", "with from", "edat tion", "which are", "was that with", "entre avec", "heit und", "ened thon")
BATCH = ("bm25_top10", "tfidf_top10", "posting_lists", "cleaned_html", "page_markdown", "parsed_listings", "property_mapping", "resolved_articles", "crawl_depths")


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 4)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from siltstone import catalog
    from siltstone.operators import index, rank

    queries = {}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    made = []
    queries["index_build"] = timed(lambda: made.append(rank.Searcher(index.build(docs))))
    run = lambda text: made[0].top_k(text, "bm25", 10).collect()
    for text in SEARCHES[:3]:
        run(text)
    for text in SEARCHES:
        queries[f"search: {text}"] = timed(lambda: run(text))
    latency = mean(queries[f"search: {x}"] for x in SEARCHES)
    made[0].close()
    for name in BATCH:
        queries[name] = timed(lambda: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(queries.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": queries, "search_mean_sec": round(latency, 4), "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
