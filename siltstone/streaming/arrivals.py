"""Structured Streaming over arriving pages: parsed listings and index upserts, micro-batch by micro-batch.

The batch engine needs none of this; the functions reuse its expressions unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import text as X
from siltstone.plans import enrichment as E

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Parquet files of pages as they arrive in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def listing_stream(pages: DataFrame) -> DataFrame:
    """Listings of a stream of pages; file_hash is the hash of the URL."""
    rows = pages.select(F.md5("url").alias("file_hash"), F.concat(F.md5("url"), F.lit(".html")).alias("source_file"), "html")
    return E.extract_listings(rows)


def hourly_terms(pages: DataFrame, time: str = "arrived", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Tokens by window of event time, with a watermark: windows close when nothing later can come."""
    rows = pages.withWatermark(time, late).select(F.window(time, width).alias("w"), F.size(X.tokenize(F.col("html"))).alias("n"))
    return rows.groupBy("w").agg(F.sum("n").alias("tokens"), F.count("*").alias("pages"))


def index_sink(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of each micro-batch as files of its own; a batch that is run again replaces its
    folder, so that each is counted once."""

    def write(batch: DataFrame, number: int) -> None:
        words = batch.select(F.col("page_id").alias("doc_id"), F.explode(X.all_words(F.col("html"))).alias("term"))
        postings = words.where(~F.col("term").isin(*X.STOP_WORDS)).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        postings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
