"""Inverted index as tables: postings, terms, docs and one row of statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.sources import shared


@dataclass
class Index:
    postings: DataFrame  # term, doc_id, tf, dl
    terms: DataFrame  # term, df
    docs: DataFrame  # doc_id, dl, and what else is stored
    stats: DataFrame  # n, avgdl; one row

    def cache(self) -> Index:
        return Index(*[d.cache() for d in (self.postings, self.terms, self.docs, self.stats)])

    def save(self, path: str) -> None:
        """Postings are ranged and sorted by term, so that a query reads the row groups of its terms only. The other tables
        are made from the written ones: a text is analysed twice, for its postings and for its length."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        _terms(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")
        _stats(spark.read.parquet(f"{path}/docs")).write.mode("overwrite").parquet(f"{path}/stats")


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def load(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "docs", "stats")])


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> Index:
    """Index the column ``text``. The mean length counts documents without tokens."""
    words = docs.select(F.col(key).alias("doc_id"), X.tokenize(F.col(text)).alias("ws"))
    # The length rides along, so that scoring needs no join with the documents.
    each = words.select("doc_id", F.size("ws").cast("long").alias("dl"), F.explode("ws").alias("term"))
    postings = each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    sized = docs.select(F.col(key).alias("doc_id"), F.size(X.tokenize(F.col(text))).cast("long").alias("dl"), *keep)
    return Index(postings, _terms(postings), sized, _stats(sized))


def number_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """Documents numbered from 0 in the given order, as an index over a file numbers its lines.

    Rows are written with their partition and their place in it; partition sizes are counted from that table and
    the offsets joined back: no single task sees all rows, and none is numbered anew."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    ranged = shared.stage(ranged.withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), "lines")
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    start, rows_ = 0, []
    for p in sorted(sizes):
        rows_.append((p, start))
        start += sizes[p]
    starts = rows.sparkSession.createDataFrame(rows_, "_p int, _s long")
    # One row a partition.
    return ranged.join(F.broadcast(starts), "_p").withColumn("doc_id", F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def posting_lists(index: Index) -> DataFrame:
    """(term, postings sorted by document, doc_freq)."""
    return index.postings.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"), F.count("*").alias("doc_freq"))


def save_tagged(index: Index, path: str) -> None:
    """The index as tagged JSON lines: metadata, terms, documents."""
    stored = [c for c in index.docs.columns if c not in ("doc_id", "dl")]
    meta = index.stats.select(F.lit("metadata").alias("type"), F.col("n").alias("total_docs"), F.col("avgdl").alias("avg_doc_length"))
    terms = posting_lists(index).select(F.lit("term").alias("type"), "term", "postings", "doc_freq")
    docs = index.docs.select(F.lit("document").alias("type"), "doc_id", F.col("dl").alias("doc_length"), (F.to_json(F.struct(*stored)) if stored else F.lit("{}")).alias("data"))
    meta.unionByName(terms, allowMissingColumns=True).unionByName(docs, allowMissingColumns=True).write.mode("overwrite").json(path)


def load_tagged(spark: SparkSession, path: str) -> Index:
    from siltstone.sources import readers

    meta, terms, docs = readers.tagged_index(spark, path)
    postings = terms.select("term", F.explode("postings").alias("p")).select("p.doc_id", "term", "p.tf")
    postings = postings.join(docs.select("doc_id", F.col("doc_length").alias("dl")), "doc_id")
    return Index(postings, terms.select("term", F.col("doc_freq").alias("df")), docs.select("doc_id", F.col("doc_length").alias("dl"), "data"), meta.select(F.col("total_docs").alias("n"), F.col("avg_doc_length").alias("avgdl")))
