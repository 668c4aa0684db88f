"""Ranked retrieval over an index: BM25, TF-IDF, term metrics, result rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.index import Index

K1, B = 1.2, 0.75


def idf_bm25(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def idf_tfidf(n: Column, df: Column) -> Column:
    return F.ln(n / df)


def bm25_score(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    length = F.coalesce(F.try_divide(dl, avgdl), F.lit(0.0))
    return idf_bm25(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))


def tfidf_score(tf: Column, df: Column, dl: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(tf, dl), F.lit(0.0)) * idf_tfidf(n, df)


def scores(index: Index, query: str, method: str = "bm25") -> DataFrame:
    """(doc_id, score) of every document with a query term. A repeated term counts each time. The query's
    few terms are broadcast; postings are filtered by term in the scan before anything is joined."""
    wanted = Counter(X.query_terms(query))
    spark = index.postings.sparkSession
    terms = spark.createDataFrame([*wanted.items()], "term string, qtf long")
    some = index.terms.where(F.col("term").isin(list(wanted))).join(F.broadcast(terms), "term").crossJoin(F.broadcast(index.stats))
    hits = index.postings.where(F.col("term").isin(list(wanted))).join(F.broadcast(some), "term")
    tf, df, dl, n, avgdl = (F.col(c) for c in ("tf", "df", "dl", "n", "avgdl"))
    one = tfidf_score(tf, df, dl, n) if method == "tfidf" else bm25_score(tf, df, dl, n, avgdl)
    return hits.groupBy("doc_id").agg(F.sum(one * F.col("qtf")).alias("score"))


def top_k(index: Index, query: str, method: str = "bm25", k: int = 10) -> DataFrame:
    """(doc_id, score): the k best, ties by doc_id."""
    ranked = scores(index, query, method).select("doc_id", F.round("score", 6).alias("score"))
    return ranked.orderBy(F.desc("score"), "doc_id").limit(k)


def term_metrics(index: Index, hits: DataFrame, query: str) -> DataFrame:
    """(doc_id, term, tf, df, idf, tf_normalized, present) of each hit and distinct query term; idf is
    ln(n / df) for either method; an absent term has no tf_normalized."""
    wanted = sorted(set(X.query_terms(query)))
    spark = index.postings.sparkSession
    terms = spark.createDataFrame([(t,) for t in wanted], "term string").join(index.terms.where(F.col("term").isin(wanted)), "term", "left").crossJoin(F.broadcast(index.stats))
    grid = hits.select("doc_id").crossJoin(F.broadcast(terms)).join(index.docs.select("doc_id", "dl"), "doc_id")
    posts = index.postings.where(F.col("term").isin(wanted)).select("doc_id", "term", "tf")
    both = grid.join(posts, ["doc_id", "term"], "left")
    present = F.col("tf").isNotNull()
    return both.select(
        "doc_id", "term", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"), F.coalesce("df", F.lit(0)).cast("long").alias("df"),
        F.when(F.col("df") > 0, F.round(idf_tfidf(F.col("n"), F.col("df")), 4)).otherwise(F.lit(0.0)).alias("idf"),
        F.when(present, F.round(F.col("tf") / F.col("dl"), 4)).alias("tf_normalized"), present.alias("present"),
    )


class Searcher:
    """Interactive search: the postings in memory, each with its document's length. They are dealt by document, as shards of
    an index are, and sorted by term: a search is one job, in which each task reads the batches of the query's terms, scores
    its own documents and hands on its k best. How many documents hold a term is counted when it is first asked for, in
    these batches too, and remembered."""

    def __init__(self, index: Index):
        spark = index.postings.sparkSession
        self.index = index
        shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.postings = index.postings.select("term", "doc_id", "tf", "dl").repartition(shards, "doc_id").sortWithinPartitions("term", "doc_id").cache()
        self.known: dict[str, int] = {}
        # Documents without a token count in the mean; their number needs no text.
        n, length = index.docs.agg(F.count("*")).first()[0], self.postings.agg(F.sum("tf")).first()[0] or 0
        self.n, self.avgdl = n, length / n if n else 0.0

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many documents hold each of the (few) terms."""
        new = sorted(set(terms) - set(self.known))
        if new:
            rows = self.postings.where(F.col("term").isin(new)).groupBy("term").agg(F.count("*").alias("n")).collect()
            self.known |= dict.fromkeys(new, 0) | {r.term: r.n for r in rows}
        return {t: self.known[t] for t in terms}

    def top_k(self, query: str, method: str = "bm25", k: int = 10) -> DataFrame:
        """As ``top_k``."""
        wanted = Counter(X.query_terms(query))
        df = F.lit(None).cast("long")
        for term, count in self.frequencies(list(wanted)).items():
            df = F.when(F.col("term") == term, F.lit(count or None).cast("long")).otherwise(df)
        tf, dl, n = F.col("tf"), F.col("dl"), F.lit(self.n)
        one = tfidf_score(tf, df, dl, n) if method == "tfidf" else bm25_score(tf, df, dl, n, F.lit(self.avgdl))
        for term, count in wanted.items():
            one = F.when(F.col("term") == term, one * count).otherwise(one) if count > 1 else one
        hits = self.postings.where(F.col("term").isin(list(wanted)))
        ranked = hits.groupBy("doc_id").agg(F.round(F.sum(one), 6).alias("score"))
        return ranked.orderBy(F.desc("score"), "doc_id").limit(k)

    def close(self) -> None:
        self.postings.unpersist()


def search(index: Index, query: str, method: str = "bm25", k: int = 10) -> DataFrame:
    """Result rows: doc_id, score, the stored fields, shortened description, term_metrics, method."""
    best = top_k(index, query, method, k)
    cell = F.struct("tf", "df", "idf", "tf_normalized", "present")
    metrics = term_metrics(index, best, query).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", cell)))).alias("term_metrics"))
    rows = best.join(index.docs.drop("dl"), "doc_id").join(metrics, "doc_id", "left")
    if "description" in index.docs.columns:
        rows = rows.withColumn("description", X.limit_words(F.col("description")))
    return rows.withColumn("method", F.lit("tfidf" if method == "tfidf" else "bm25")).orderBy(F.desc("score"), "doc_id")
