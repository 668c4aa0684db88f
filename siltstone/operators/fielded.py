"""Fielded documents and their positional index."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import listing
from siltstone.functions import text as X

#: kind: text (analysed), exact (verbatim) or number. The query parser reads it; names map to columns.
FIELDS = {
    "property_id": "exact", "title": "text", "description": "text", "price": "number", "beds": "number", "baths": "number",
    "sqft": "number", "city_exact": "exact", "city": "text", "county": "exact", "state": "exact", "school_district_exact": "exact",
    "school_district": "text", "property_type": "exact", "population": "number", "area_km2": "number", "elevation_ft": "number",
    "students": "number", "schools": "number",
}
DEFAULT_FIELD = "description"
# The keys of a result row, in order.
RESULT_KEYS = ("rank", "score", "property_id", "title", "price", "beds", "baths", "sqft", "property_type", "city", "city_exact", "county", "state", "school_district", "school_district_exact", "description", "population", "area_km2", "elevation_ft", "students", "schools")


@dataclass
class FieldedIndex:
    docs: DataFrame  # doc_id and the columns of the fields
    postings: DataFrame  # field, term, doc_id, tf, positions, dl
    terms: DataFrame  # field, term, df
    lengths: DataFrame  # field, doc_id, dl
    stats: DataFrame  # field, n, avgdl
    fields: dict[str, str]
    default: str

    def cache(self) -> FieldedIndex:
        for name in ("docs", "postings", "terms", "lengths", "stats"):
            setattr(self, name, getattr(self, name).cache())
        return self

    def save(self, path: str) -> None:
        """Postings are ranged and sorted by field and term, so that a query reads the row groups of its terms only; terms and
        statistics are made from written tables. A previous index at the path is replaced."""
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        order = ("field", "term", "doc_id")
        self.postings.repartitionByRange(*order[:2]).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        _terms(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")
        _stats(spark.read.parquet(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/stats")
        about = [(json.dumps({"fields": self.fields, "default": self.default}),)]
        spark.createDataFrame(about, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> FieldedIndex:
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "terms", "lengths", "stats")]
    return FieldedIndex(*tables, about["fields"], about["default"])


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def _stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _number(text: Column) -> Column:
    """A whole number without $ and commas; null where it is none (cents make it none)."""
    return F.translate(text.cast("string"), "$,", "").try_cast("long")


def documents(joined: DataFrame, wiki_only: bool = False) -> DataFrame:
    """Typed documents from listings with ``wiki_data`` (see enrichment.join_matches)."""
    rows = joined.where("wiki_data is not null") if wiki_only else joined
    first = lambda part: F.get(F.filter("wiki_data", lambda m: m["match_type"] == part), 0)[part]
    city, school = first("city"), first("school_district")
    fact = lambda m, k: F.regexp_replace(F.try_element_at(m, F.lit(k)), ",", "")
    state = F.nullif(listing.state_of_title(F.col("title")), F.lit(""))
    return rows.select(
        F.col("property_id"), "title", "description", _number(F.col("price")).alias("price"), "beds", "baths", "sqft",
        F.col("city").alias("city_exact"), "city", "county", state.alias("state"), F.col("school_district").alias("school_district_exact"), "school_district", "property_type",
        fact(city, "population").try_cast("double").cast("long").alias("population"), F.round(fact(city, "area_km2").try_cast("double"), 2).alias("area_km2"),
        fact(city, "elevation_ft").try_cast("double").cast("long").alias("elevation_ft"), fact(school, "students").try_cast("double").cast("long").alias("students"),
        fact(school, "schools").try_cast("double").cast("long").alias("schools"),
    )


def build(docs: DataFrame, key: str, fields: dict[str, str] | None = None, default: str = DEFAULT_FIELD) -> FieldedIndex:
    """Index the text fields of docs with positions."""
    fields = fields or FIELDS
    texts = [f for f, kind in fields.items() if kind == "text"]
    docs = docs.withColumn("doc_id", F.col(key))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("body")) for f in texts]))
    rows = docs.select("doc_id", cells.alias("c")).select("doc_id", "c.field", X.analyze(F.col("c.body")).alias("ws"))
    lengths = rows.select("field", "doc_id", F.size("ws").cast("long").alias("dl")).where("dl > 0")
    # The length rides along, so that scoring needs no join with the documents.
    each = rows.select("field", "doc_id", F.size("ws").cast("long").alias("dl"), F.posexplode("ws").alias("pos", "term"))
    postings = each.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))
    return FieldedIndex(docs, postings, _terms(postings), lengths, _stats(lengths), fields, default)
