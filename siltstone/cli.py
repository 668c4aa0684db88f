"""Command line: extraction | wiki | full | join | crawl-links | index | search | query | tokens."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import siltstone
from siltstone import schema
from siltstone.functions import text as X
from siltstone.operators import crawl, fielded, index, rank
from siltstone.plans import enrichment as E
from siltstone.plans import query as Q
from siltstone.sources import readers, shared, writers


def session(partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("siltstone").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.config("spark.sql.shuffle.partitions", partitions) if partitions else builder).getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        siltstone.ship(spark)
    return spark


def extraction(spark: SparkSession, pages: str, out: str) -> None:
    listings = E.extract_listings(readers.html_directory(spark, pages))
    writers.parquet(listings, f"{out}/parsed/parsed.parquet")
    writers.jsonl(spark.read.parquet(f"{out}/parsed/parsed.parquet"), f"{out}/parsed/json")


def wiki(spark: SparkSession, parsed: str, titles: str, dump: str, out: str, threshold: float) -> None:
    """Stages 2 to 8. Each stage's table is written once and read by the next, which cuts lineage."""
    began, properties = time.time(), readers.properties(spark, parsed)

    def keep(rows, name):
        writers.parquet(rows, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    cities, districts = E.locations(properties)
    cities, districts = keep(cities, "cities"), keep(districts, "school_districts")
    found = keep(E.find_pages(readers.title_index(spark, titles), cities, districts), "found_pages")
    pages = keep(E.best_pages(found), "deduplicated_pages")
    articles = keep(E.resolve(pages, readers.article_dump(spark, dump)), "articles")
    writers.articles_by_state(articles, f"{out}/articles_by_state")
    mapping = keep(E.map_properties(properties, articles, threshold), "mapping")
    writers.jsonl(E.match_metadata(mapping), f"{out}/property_wiki_metadata", nulls=False)
    writers.statistics_array(E.district_statistics(mapping), f"{out}/school_district_statistics")
    figures = E.mapping_summary(properties, mapping).first().asDict()
    writers.run_summary(spark, f"{out}/summary", seconds=round(time.time() - began, 1), threshold=threshold, **figures)


def join(spark: SparkSession, parsed: str, matches: str, out: str) -> None:
    writers.named_jsonl(E.join_matches(readers.properties(spark, parsed), readers.match_metadata(spark, matches)), out)


def fielded_index(spark: SparkSession, joined: str, wiki_only: bool = False, path: str | None = None) -> fielded.FieldedIndex:
    """The fielded index of joined listings: opened if ``path`` holds one, else built, and kept there if a path is given."""
    if path and shared.exists(spark, f"{path}/about/_SUCCESS"):
        return fielded.load(spark, path)
    built = fielded.build(fielded.documents(readers.joined_properties(spark, joined), wiki_only), "property_id")
    if not path:
        return built
    built.save(path)
    return fielded.load(spark, path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    parser.add_argument("--partitions", type=int)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
        return p

    command("extraction", "pages", "out")
    for name in ("wiki", "full"):
        command(name, "parsed" if name == "wiki" else "pages", "titles", "dump", "out").add_argument("--threshold", type=float, default=E.THRESHOLD)
    command("join", "parsed", "matches", "out")
    command("crawl-links", "pages", "out")
    command("index", "documents", "out").add_argument("--key", default="file_hash")
    p = command("search", "index", "text")
    p.add_argument("--method", default="tfidf", choices=["bm25", "tfidf"])
    p.add_argument("--top", type=int, default=5)
    p = command("query", "joined", "text")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--wiki-only", action="store_true")
    p.add_argument("--index", help="a folder that keeps the index: built there if it is not, else opened")
    command("tokens", "jsonl").add_argument("--encoding")
    a = parser.parse_args(argv)
    spark = session(a.partitions)
    if a.command == "extraction":
        extraction(spark, a.pages, a.out)
    elif a.command == "wiki":
        wiki(spark, a.parsed, a.titles, a.dump, a.out, a.threshold)
    elif a.command == "full":
        extraction(spark, a.pages, a.out)
        wiki(spark, f"{a.out}/parsed/parsed.parquet", a.titles, a.dump, a.out, a.threshold)
        join(spark, f"{a.out}/parsed/parsed.parquet", f"{a.out}/property_wiki_metadata", f"{a.out}/properties_with_wiki.jsonl")
    elif a.command == "join":
        join(spark, a.parsed, a.matches, a.out)
    elif a.command == "crawl-links":
        writers.parquet(crawl.links(spark.read.parquet(a.pages)), a.out)
    elif a.command == "index":
        rows = readers.jsonl_strict(spark, a.documents)
        docs = index.number_lines(rows.withColumn("text", X.document_text(F.col("title"), F.col("description"))), [a.key])
        index.build(docs, keep=tuple(f.name for f in schema.PROPERTIES.fields)).save(a.out)
    elif a.command == "search":
        rank.search(index.load(spark, a.index), a.text, a.method, a.top).show(truncate=60, vertical=True)
    elif a.command == "query":
        Q.search(fielded_index(spark, a.joined, a.wiki_only, a.index), a.text, a.top).orderBy("rank").select(*[c for c in fielded.RESULT_KEYS if c not in ("school_district",)]).show(truncate=60, vertical=True)
    elif a.command == "tokens":
        X.token_report(readers.good_lines(readers.jsonl_lenient(spark, a.jsonl)), a.encoding).show(50, truncate=False)


if __name__ == "__main__":
    main()
