"""Readers. All return lazy DataFrames with declared schemas; none opens files on the driver."""

from __future__ import annotations

import bz2
import os
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import schema
from siltstone.sources import shared


def html_directory(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file_hash, source_file, html) of every *.html file; file_hash is the name without its ending. Empty files count in
    a local folder; elsewhere Spark's reader leaves them out."""
    folder = _local_folder(spark, path)
    if folder:
        files = _small_files(spark, folder, ".html", recursive)
        name = F.col("name")
    else:
        files = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", recursive).text(path, wholetext=True)
        name = F.col("_metadata.file_name")
    return files.select(F.regexp_extract(name, r"(.*)\.html$", 1).alias("file_hash"), name.alias("source_file"), F.col("value").alias("html"))


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of a path that Spark would read from a mounted file system; None for patterns and other file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    local = fs.getUri().getScheme() == "file" and not any(c in path for c in "*?[{\\")
    return fs.makeQualified(where).toUri().getPath() if local and fs.exists(where) and fs.getFileStatus(where).isDirectory() else None


def _small_files(spark: SparkSession, folder: str, ending: str, recursive: bool) -> DataFrame:
    """(name, value) of the files of a folder. Spark lists files on the driver and plans a task for a few dozen of them; here a
    task lists them, by blocks, and they are dealt to a few tasks a core."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            held, open_ = [], [folder]
            while open_:
                with os.scandir(open_.pop()) as entries:
                    for e in entries:
                        if e.name[0] in "._":
                            continue
                        if e.is_dir():
                            open_ += [e.path] if recursive else []
                        elif e.name.endswith(ending):
                            held.append(e.path)
                        if len(held) == 10_000:
                            yield pa.record_batch([pa.array(held, pa.string())], names=["path"])
                            held = []
            yield pa.record_batch([pa.array(held, pa.string())], names=["path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    held.append((os.path.basename(path), f.read()))
                size += len(held[-1][1])
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), (pa.string(), pa.binary()))], names=["name", "value"])
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), (pa.string(), pa.binary()))], names=["name", "value"])

    paths = spark.range(0, 1, 1, 1).mapInArrow(names, "path string")
    return shared.spread(paths, "path").mapInArrow(read, "name string, value binary").withColumn("value", F.col("value").cast("string"))


def pages_table(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) from Parquet."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def json_array(spark: SparkSession, path: str, kind: T.StructType = schema.SEEDS) -> DataFrame:
    return spark.read.schema(kind).option("multiLine", True).json(path)


def jsonl_strict(spark: SparkSession, path: str, kind: T.StructType = schema.PROPERTIES) -> DataFrame:
    """A malformed line fails the job."""
    return spark.read.schema(kind).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, kind: T.StructType = schema.PROPERTIES) -> DataFrame:
    """Blank lines are skipped; malformed lines keep their text in _corrupt_record, so that one can count
    and drop them (``good_lines``)."""
    wide = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def good_lines(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def crawl_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CRAWL_METADATA).option("header", True).csv(path)


def properties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def match_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MATCHES).json(path)


def joined_properties(spark: SparkSession, path: str) -> DataFrame:
    """Listings with their matches, as the join writes them; absent keys are null."""
    return spark.read.schema(schema.JOINED).json(path)


def parse_title_lines(lines: DataFrame) -> DataFrame:
    """(offset, page_id, wiki_title) from "offset:page_id:title" lines; bad lines are dropped."""
    parts = F.split(F.trim("value"), ":", 3)
    rows = lines.select(parts.alias("p")).where(F.size("p") == 3)
    return rows.select(F.get("p", 0).try_cast("long").alias("offset"), F.get("p", 1).alias("page_id"), F.get("p", 2).alias("wiki_title")).where("offset is not null")


def title_index(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The title index of a dump; bz2 is read in splits by Spark itself."""
    lines = spark.read.text(path)
    return parse_title_lines(lines.repartition(partitions) if partitions else lines)


def article_dump(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, wiki_title, text, xml) of an article dump in XML, compressed or not."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema.DUMP_PAGE).load(path)
    page = F.struct("title", "id", "revision")
    return rows.select(F.col("id").alias("page_id"), F.col("title").alias("wiki_title"), F.coalesce("revision.text", F.lit("")).alias("text"), F.to_xml(page, {"rowTag": "page"}).alias("xml"))


def in_memory(spark: SparkSession, rows: list, kind: str | T.StructType, partitions: int | None = None) -> DataFrame:
    """Rows of the driver, of which there are few, dealt over partitions."""
    out = spark.createDataFrame(rows, kind)
    return out.repartition(partitions) if partitions else out


def first(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in an order; all where n is None."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def by_offset(wanted: DataFrame) -> DataFrame:
    """(offset, wanted): the rows that are read at one place of a dump, collected; a stream holds a bounded number of pages."""
    return wanted.groupBy("offset").agg(F.collect_list(F.struct(*wanted.columns)).alias("wanted"))


def pages_at(wanted: DataFrame, dump: str) -> DataFrame:
    """(page_id, wiki_title, text, xml) of the wanted pages (offset, page_id, wiki_title) of a dump of bz2 streams.

    Each stream that holds a wanted page is read once, from its offset to its end: nothing before it is
    decompressed. A page that its stream does not hold is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(dump)
        with fs.open_input_file(path) as source:
            for batch in batches:
                rows = []
                for offset, titles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    source.seek(offset)
                    rows += [r for r in _stream_pages(source) if r[1] in titles]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=["page_id", "wiki_title", "text", "xml"])

    asked = by_offset(wanted.select("offset", "page_id", "wiki_title")).select("offset", F.col("wanted.wiki_title").alias("titles"))
    return asked.mapInArrow(run, "page_id string, wiki_title string, text string, xml string")


def _stream_pages(source) -> list[tuple[str, str, str, str]]:
    """The pages of the bz2 stream that begins at the source's place."""
    unpack, body = bz2.BZ2Decompressor(), bytearray()
    while not unpack.eof and (block := source.read(1 << 18)):
        body += unpack.decompress(block)
    out = []
    for page in ElementTree.fromstring(b"<pages>" + bytes(body) + b"</pages>").iter("page"):
        at = lambda name: page.findtext(name) or ""  # noqa: B023, E731
        out.append((at("id"), at("title"), at("revision/text"), ElementTree.tostring(page, encoding="unicode")))
    return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def tagged_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, terms, documents) of a tagged JSON-lines index."""
    rows = spark.read.schema(schema.TAGGED_INDEX).json(path)
    return (
        rows.where("type = 'metadata'").select("total_docs", "avg_doc_length"),
        rows.where("type = 'term'").select("term", "postings", "doc_freq"),
        rows.where("type = 'document'").select("doc_id", "doc_length", "data"),
    )
