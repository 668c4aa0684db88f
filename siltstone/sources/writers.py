"""Writers."""

from __future__ import annotations

import bz2
import json
import os
import uuid
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import wikitext as W
from siltstone.sources import shared
from siltstone.sources.readers import filesystem


def raw_pages(pages: DataFrame, path: str) -> None:
    """Raw HTML by URL hash: (url_hash, url, html) as Parquet."""
    pages.select(F.md5("url").alias("url_hash"), "url", "html").write.mode("append").parquet(path)


def _files(rows: DataFrame, path: str, name: Column, body: Column) -> None:
    """One file a row, by tasks. A file that a repeated task writes again has the same content, and appears whole: it is
    written under a name of its own and moved. Of rows with one name, the first by content has that name, and the k-th
    after it the same name in the folder again-<k>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        made, last, turn = set(), "", 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turn, last = (turn + 1 if name == last else 0), name
                target = f"{base}/again-{turn}/{name}" if turn else f"{base}/{name}"
                folder = os.path.dirname(target)
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                own = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write((text or "").encode())
                fs.move(own, target)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    dealt = shared.spread(rows.select(name.alias("name"), body.alias("body")), "name").sortWithinPartitions("name", "body")
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def page_files(pages: DataFrame, path: str, key: str | None = None) -> None:
    """<hash of the address>.html (or <key>.html) of each page: for exports that tools of files read. Further pages of
    one address are in folders beside (html_directory reads them with ``recursive``)."""
    _files(pages, path, F.concat(F.col(key) if key else F.md5("url"), F.lit(".html")), F.col("html"))


def article_files(articles: DataFrame, path: str) -> None:
    """<state>/<title>.xml with the page and <state>/<title>.json with the other columns of each article."""
    name = F.concat(F.col("state"), F.lit("/"), W.file_name(F.col("wiki_title")))
    record = F.to_json(F.struct(*[c for c in articles.columns if c not in ("xml", "text")]))
    cells = F.array(F.struct(F.concat(name, F.lit(".xml")).alias("name"), F.col("xml").alias("body")), F.struct(F.concat(name, F.lit(".json")).alias("name"), record.alias("body")))
    _files(articles.select(F.explode(cells).alias("f")), path, F.col("f.name"), F.col("f.body"))


def extraction_log(records: DataFrame, path: str) -> None:
    """What was made of each page, as JSON lines: (source_file, markdown, record)."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def xml_dump(articles: DataFrame, path: str) -> None:
    """(wiki_title, page_id, text) as an XML dump."""
    rows = articles.select(F.col("wiki_title").alias("title"), F.col("page_id").alias("id"), F.struct("text").alias("revision"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)


def stream_dump(articles: DataFrame, path: str, titles: str, per_stream: int = 100) -> None:
    """(wiki_title, page_id, text) as one dump of bz2 streams of ``per_stream`` pages, and its title index, compressed. One
    task writes the dump: it is a single file by its format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, target = filesystem(path)
        fs.create_dir(os.path.dirname(target), recursive=True)
        offset, held = 0, []
        own = f"{target}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:

            def flush() -> pa.RecordBatch:
                nonlocal offset, held
                pages = "".join(f"<page><title>{escape(t)}</title><id>{escape(i)}</id><revision><text>{escape(x or '')}</text></revision></page>" for t, i, x in held)
                lines = [f"{offset}:{i}:{t}" for t, i, _ in held]
                body = bz2.compress(pages.encode())
                out.write(body)
                offset, held = offset + len(body), []
                return pa.record_batch([pa.array(lines, pa.string())], names=["value"])

            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    held.append(row)
                    if len(held) == per_stream:
                        yield flush()
            if held:
                yield flush()
        fs.move(own, target)

    one = articles.select("wiki_title", "page_id", "text").coalesce(1).sortWithinPartitions("page_id")
    one.mapInArrow(run, "value string").write.mode("overwrite").option("compression", "bzip2").text(titles)


def csv_append(rows: DataFrame, path: str) -> None:
    """Missing values become empty; every file has a header, which the reader skips."""
    rows.write.mode("append").option("header", True).option("nullValue", "").csv(path)


def jsonl(rows: DataFrame, path: str, single: bool = False, nulls: bool = True) -> None:
    """JSON lines with explicit nulls; ``single`` is for exports of a size that one task can write."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("ignoreNullFields", not nulls).json(path)


def parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def named_jsonl(rows: DataFrame, path: str) -> None:
    """One file of exactly this name: written by one task and renamed, on any file system Spark knows."""
    spark = rows.sparkSession
    tmp = f"{path}.tmp"
    rows.coalesce(1).write.mode("overwrite").json(tmp)
    jvm = spark.sparkContext._jvm
    where, target = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")]
    fs.delete(target, False)
    if not fs.rename(parts[0], target):
        raise OSError(f"cannot rename to {path}")
    fs.delete(where, True)


def articles_by_state(articles: DataFrame, path: str) -> None:
    """Articles partitioned by state, with the file name that each title would have."""
    articles.withColumn("file_name", W.file_name(F.col("wiki_title"))).write.mode("overwrite").partitionBy("state").json(path)


def statistics_array(stats: DataFrame, path: str) -> None:
    """One JSON array of all (few, aggregated) rows."""
    rows = stats.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*stats.columns)))).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def run_summary(spark: SparkSession, path: str, **figures) -> None:
    """Counts of a run, with the application's id, as one JSON file."""
    body = json.dumps({"application_id": spark.sparkContext.applicationId, **figures}, default=str, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
