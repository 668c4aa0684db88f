"""Pages over HTTP, as a Python data source.

    spark.dataSource.register(HttpPages)
    spark.read.format("siltstone_pages").option("urls", path_of_a_text_table).load()

Addresses are read from a text file or folder, one a line, and dealt over ``partitions``. A page that is only a robot check is asked for
again, after 10 * 2**attempt seconds, up to ``retries`` times, and then given as it is; any other failure ends the
task at once with its error. Rows are (url, html, status_code)."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from siltstone.sources.readers import filesystem

TIMEOUT = 30
RETRIES = 5
DELAY = 10.0
#: What the body of a robot check says.
ROBOT_CHECK = ("are you a robot", "verify you are human", "captcha")


def is_robot_check(html: str) -> bool:
    low = html[:5000].lower()
    return any(mark in low for mark in ROBOT_CHECK)


def fetch(url: str, retries: int = RETRIES, delay: float = DELAY, timeout: float = TIMEOUT) -> tuple[str, str, int]:
    for attempt in range(retries + 1):
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            html, status = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), answer.status
        if attempt == retries or not is_robot_check(html):
            break
        time.sleep(delay * 2**attempt)
    return url, html, status


class Some(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Some]:
        fs, path = filesystem(self.options["urls"])
        info = fs.get_file_info(path)
        from pyarrow.fs import FileSelector, FileType

        files = [path] if info.type == FileType.File else [f.path for f in fs.get_file_info(FileSelector(path)) if f.is_file and f.base_name[0] not in "._"]
        urls: list[str] = []
        for name in sorted(files):
            with fs.open_input_stream(name) as source:
                urls += [u for u in source.read().decode().splitlines() if u.strip()]
        n = max(1, min(int(self.options.get("partitions", "8")), len(urls)))
        return [Some(urls[i::n]) for i in range(n)]

    def read(self, partition: Some) -> Iterator[tuple[str, str, int]]:
        retries, delay = int(self.options.get("retries", RETRIES)), float(self.options.get("delay", DELAY))
        for url in partition.urls:
            yield fetch(url, retries, delay)


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_pages"

    def schema(self) -> str:
        return "url string, html string, status_code int"

    def reader(self, schema: StructType) -> HttpReader:
        return HttpReader(self.options)
