"""HTML functions: tag stripping, links, URLs, Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags to strip, in order; True: with their content.
TAGS = (("style", True), ("script", True), ("svg", True), ("link", False))
#: As the duplicate key of the original rule set had it: script loses its opening tags only.
TAGS_COMPAT = (("style", True), ("script", False), ("svg", True), ("link", False))


def clean_html(html: Column, compat: bool = False) -> Column:
    for tag, content in TAGS_COMPAT if compat else TAGS:
        pattern = rf"(?is)<{tag}[^>]*>.*?</{tag}>" if content else rf"(?i)<{tag}[^>]*/?>"
        html = F.regexp_replace(html, pattern, "")
    return html


def hrefs(html: Column) -> Column:
    """Targets of anchors in document order, without empty, fragment and javascript ones."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]+href=["']([^"']+)["']"""), F.lit(1))
    return F.filter(found, lambda h: (h != "") & ~h.startswith("#") & ~h.startswith("javascript:"))


def resolve(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base, href) if base is not None and href is not None else None
    except ValueError:
        return None


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """RFC 3986 resolution; null where either side is null or malformed."""

    def run(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([resolve(b, h) for b, h in zip(base, href)], dtype="object")

    return F.pandas_udf(run, "string")(base, href)


def url_hash(url: Column) -> Column:
    return F.md5(url)


def authority(url: Column) -> Column:
    """Host with port; null for malformed URLs."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def url_quote(text: Column) -> Column:
    """Percent encoding with %20 for a space; "/" stays."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


_BLANKS, _SPACES = re.compile(r"[ \t\r\f\v]+"), re.compile(r"\s+")


class _Markdown(HTMLParser):
    """ATX headings, blocks with blank lines between them, list items, decoded entities."""

    BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "ul", "ol", "table", "tr", "dl", "dt", "dd", "form", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "aside", "body", "html", "title"}
    SKIP = {"script", "style", "svg", "head", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.mark = ""
        self.skip = 0

    def close_block(self) -> None:
        if not self.line:
            self.mark = ""
            return
        text = _BLANKS.sub(" ", "".join(self.line))
        text = "\n".join(x.strip() for x in text.split("\n")).strip()
        if text:
            self.out.append(self.mark + text)
        self.line, self.mark = [], ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "br":
            self.line.append("\n")
        elif tag == "li":
            self.close_block()
            self.mark = "* "
        elif tag in self.BLOCKS:
            self.close_block()
            if tag[0] == "h" and tag[1:].isdigit():
                self.mark = "#" * int(tag[1:]) + " "
        elif tag in ("td", "th"):
            self.line.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS or tag == "li":
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.line.append(_SPACES.sub(" ", data))


def markdown(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.close_block()
    return "\n\n".join(parser.out)


def html_to_markdown(html: Column) -> Column:
    """Markdown of a page, by an Arrow-batched UDF; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(markdown, na_action="ignore")

    return F.pandas_udf(run, "string")(html)
