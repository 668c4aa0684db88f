"""Offline crawl: breadth-first search over a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.sources import shared


def valid_seeds(seeds: DataFrame, limit: int | None = None, start: int = 0) -> DataFrame:
    ok = seeds.where("error is null and place_key is not null and place_key <> ''")
    return ok.orderBy("state_code", "city").offset(start).limit(limit) if limit is not None else ok


def root_urls(seeds: DataFrame, base: str, pages: int = 2) -> DataFrame:
    """(city, state_code, page, url): result pages 1..pages of each seed, with the query as encoded JSON.

    ``base``: the address before /<state>/<slug>/city/<key>."""
    query = F.to_json(
        F.struct(
            F.struct(F.lower("city").alias("city"), F.col("place_key").alias("placeId"), F.lit("places").alias("placeType"), F.col("state_code").alias("stateOrProvince")).alias("place"),
            F.struct(F.col("city_slug").alias("city"), F.col("state_code").alias("stateOrProvince"), F.lit("Sale").alias("uiTransactionType")).alias("filters"),
            F.lit("0").alias("sortKey"),
            F.lit("1").alias("sortDirection"),
            F.lit(False).alias("hasPolygon"),
            F.lit("hidden-all").alias("mapState"),
            F.col("page").alias("pageNumber"),
        )
    )
    # The JSON of the original has a space after each colon and comma between items.
    spaced = F.regexp_replace(F.regexp_replace(query, r'":', '": '), r',"', ', "')
    rows = seeds.select("*", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    path = F.concat_ws("/", F.lit(base.rstrip("/")), "state_code", "city_slug", F.lit("city"), "place_key")
    return rows.select("city", "state_code", "page", F.concat(path, F.lit("?searchQuery="), H.url_quote(spaced)).alias("url"))


def links(pages: DataFrame, host: str | None = None, path: str | None = None, compat: bool = False) -> DataFrame:
    """(src, dst): the distinct absolute links of each page, optionally of one host and path only."""
    rows = pages.select(F.col("url").alias("src"), F.explode(H.hrefs(H.clean_html(F.col("html"), compat))).alias("href"))
    rows = rows.select("src", H.absolute_url("src", "href").alias("dst")).where("dst is not null")
    for part in (host, path):
        if part:
            rows = rows.where(F.col("dst").contains(part))
    return rows.distinct()


def breadth_first(roots: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, depth): every node within max_depth of the roots (column url), at its least depth.

    Each level is one join and one anti join against what was visited; it is written to the shared folder, so that no
    level is computed twice and plans stay short. An empty level ends the search."""
    visited = frontier = shared.stage(roots.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)), "level")
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier.url == edges.src).select(F.col("dst").alias("url")).where("url is not null").distinct()
        frontier = shared.stage(reached.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)), "level")
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return visited


def depth_histogram(visited: DataFrame) -> DataFrame:
    return visited.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth")


def metadata(pages: DataFrame, stamp: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Crawl metadata of stored pages, a row each, after the columns ``keep``; content_length counts characters."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if stamp is None else stamp
    name = F.concat(F.md5("url"), F.lit(".html"))
    return pages.select(
        *keep, F.md5("url").alias("url_hash"), "url", H.authority(F.col("url")).alias("domain"), stamp.alias("download_timestamp"), F.lit(200).alias("status_code"),
        F.length("html").alias("content_length"), F.lit("utf-8").alias("encoding"), name.alias("html_file_path"), F.lit("text/html").alias("content_type"), F.lit(None).cast("double").alias("response_time_ms"),
    )
