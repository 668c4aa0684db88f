"""Registered queries of sources, sinks, listing fields and small operators, with their SQL twins.

A round trip writes a table by a writer of the engine to the shared folder and gives back what its reader finds. The SQL twins
state constants as literals."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import catalog, cli, schema
from siltstone.catalog import _LISTINGS, _MAP_ALL, register, table
from siltstone.functions import html as H
from siltstone.functions import text as X
from siltstone.functions import wikitext as W
from siltstone.operators import crawl, fielded, index, rank
from siltstone.plans import enrichment as E
from siltstone.plans import query as Q
from siltstone.sources import readers, shared, writers

# --- sources and sinks -------------------------------------------------------------------------


@register("SELECT c_mktsegment AS city, 's' || c_nationkey AS state_code, CAST(c_custkey AS VARCHAR) AS place_key, CASE WHEN c_custkey % 5 = 0 THEN 'gone' END AS error FROM customer")
def json_array_round_trip(spark, sf):
    """One JSON array, written and read as one."""
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_mktsegment").alias("city"), F.concat(F.lit("s"), "c_nationkey").alias("state_code"), F.col("c_custkey").cast("string").alias("place_key"), F.when(F.col("c_custkey") % 5 == 0, "gone").alias("error"))
    path = shared.fresh(spark, "seeds.json")
    writers.statistics_array(rows, path)
    return readers.json_array(spark, path).select("city", "state_code", "place_key", "error")


def _seeds(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_mktsegment").alias("city"), F.concat(F.lit("s"), "c_nationkey").alias("state"), F.concat(F.lit("s"), "c_nationkey").alias("state_code"), F.lower("c_mktsegment").alias("city_slug"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")).otherwise("").alias("place_key"), F.when(F.col("c_custkey") % 5 == 0, "gone").alias("error"),
    )


_VALID = "SELECT c_mktsegment AS city, 's' || c_nationkey AS state_code, CAST(c_custkey AS VARCHAR) AS place_key FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0"


@register(_VALID)
def valid_seeds(spark, sf):
    return crawl.valid_seeds(_seeds(spark, sf)).select("city", "state_code", "place_key")


@register(f"SELECT state_code, city FROM ({_VALID}) ORDER BY state_code, city LIMIT 40 OFFSET 25")
def seed_slice(spark, sf):
    """The slice is the feature: seeds 25 to 64 in order of state and city."""
    return crawl.valid_seeds(_seeds(spark, sf), limit=40, start=25).select("state_code", "city")


@register("SELECT md5(url) AS file_hash, md5(url) || '.html' AS source_file, md5(html) AS html_md5, CAST(length(html) AS BIGINT) AS n FROM pages")
def html_files_round_trip(spark, sf):
    """A file for each page, named by its address; read back as whole files with the stem as id."""
    path = shared.fresh(spark, "html")
    writers.page_files(table(spark, sf, "pages"), path)
    return readers.html_directory(spark, path, recursive=True).select("file_hash", "source_file", F.md5("html").alias("html_md5"), F.length("html").cast("long").alias("n"))


@register("SELECT md5(url) AS url_hash, url, md5(html) AS html_md5 FROM pages")
def raw_pages_round_trip(spark, sf):
    path = shared.fresh(spark, "raw")
    writers.raw_pages(table(spark, sf, "pages"), path)
    return spark.read.parquet(path).select("url_hash", "url", F.md5("html").alias("html_md5"))


@register(r"""SELECT md5(url) AS url_hash, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain, 't' AS download_timestamp, 200 AS status_code, CAST(length(html) AS INTEGER) AS content_length, md5(url) || '.html' AS html_file_path,
response_time_ms IS NULL AS untimed FROM (SELECT *, CAST(NULL AS DOUBLE) AS response_time_ms FROM pages UNION ALL SELECT *, CAST(NULL AS DOUBLE) FROM pages)""")
def crawl_csv_round_trip(spark, sf):
    """Appended twice: each file has a header, which is read once; what is missing is empty and read as null."""
    path = shared.fresh(spark, "metadata")
    for _ in range(2):
        writers.csv_append(crawl.metadata(table(spark, sf, "pages").select("url", "html"), F.lit("t")), path)
    return readers.crawl_metadata(spark, path).select("url_hash", "url", "domain", "download_timestamp", "status_code", "content_length", "html_file_path", F.col("response_time_ms").isNull().alias("untimed"))


def _listing_table(spark, sf):
    return catalog._listings(spark, sf)


@register(_LISTINGS)
def strict_jsonl_round_trip(spark, sf):
    path = shared.fresh(spark, "listings")
    writers.jsonl(_listing_table(spark, sf), path)
    return readers.jsonl_strict(spark, path)


@register(f"SELECT file_hash, school_district IS NULL AS no_district, true AS null_is_written, CASE WHEN n_nationkey = 0 THEN 1 ELSE 0 END AS accents FROM ({_LISTINGS}) JOIN (SELECT 0 AS n_nationkey) ON true")
def jsonl_lines(spark, sf):
    """The written lines themselves: nulls are there, other letters than ASCII are as they are."""
    path = shared.fresh(spark, "lines")
    writers.jsonl(_listing_table(spark, sf).withColumn("note", F.lit("é")), path)
    v = F.col("value")
    return spark.read.text(path).select(F.get_json_object(v, "$.file_hash").alias("file_hash"), F.get_json_object(v, "$.school_district").isNull().alias("no_district"), v.contains('"school_district":').alias("null_is_written"), v.contains('"note":"é"').cast("int").alias("accents"))


@register(f"SELECT file_hash, title, price FROM ({_LISTINGS}) WHERE beds % 4 <> 0")
def lenient_jsonl_round_trip(spark, sf):
    """Every fourth line is broken and dropped; blank lines are skipped."""
    path = shared.fresh(spark, "broken")
    rows = _listing_table(spark, sf)
    line = F.to_json(F.struct("file_hash", "title", "price"))
    rows.select(F.explode(F.array(F.when(F.col("beds") % 4 == 0, F.concat(F.lit("{"), line)).otherwise(line), F.lit(""))).alias("value")).write.text(path)
    return readers.good_lines(readers.jsonl_lenient(spark, path)).select("file_hash", "title", "price")


@register(_LISTINGS)
def parquet_overwrite(spark, sf):
    """What is written last is what is there."""
    path = shared.fresh(spark, "parsed")
    writers.parquet(_listing_table(spark, sf).limit(0), path)
    writers.parquet(_listing_table(spark, sf), path)
    return readers.properties(spark, path)


@register(f"SELECT file_hash, title, beds, 1 AS files FROM ({_LISTINGS})")
def single_json_round_trip(spark, sf):
    path = shared.fresh(spark, "single")
    writers.jsonl(_listing_table(spark, sf), path, single=True)
    rows = spark.read.schema(schema.PROPERTIES).json(path).withColumn("file", F.col("_metadata.file_name"))
    files = rows.agg(F.count_distinct("file").cast("int").alias("files"))
    return rows.select("file_hash", "title", "beds").crossJoin(F.broadcast(files))


@register(f"SELECT file_hash, title, 'listings.jsonl' AS file FROM ({_LISTINGS})")
def named_jsonl_round_trip(spark, sf):
    path = shared.fresh(spark, "named") + "/listings.jsonl"
    writers.named_jsonl(_listing_table(spark, sf), path)
    return spark.read.schema(schema.PROPERTIES).json(path).select("file_hash", "title", F.col("_metadata.file_name").alias("file"))


@register("SELECT s.state, s.state_full FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in (("AL", "Alabama"), ("DC", "District of Columbia"), ("TX", "Texas"), ("WY", "Wyoming"))) + ") s(state, state_full)")
def state_dimension(spark, sf):
    """Literal rows, dealt over partitions: four of the states."""
    rows = readers.in_memory(spark, list(schema.STATES.items()), "state string, state_full string", 4)
    return rows.where(F.col("state").isin("AL", "DC", "TX", "WY")).select("state", "state_full")


@register("SELECT 'A' || n_nationkey AS wiki_title, 'A' || n_nationkey AS page_id, n_name AS body FROM nation")
def dump_round_trip(spark, sf):
    """Articles as an XML dump, read page by page."""
    n = table(spark, sf, "nation")
    key = F.concat(F.lit("A"), "n_nationkey")
    path = shared.fresh(spark, "dump")
    writers.xml_dump(n.select(key.alias("wiki_title"), key.alias("page_id"), F.col("n_name").alias("text")), path)
    return readers.article_dump(spark, path).select("wiki_title", "page_id", F.col("text").alias("body"))


@register("SELECT 'A' || n_nationkey AS title, true AS has_title, true AS has_text FROM nation")
def page_xml(spark, sf):
    """The XML of each page, as the dump's reader gives it."""
    n = table(spark, sf, "nation")
    key = F.concat(F.lit("A"), "n_nationkey")
    path = shared.fresh(spark, "dump")
    writers.xml_dump(n.select(key.alias("wiki_title"), key.alias("page_id"), F.col("n_name").alias("text")), path)
    rows = readers.article_dump(spark, path)
    xml = F.col("xml")
    return rows.select(F.col("wiki_title").alias("title"), xml.contains(F.concat(F.lit("<title>"), "wiki_title", F.lit("</title>"))).alias("has_title"), xml.contains(F.concat(F.lit("<text>"), "text", F.lit("</text>"))).alias("has_text"))


def _streams(spark, sf) -> tuple[str, str]:
    """The articles of nations as a dump of bz2 streams of 7 pages, and its title index."""
    path = shared.fresh(spark, "streams")
    writers.stream_dump(catalog._dump(spark, sf), f"{path}/dump.xml.bz2", f"{path}/index", 7)
    return f"{path}/dump.xml.bz2", f"{path}/index"


@register("SELECT 'A' || n_nationkey AS page_id, 'A' || n_nationkey AS wiki_title, true AS infobox FROM nation UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey, false FROM nation")
def dump_at_offsets(spark, sf):
    """Only the streams that hold wanted pages are read, each once, at the offsets that the title index gives."""
    dump, titles = _streams(spark, sf)
    wanted = readers.title_index(spark, titles).where("wiki_title rlike '^[AN][0-9]+$'")
    rows = readers.pages_at(wanted, dump)
    return rows.select("page_id", "wiki_title", F.col("text").contains("{{Infobox").alias("infobox"))


@register("""SELECT kind || n_nationkey AS wiki_title, kind || n_nationkey AS page_id, true AS placed FROM nation, (SELECT unnest(['N', 'R', 'A']) AS kind)""")
def title_index_round_trip(spark, sf):
    """The compressed index of a stream dump, read in partitions; offsets of streams."""
    _, titles = _streams(spark, sf)
    return readers.title_index(spark, titles, 3).select("wiki_title", "page_id", (F.col("offset") >= 0).alias("placed"))


@register(f"SELECT source_file, price AS price, beds, school_district IS NULL AS no_district, title FROM ({_LISTINGS})")
def extraction_log_round_trip(spark, sf):
    """Markdown and extracted record of each page."""
    path = shared.fresh(spark, "log")
    writers.extraction_log(E.extraction_records(_html_listings(spark, sf)), path)
    log = spark.read.schema("source_file string, markdown string, record string").json(path)
    r = F.col("record")
    title = F.regexp_extract("markdown", r"(?m)^# (.+)$", 1)
    return log.select("source_file", F.get_json_object(r, "$.price").alias("price"), F.get_json_object(r, "$.beds").cast("int").alias("beds"), F.get_json_object(r, "$.school_district").isNull().alias("no_district"), title.alias("title"))


def _articles(spark, sf) -> DataFrame:
    return E.resolve(catalog._wanted(spark, sf), catalog._dump(spark, sf).withColumn("xml", F.concat(F.lit("<page>"), "wiki_title", F.lit("</page>"))))


@register("""SELECT 'TX' AS state, 'A' || n_nationkey || '.' || kind AS file, kind = 'xml' AS is_xml FROM nation, (SELECT unnest(['xml', 'json']) AS kind)""")
def article_files_round_trip(spark, sf):
    """<state>/<title>.xml and <state>/<title>.json of each article."""
    path = shared.fresh(spark, "articles")
    writers.article_files(_articles(spark, sf), path)
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    state = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return files.select(state.alias("state"), F.regexp_extract("path", r"/([^/]+)$", 1).alias("file"), (F.col("value") == F.concat(F.lit("<page>"), F.regexp_extract("path", r"/([^/]+)\.[a-z]+$", 1), F.lit("</page>"))).alias("is_xml"))


@register("SELECT 'TX' AS state, 'A' || n_nationkey AS wiki_title, 'A' || n_nationkey AS file_name FROM nation")
def articles_by_state_round_trip(spark, sf):
    path = shared.fresh(spark, "by_state")
    writers.articles_by_state(_articles(spark, sf), path)
    return spark.read.json(path).select("state", "wiki_title", "file_name")


@register(f"""{_MAP_ALL} SELECT property_id, kind AS match_type, CASE kind WHEN 'city' THEN '12' END AS population, kind = 'city' AS city_only FROM mp""")
def metadata_round_trip(spark, sf):
    """Nested match records as JSON lines, read with the declared schema."""
    path = shared.fresh(spark, "matches")
    writers.jsonl(E.match_metadata(_mapped(spark, sf)), path, nulls=False)
    rows = readers.match_metadata(spark, path)
    return rows.select("property_id", "match_type", F.try_element_at("city", F.lit("population")).alias("population"), F.col("school_district").isNull().alias("city_only"))


@register(f"""{_MAP_ALL} SELECT property_id, state || '/' || replace(replace(wiki_title, '/', '_'), ':', '_') || '.xml' AS wiki_page_path, CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS match_confidence FROM mp""")
def joined_round_trip(spark, sf):
    """The join of listings and matches as one named file, read back and unnested."""
    path = shared.fresh(spark, "joined") + "/joined.jsonl"
    listings = _listing_table(spark, sf)
    writers.named_jsonl(E.join_matches(listings, E.match_metadata(_mapped(spark, sf, listings))), path)
    rows = readers.joined_properties(spark, path).select("property_id", F.explode("wiki_data").alias("m"))
    return rows.select("property_id", "m.wiki_page_path", "m.match_confidence")


@register("SELECT 'districts' AS stage, (SELECT count(*) FROM part) AS records, 0.7 AS threshold, true AS has_application")
def run_summary_round_trip(spark, sf):
    path = shared.fresh(spark, "summary")
    writers.run_summary(spark, path, stage="districts", records=table(spark, sf, "part").count(), threshold=0.7)
    rows = spark.read.schema("application_id string, stage string, records long, threshold double").json(path)
    return rows.select("stage", "records", "threshold", (F.length("application_id") > 0).alias("has_application"))


# --- indexes that are written and opened -------------------------------------------------------


def _stored_index(spark, sf) -> str:
    path = shared.fresh(spark, "index")
    index.build(table(spark, sf, "documents"), keep=("lang",)).save(path)
    return path


@register(catalog.ORACLES["bm25_all_scores"])
def stored_index_scores(spark, sf):
    return rank.scores(index.load(spark, _stored_index(spark, sf)), catalog.TERMS).select("doc_id", F.round("score", 6).alias("score"))


@register(catalog.ORACLES["tfidf_top10"])
def searcher_top10(spark, sf):
    """The interactive searcher over a stored index."""
    found = rank.Searcher(index.load(spark, _stored_index(spark, sf)))
    rows = found.top_k(catalog.TERMS, "tfidf", 10).collect()
    found.close()
    return spark.createDataFrame(rows, "doc_id long, score double")


@register(catalog.ORACLES["posting_lists"])
def tagged_index_round_trip(spark, sf):
    """The index as tagged JSON lines: metadata, terms and documents in one file."""
    path = shared.fresh(spark, "tagged")
    index.save_tagged(index.build(table(spark, sf, "documents"), keep=("lang",)), path)
    _, terms, _ = readers.tagged_index(spark, path)
    told = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), " ")
    return terms.select("term", told.alias("postings"), "doc_freq")


@register(catalog.ORACLES["query_combined"])
def stored_fielded_index(spark, sf):
    path = shared.fresh(spark, "fielded")
    fielded.build(table(spark, sf, "documents"), "doc_id", catalog._FIELDS, "text").save(path)
    found = Q.scores(fielded.load(spark, path), "(that OR ened) AND lang:en AND n_chars:[* TO 3000]")
    return found.select("doc_id", F.round("score", 6).alias("score"))


# --- pages to listings -------------------------------------------------------------------------


def _html_listings(spark: SparkSession, sf: str) -> DataFrame:
    """The invented listings as pages: each block of their Markdown is a paragraph, the first a heading."""
    rows = catalog._listing_text(spark, sf)
    blocks = F.split("content", "\n\n")
    tagged = F.transform(blocks, lambda b, i: F.when(i == 0, F.concat(F.lit("<h1>"), F.substring(b, 3, 1000), F.lit("</h1>"))).otherwise(F.concat(F.lit("<p>"), F.replace(b, F.lit("&"), F.lit("&amp;")), F.lit("</p>"))))
    noise = '<script>var x = "<p>$1</p>";</script><style>p { color: red }</style><svg><path d="1 Beds"/></svg><link rel="x">'
    page = F.concat(F.lit(f"<html><head><title>page</title>{noise}</head><body>"), F.array_join(tagged, "\n"), F.lit("</body></html>"))
    return rows.select("file_hash", "source_file", page.alias("html"))


@register(_LISTINGS)
def html_listings(spark, sf):
    """HTML to Markdown to the 17 columns."""
    return E.extract_listings(_html_listings(spark, sf))


@register(f"SELECT * REPLACE (file_hash || '.html' AS source_file) FROM ({_LISTINGS})")
def extraction_command(spark, sf):
    """The command: a folder of pages to a table of listings."""
    path = shared.fresh(spark, "run")
    writers.page_files(_html_listings(spark, sf).select(F.col("file_hash").alias("name"), "html"), f"{path}/pages", "name")
    cli.extraction(spark, f"{path}/pages", f"{path}/out")
    return spark.read.parquet(f"{path}/out/parsed/parsed.parquet")


@register("SELECT p_partkey, '## ' || p_name || chr(10) || chr(10) || p_brand || ' & ' || p_type || chr(10) || chr(10) || '* one' || chr(10) || chr(10) || '* ' || p_size || chr(10) || chr(10) || 'a' || chr(10) || 'b' AS markdown FROM part")
def markdown_blocks(spark, sf):
    """Headings, paragraphs, entities, lists and line breaks."""
    p = table(spark, sf, "part")
    page = F.concat(F.lit("<body><nav></nav><h2> "), "p_name", F.lit("</h2><p>"), "p_brand", F.lit("  &amp;\n "), "p_type", F.lit("</p><ul><li>one</li><li>"), F.col("p_size").cast("string"), F.lit("</li></ul><div>a<br>b</div></body>"))
    return p.select("p_partkey", H.html_to_markdown(page).alias("markdown"))


_ABSOLUTE = rf"""SELECT DISTINCT url AS src, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS dst FROM (SELECT url, unnest(regexp_extract_all({catalog._CLEAN}, {catalog._HREF}, 1)) AS href FROM pages) WHERE starts_with(href, '/')"""


@register(f"SELECT * FROM ({_ABSOLUTE}) WHERE contains(dst, 'blog.') AND contains(dst, '/de')")
def site_links(spark, sf):
    """Links of one kind of host and path only."""
    return crawl.links(table(spark, sf, "pages"), host="blog.", path="/de")


@register("""SELECT c_custkey, form, 'https://h.example' || CASE form WHEN 0 THEN '/a/b/x' || c_custkey WHEN 1 THEN '/x' || c_custkey WHEN 2 THEN '/a/x' || c_custkey WHEN 3 THEN '/a/b/c?q=' || c_custkey WHEN 4 THEN '/a/b/x' || c_custkey END AS url FROM customer, (SELECT unnest([0, 1, 2, 3, 4]) AS form)
UNION ALL SELECT c_custkey, 5, 'http://o.example/' || c_custkey FROM customer""")
def resolved_urls(spark, sf):
    """Relative references of each form against one base."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    forms = [F.concat(F.lit("x"), key), F.concat(F.lit("/x"), key), F.concat(F.lit("../x"), key), F.concat(F.lit("?q="), key), F.concat(F.lit("./x"), key), F.concat(F.lit("http://o.example/"), key)]
    rows = c.select("c_custkey", F.posexplode(F.array(*forms)).alias("form", "href"))
    return rows.select("c_custkey", "form", H.absolute_url(F.lit("https://h.example/a/b/c"), F.col("href")).alias("url"))


# --- small operators ---------------------------------------------------------------------------


@register(f"""WITH l AS ({_LISTINGS}), c AS (SELECT {', '.join(f'count({f.name}) AS {f.name}' for f in schema.PROPERTIES.fields)} FROM l) UNPIVOT c ON COLUMNS(*) INTO NAME field VALUE n""")
def field_counts(spark, sf):
    return E.sorted_field_counts(_listing_table(spark, sf))


@register("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 20")
def first_pages(spark, sf):
    """The first n pages are the feature; without n, all of them, the last one too."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    assert readers.first(pages, None, "page_id") is pages
    return readers.first(pages, 20, "page_id")


@register(f"SELECT file_hash, title FROM ({_LISTINGS}) ORDER BY file_hash LIMIT 3")
def sample_records(spark, sf):
    """The first three records, as a run shows them."""
    return readers.first(_listing_table(spark, sf).select("file_hash", "title"), 3, "file_hash")


@register("SELECT p_partkey, coalesce(p_name, '') || ' ' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS body FROM part")
def document_texts(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.document_text(F.col("p_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_type"))).alias("body"))


@register("SELECT p_partkey, CAST(p_size AS BIGINT) AS tokens FROM part")
def bpe_counts(spark, sf):
    """Tokens of a byte-level vocabulary: a frequent word and its space are one."""
    rows = table(spark, sf, "part").select("p_partkey", F.rtrim(F.repeat(F.lit("the "), F.col("p_size"))).alias("body"))
    return rows.select("p_partkey", X.token_counter(_vocabulary())("body").alias("tokens"))


def _vocabulary() -> str:
    folder = os.environ.get("SILTSTONE_TOKENIZERS")
    if folder:
        return os.path.join(folder, "byte_bpe_50k.json")
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("""WITH t AS (SELECT sum(p_size) AS a, count(*) AS b FROM part) SELECT * FROM (SELECT 'words' AS field, CAST(a AS DOUBLE) AS tokens FROM t UNION ALL SELECT 'key', CAST(b AS DOUBLE) FROM t UNION ALL SELECT 'TOTAL', CAST(a + b AS DOUBLE) FROM t UNION ALL SELECT 'AVERAGE', (a + b) / b FROM t)""")
def bpe_token_report(spark, sf):
    rows = table(spark, sf, "part").select(F.rtrim(F.repeat(F.lit("the "), F.col("p_size"))).alias("words"), F.lit("a").alias("key"))
    return X.token_report(rows, _vocabulary())


@register(r"""WITH t AS (SELECT len(list_filter(regexp_split_to_array(coalesce(text, 'null'), '\s+'), lambda x: x <> '')) AS a, len(list_filter(regexp_split_to_array(coalesce(lang, 'null'), '\s+'), lambda x: x <> '')) AS b FROM documents), s AS (SELECT sum(a) AS a, sum(b) AS b, count(*) AS n FROM t)
SELECT * FROM (SELECT 'text' AS field, CAST(a AS DOUBLE) AS tokens FROM s UNION ALL SELECT 'lang', CAST(b AS DOUBLE) FROM s UNION ALL SELECT 'TOTAL', CAST(a + b AS DOUBLE) FROM s UNION ALL SELECT 'AVERAGE', (a + b) / n FROM s)""")
def text_token_report(spark, sf):
    """Words of whole texts."""
    return X.token_report(table(spark, sf, "documents").select("text", "lang"))


@register("""SELECT n_nationkey, '{"students":"' || format('{:,}', n_nationkey * 1000 + 1234) || '","schools":"' || (n_nationkey + 2) || '","grades":"K-12","budget":"5.5","superintendent":"Ann ' || n_name || '","established":"1901"}' AS facts FROM nation""")
def district_facts(spark, sf):
    n = table(spark, sf, "nation")
    text = F.concat(
        F.lit("{{Infobox school district\n| enrollment = "), F.format_number(F.col("n_nationkey") * 1000 + 1234, 0), F.lit(" (2020)\n| num_schools = "), (F.col("n_nationkey") + 2).cast("string"),
        F.lit("\n| grades = K-12<ref>x</ref>\n| revenue = $5.5 million\n| admin = [[Ann "), "n_name", F.lit("]]\n| founded = 1901\n}}\n"),
    )
    return n.select("n_nationkey", F.to_json(W.district_properties(text)).alias("facts"))


@register("SELECT 'A' || n_nationkey AS wiki_title, length('{{Infobox settlement' || chr(10) || '| name = ' || n_name || chr(10) || '| population_total = ' || format('{:,}', n_nationkey * 1000 + 1234) || '<ref>census</ref>' || chr(10) || '| area_total_km2 = ' || n_nationkey || '.5 sq&nbsp;km' || chr(10) || '| elevation_ft = 12.' || chr(10) || '| timezone = [[EST]]' || chr(10) || '| founded = <!-- x --> 1' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || chr(10) || '}}' || chr(10) || 'A city in Texas, TX county seat. ') + 80 AS text_length FROM nation")
def article_lengths(spark, sf):
    return E.resolve(catalog._wanted(spark, sf), catalog._dump(spark, sf)).select("wiki_title", F.col("text_length").cast("long").alias("text_length"))


@register("SELECT wiki_title, count(*) AS n, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS offsets FROM (SELECT 'A' || n_regionkey AS wiki_title, n_nationkey AS o FROM nation) GROUP BY wiki_title")
def pages_by_offset(spark, sf):
    """Wanted pages collected by the place where they are read."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("offset"), F.concat(F.lit("A"), "n_regionkey").alias("wiki_title"), F.col("n_nationkey").alias("page_id"))
    rows = readers.by_offset(n)
    ids = F.array_sort(F.transform("wanted", lambda w: w["page_id"].cast("int")))
    return rows.select(F.get("wanted", 0)["wiki_title"].alias("wiki_title"), F.size("wanted").cast("long").alias("n"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("offsets"))


# --- mapping, whole ----------------------------------------------------------------------------


def _mapped(spark, sf, listings: DataFrame | None = None) -> DataFrame:
    return shared.stage(catalog._mapping(spark, sf, listings), "mapping")


_KIND_COUNTS = """count(*) FILTER (kind = 'school_district') AS by_district, count(*) FILTER (kind = 'city') AS by_city, count(*) FILTER (score >= 0.95) AS high, count(*) FILTER (score >= 0.8 AND score < 0.95) AS medium, count(*) FILTER (score < 0.8) AS low"""


@register(f"{_MAP_ALL} SELECT count(*) AS records, {_KIND_COUNTS} FROM mp")
def mapping_kinds(spark, sf):
    """Records by type and by confidence."""
    listings = _listing_table(spark, sf)
    return E.mapping_summary(listings, _mapped(spark, sf, listings)).select("records", "by_district", "by_city", "high", "medium", "low")


FACTS = '{"population":"1,200","area_km2":"10.555","elevation_ft":"12","students":"300","schools":"4"}'


def _joined(spark, sf) -> DataFrame:
    listings = _listing_table(spark, sf)
    mapping = _mapped(spark, sf, listings).withColumn("extracted_properties", F.lit(FACTS))
    return shared.stage(E.join_matches(listings, E.match_metadata(mapping)), "joined")


_HAS = "has AS (SELECT property_id, bool_or(kind = 'city') AS c, bool_or(kind = 'school_district') AS d FROM mp GROUP BY property_id)"
_DOCS = f"""{_MAP_ALL}, {_HAS}, doc AS (SELECT l.file_hash AS property_id, l.title, description, CAST(replace(substr(price, 2), ',', '') AS BIGINT) AS price, beds, baths, sqft, city, county, regexp_extract(l.title, '\\b([A-Z]{{2}})\\s+\\d{{5}}', 1) AS state, school_district, property_type,
CASE WHEN c THEN 1200 END AS population, CASE WHEN c THEN 10.56 END AS area_km2, CASE WHEN c THEN 12 END AS elevation_ft, CASE WHEN d THEN 300 END AS students, CASE WHEN d THEN 4 END AS schools, has.property_id IS NOT NULL AS enriched FROM l LEFT JOIN has ON l.file_hash = has.property_id)"""


@register(f"{_DOCS} SELECT property_id, price, beds, baths, sqft, state, CAST(population AS BIGINT) AS population, CAST(area_km2 AS DOUBLE) AS area_km2, CAST(elevation_ft AS BIGINT) AS elevation_ft, CAST(students AS BIGINT) AS students, CAST(schools AS BIGINT) AS schools FROM doc WHERE enriched")
def enriched_documents(spark, sf):
    """Typed documents of the listings that some page enriches."""
    rows = fielded.documents(_joined(spark, sf), wiki_only=True)
    return rows.select("property_id", "price", "beds", "baths", "sqft", "state", "population", "area_km2", "elevation_ft", "students", "schools")


def _listing_index(spark, sf) -> fielded.FieldedIndex:
    return fielded.build(fielded.documents(_joined(spark, sf)), "property_id")


def _matches(name: str, where: str, text: str) -> None:
    """A query over listing fields: the documents that it matches."""

    def run(spark, sf):
        return Q.scores(_listing_index(spark, sf), text).select("doc_id")

    run.__name__ = name
    run.__doc__ = text
    register(f"{_DOCS} SELECT property_id AS doc_id FROM doc WHERE {where}")(run)


def _word(column: str, word: str) -> str:
    return f"list_contains(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), '{word}')"


_matches("listing_by_id", "property_id = 'c4ca4238a0b923820dcc509a6f75849b'", "property_id:c4ca4238a0b923820dcc509a6f75849b")
_matches("listing_by_title", _word("title", "green") + " OR " + _word("title", "blue"), "title:green title:blue")
_matches("listing_by_description", _word("description", "promo") + " AND NOT " + _word("description", "small"), "promo NOT small")
_matches("listing_by_price", "price BETWEEN 2000 AND 9000", "price:[2000 TO 9000]")
_matches("listing_by_exact_numbers", "beds = 3 AND baths = 4", "beds:3 AND baths:4")
_matches("listing_by_area", "sqft >= 1000 AND sqft < 1500", "sqft:[1000 TO 1500}")
_matches("listing_by_city", "city = 'Brand#11' OR city = 'Brand#23'", 'city_exact:"Brand#11" OR city_exact:"Brand#23"')
_matches("listing_by_city_words", _word("city", "brand") + " AND " + _word("city", "12"), "city:brand AND city:12")
_matches("listing_by_district", "school_district = 'Brand#12 ISD'", 'school_district_exact:"Brand#12 ISD"')
_matches("listing_by_district_words", _word("school_district", "isd") + " AND NOT " + _word("school_district", "12"), "school_district:isd NOT school_district:12")
_matches("listing_by_place", "state = 'CA' AND property_type = 'House'", "state:CA AND property_type:House")
_matches("listing_by_county", "county LIKE 'ECONOMY%'", "county:ECONOMY*")
_matches("listing_by_city_facts", "population >= 1000 AND area_km2 = 10.56 AND elevation_ft = 12", "population:[1000 TO *] AND area_km2:10.56 AND elevation_ft:[* TO 12]")
_matches("listing_by_district_facts", "students BETWEEN 100 AND 300 AND schools = 4", "students:[100 TO 300] AND schools:4")
_matches("listing_combined", f"({_word('description', 'promo')} OR {_word('description', 'large')}) AND price <= 8000 AND city <> 'Brand#11'", '(promo OR large) AND price:[* TO 8000] AND NOT city_exact:"Brand#11"')


# --- more of the query language ----------------------------------------------------------------


@register(catalog._two("that", "ened", "a.s IS NOT NULL OR b.s IS NOT NULL", "2 * coalesce(a.s, 0) + coalesce(b.s, 0)"))
def query_boost(spark, sf):
    return catalog._fielded(spark, sf, "that^2 ened")


@register(f"""WITH {catalog._ANALYZED}, hit AS (SELECT x.doc_id, x.i FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i AND x.i + 2 WHERE x.term = 'of' AND y.term = 'the' GROUP BY x.doc_id, x.i), ph AS (SELECT doc_id, count(*) AS tf FROM hit GROUP BY doc_id),
w AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df CROSS JOIN st WHERE term IN ('of', 'the'))
SELECT doc_id, round(idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM ph JOIN dl USING (doc_id) CROSS JOIN st CROSS JOIN w""")
def query_sloppy_phrase(spark, sf):
    return catalog._fielded(spark, sf, '"of the"~1')


@register("SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE n_chars = 700 OR n_chars = 1200")
def query_numeric_exact(spark, sf):
    return catalog._fielded(spark, sf, "n_chars:700 OR n_chars:1200")


@register("SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE source LIKE 'src1_'")
def query_escapes_and_wildcards(spark, sf):
    """A question mark for one letter; a backslash takes the next letter as it is."""
    return catalog._fielded(spark, sf, r"source:\src1?")


@register(f"""WITH {catalog._ANALYZED}, {catalog._leaf('a', 'that')}, {catalog._leaf('b', 'ened')}, s AS (SELECT d.doc_id, round(coalesce(a.s, 0) + coalesce(b.s, 0), 6) AS score FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN b ON d.doc_id = b.doc_id WHERE a.s IS NOT NULL OR b.s IS NOT NULL)
SELECT rank, doc_id, score, lang FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) JOIN documents USING (doc_id) WHERE rank <= 10""")
def query_ranked(spark, sf):
    """The ten best with their rank and fields."""
    found = Q.search(fielded.build(table(spark, sf, "documents"), "doc_id", catalog._FIELDS, "text"), "that ened", 10)
    return found.select("rank", "doc_id", "score", "lang")
