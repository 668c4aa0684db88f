"""Registered queries of the retrieval and enrichment engine, with their SQL twins.

The test tables hold no listings or articles. Queries over these build them from the tables' own columns
(the frames below), so that the SQL twin can state the expected values from the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import fuzzy, listing
from siltstone.functions import html as H
from siltstone.functions import text as X
from siltstone.functions import wikitext as W
from siltstone.operators import crawl, fielded, fuzzyjoin, index, rank
from siltstone.plans import enrichment as E
from siltstone.plans import query as Q
from siltstone.sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- retrieval ---------------------------------------------------------------------------------

TERMS = "that this with"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOK = rf"""
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+') AND x NOT IN ({_STOP})) AS ws FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM tok) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT doc_id, len(ws) AS dl FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""
_IN = ", ".join(f"'{w}'" for w in TERMS.split())
_BM25 = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
_SCORED = f"SELECT doc_id, round(sum({{}}), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st WHERE term IN ({_IN}) GROUP BY doc_id"


def _index(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> index.Index:
    """Written and opened, as an index is used: texts are analysed once for all that is asked of it."""
    path = shared.fresh(spark, "index")
    index.build(table(spark, sf, "documents"), keep=keep).save(path)
    return index.load(spark, path)


@register(f"WITH {_TOK} SELECT doc_id, CAST(dl AS BIGINT) AS n_tokens FROM dl")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@register(f"WITH {_TOK} SELECT doc_id, term, tf FROM tf")
def term_frequencies(spark, sf):
    return _index(spark, sf).postings.select("doc_id", "term", "tf")


@register(f"WITH {_TOK} SELECT term, df FROM df")
def document_frequencies(spark, sf):
    return _index(spark, sf).terms


@register(f"WITH {_TOK} SELECT term, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings, count(*) AS doc_freq FROM tf GROUP BY term")
def posting_lists(spark, sf):
    told = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), " ")
    return index.posting_lists(_index(spark, sf)).select("term", told.alias("postings"), "doc_freq")


@register(f"WITH {_TOK} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def index_statistics(spark, sf):
    return _index(spark, sf).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@register(f"WITH {_TOK} {_SCORED.format(_BM25)} ORDER BY score DESC, doc_id LIMIT 10")
def bm25_top10(spark, sf):
    return rank.top_k(_index(spark, sf), TERMS, "bm25", 10)


@register(f"WITH {_TOK} {_SCORED.format('tf / dl * ln(n / df)')} ORDER BY score DESC, doc_id LIMIT 10")
def tfidf_top10(spark, sf):
    return rank.top_k(_index(spark, sf), TERMS, "tfidf", 10)


@register(f"WITH {_TOK} {_SCORED.format(_BM25)}")
def bm25_all_scores(spark, sf):
    return rank.scores(_index(spark, sf), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@register(f"""WITH {_TOK}, best AS ({_SCORED.format(_BM25)} ORDER BY score DESC, doc_id LIMIT 5), q AS (SELECT unnest([{_IN}]) AS term)
SELECT b.doc_id, q.term, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df, CASE WHEN df > 0 THEN round(ln(n / df), 4) ELSE 0.0 END AS idf, round(tf / dl, 4) AS tf_normalized, tf IS NOT NULL AS present
FROM best b CROSS JOIN q CROSS JOIN st JOIN dl USING (doc_id) LEFT JOIN df ON df.term = q.term LEFT JOIN tf ON tf.doc_id = b.doc_id AND tf.term = q.term""")
def term_metrics(spark, sf):
    i = _index(spark, sf)
    return rank.term_metrics(i, rank.top_k(i, TERMS, "bm25", 5), TERMS)


@register(f"""WITH {_TOK}, best AS ({_SCORED.format(_BM25)} ORDER BY score DESC, doc_id LIMIT 5)
SELECT doc_id, score, lang, source, 'bm25' AS method FROM best JOIN documents USING (doc_id)""")
def search_rows(spark, sf):
    i = _index(spark, sf, ("lang", "source"))
    return rank.search(i, TERMS, "bm25", 5).select("doc_id", "score", "lang", "source", "method")


@register(r"""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'N/A' WHEN len(ws) <= 20 THEN text ELSE array_to_string(ws[1:20], ' ') || '...' END AS short
FROM (SELECT doc_id, text, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM documents)""")
def limited_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.limit_words(F.col("text")).alias("short"))


@register("""SELECT * FROM (SELECT 'lang' AS field, CAST(count(*) AS DOUBLE) AS tokens FROM documents UNION ALL SELECT 'source', CAST(count(*) AS DOUBLE) FROM documents
UNION ALL SELECT 'TOTAL', CAST(2 * count(*) AS DOUBLE) FROM documents UNION ALL SELECT 'AVERAGE', 2.0 * count(*) / count(*) FROM documents)""")
def token_report(spark, sf):
    return X.token_report(table(spark, sf, "documents").select("lang", "source"))


# --- the query language ------------------------------------------------------------------------

_FIELDS = {"text": "text", "lang": "exact", "source": "exact", "n_chars": "number"}
_ANALYZED = r"""
ws AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
pos AS (SELECT doc_id, ws[i] AS term, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM ws)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM pos GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT doc_id, len(ws) AS dl FROM ws WHERE len(ws) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""
_FIELD_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _leaf(name: str, term: str) -> str:
    return f"{name} AS (SELECT doc_id, {_FIELD_BM25} AS s FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st WHERE term = '{term}')"


def _fielded(spark, sf, text):
    i = fielded.build(table(spark, sf, "documents"), "doc_id", _FIELDS, "text")
    return Q.scores(i, text).select("doc_id", F.round("score", 6).alias("score"))


def _two(a: str, b: str, where: str, score: str, extra: str = "") -> str:
    return f"WITH {_ANALYZED}, {_leaf('a', a)}, {_leaf('b', b)} SELECT d.doc_id, round({score}, 6) AS score FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN b ON d.doc_id = b.doc_id {extra} WHERE {where}"


_BOTH = "coalesce(a.s, 0) + coalesce(b.s, 0)"


@register(_two("that", "ened", "a.s IS NOT NULL OR b.s IS NOT NULL", _BOTH))
def query_or(spark, sf):
    return _fielded(spark, sf, "that ened")


@register(_two("that", "ened", "a.s IS NOT NULL AND b.s IS NOT NULL", _BOTH))
def query_and(spark, sf):
    return _fielded(spark, sf, "that AND ened")


@register(_two("that", "was", "a.s IS NOT NULL AND b.s IS NULL", "a.s"))
def query_not(spark, sf):
    return _fielded(spark, sf, "that NOT was")


@register(f"""WITH {_ANALYZED}, ph AS (SELECT x.doc_id, count(*) AS tf FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND y.i = x.i + 1 WHERE x.term = 'of' AND y.term = 'the' GROUP BY x.doc_id),
w AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df CROSS JOIN st WHERE term IN ('of', 'the'))
SELECT doc_id, round(idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM ph JOIN dl USING (doc_id) CROSS JOIN st CROSS JOIN w""")
def query_phrase(spark, sf):
    return _fielded(spark, sf, '"of the"')


@register(f"WITH {_ANALYZED} SELECT DISTINCT doc_id, CAST(1 AS DOUBLE) AS score FROM tf WHERE term LIKE 'thon%'")
def query_prefix(spark, sf):
    return _fielded(spark, sf, "thon*")


@register(f"WITH {_ANALYZED} SELECT DISTINCT doc_id, CAST(1 AS DOUBLE) AS score FROM tf WHERE term LIKE '%tionre'")
def query_leading_wildcard(spark, sf):
    return _fielded(spark, sf, "*tionre")


@register(f"""WITH {_ANALYZED}, near AS (SELECT term, damerau_levenshtein(term, 'thonin') AS d FROM df WHERE length(term) BETWEEN 5 AND 7),
few AS (SELECT term, 1.0 - d / least(length(term), 6) AS w FROM near WHERE d <= 1 ORDER BY d, term LIMIT 50)
SELECT DISTINCT doc_id FROM tf JOIN few USING (term)""")
def query_fuzzy(spark, sf):
    return _fielded(spark, sf, "thonin~1").select("doc_id")


@register("SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE lang = 'fr'")
def query_exact_field(spark, sf):
    return _fielded(spark, sf, "lang:fr")


@register("SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE n_chars BETWEEN 500 AND 1000")
def query_range(spark, sf):
    return _fielded(spark, sf, "n_chars:[500 TO 1000]")


@register("SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE n_chars >= 8000")
def query_open_range(spark, sf):
    return _fielded(spark, sf, "n_chars:[8000 TO *]")


@register(_two("that", "ened", "(a.s IS NOT NULL OR b.s IS NOT NULL) AND d.lang = 'en' AND d.n_chars <= 3000", _BOTH + " + 2.0"))
def query_combined(spark, sf):
    return _fielded(spark, sf, "(that OR ened) AND lang:en AND n_chars:[* TO 3000]")


# --- pages -------------------------------------------------------------------------------------

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<svg[^>]*>.*?</svg>', '', 'g'), '(?i)<link[^>]*/?>', '', 'g')"
_HREF = """'(?i)<a[^>]+href=["'']([^"'']+)["'']'"""


@register(f"SELECT page_id, md5({_CLEAN}) AS clean_md5, CAST(length({_CLEAN}) AS BIGINT) AS n FROM pages")
def cleaned_html(spark, sf):
    clean = H.clean_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("n"))


@register(f"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all({_CLEAN}, {_HREF}, 1)) AS href FROM pages)
WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:') GROUP BY page_id, href""")
def page_links(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(H.hrefs(H.clean_html(F.col("html")))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@register(r"SELECT page_id, md5(url) AS url_hash, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain, CAST(length(html) AS BIGINT) AS content_length FROM pages")
def crawl_metadata(spark, sf):
    rows = crawl.metadata(table(spark, sf, "pages"), F.lit("-"), ("page_id",))
    return rows.select("page_id", "url_hash", "domain", F.col("content_length").cast("long").alias("content_length"))


@register(r"SELECT page_id, regexp_matches(html, '(?i)##\s+[\d,]+\s+results') AS listing FROM pages")
def listing_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", listing.is_listing_page(F.col("html")).alias("listing"))


@register()
def page_markdown(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.html_to_markdown(H.clean_html(F.col("html"))).alias("markdown"))


@register(rf"""SELECT DISTINCT url AS src, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS dst FROM (SELECT url, unnest(regexp_extract_all({_CLEAN}, {_HREF}, 1)) AS href FROM pages) WHERE starts_with(href, '/')""")
def absolute_links(spark, sf):
    return crawl.links(table(spark, sf, "pages"))


# --- crawl -------------------------------------------------------------------------------------


@register("""WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS a, o_orderkey // 2 AS b FROM orders UNION SELECT DISTINCT o_orderkey, o_custkey FROM orders),
r AS (SELECT DISTINCT a AS u, 0 AS depth FROM e WHERE a NOT IN (SELECT b FROM e WHERE b IS NOT NULL) UNION SELECT b, depth + 1 FROM r JOIN e ON r.u = e.a WHERE depth < 3),
m AS (SELECT u, min(depth) AS depth FROM r GROUP BY u) SELECT depth, count(*) AS n FROM m GROUP BY depth""")
def crawl_depths(spark, sf):
    o = table(spark, sf, "orders")
    half = o.select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey div 2").alias("dst"))
    edges = half.unionByName(o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))).distinct()
    # The crawl starts where no link leads.
    roots = edges.join(edges.select(F.col("dst").alias("d")).distinct(), F.col("src") == F.col("d"), "left_anti").select(F.col("src").alias("url")).distinct()
    return crawl.depth_histogram(crawl.breadth_first(roots, edges, 3)).select(F.col("depth"), "n")


@register("""SELECT c_custkey AS k, page, 'https://example.org/sale/s' || c_nationkey || '/' || lower(c_mktsegment) || '/city/' || c_custkey || '?searchQuery=' ||
'%7B%22place%22%3A%20%7B%22city%22%3A%20%22' || lower(c_mktsegment) || '%22%2C%20%22placeId%22%3A%20%22' || c_custkey || '%22%2C%20%22placeType%22%3A%20%22places%22%2C%20%22stateOrProvince%22%3A%20%22s' || c_nationkey ||
'%22%7D%2C%20%22filters%22%3A%20%7B%22city%22%3A%20%22' || lower(c_mktsegment) || '%22%2C%20%22stateOrProvince%22%3A%20%22s' || c_nationkey || '%22%2C%20%22uiTransactionType%22%3A%20%22Sale%22%7D%2C%20%22sortKey%22%3A%20%220%22%2C%20%22sortDirection%22%3A%20%221%22%2C%20%22hasPolygon%22%3A%20false%2C%20%22mapState%22%3A%20%22hidden-all%22%2C%20%22pageNumber%22%3A%20' || page || '%7D' AS url
FROM customer, (SELECT unnest([1, 2]) AS page)""")
def seed_urls(spark, sf):
    c = table(spark, sf, "customer")
    slug = F.lower("c_mktsegment")
    seeds = c.select(F.col("c_mktsegment").alias("city"), F.concat(F.lit("s"), "c_nationkey").alias("state_code"), slug.alias("city_slug"), F.col("c_custkey").cast("string").alias("place_key"), "c_custkey")
    rows = crawl.root_urls(seeds.select("city", "state_code", "city_slug", "place_key"), "https://example.org/sale", 2)
    key = F.regexp_extract("url", r"/city/(\d+)\?", 1).cast("long")
    return rows.select(key.alias("k"), "page", "url")


# --- listings ----------------------------------------------------------------------------------

_STATE_LIST = ", ".join(f"'{s}'" for s in list(schema.STATES)[:25])
_STATES = ", ".join(f"('{a}', '{b}')" for a, b in schema.STATES.items())


def _listing_text(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown of one invented listing a part."""
    p = shared.spread(table(spark, sf, "part"), "p_partkey")
    key, size = F.col("p_partkey"), F.col("p_size")
    body = F.concat(
        F.lit("# "), F.col("p_name"), F.lit(" Lane, "), F.element_at(F.array(*[F.lit(s) for s in list(schema.STATES)[:25]]), (key % 25 + 1).cast("int")), F.lit(" 78701\n\n$"), (key * 7 + 1000).cast("string"),
        F.lit("\n\n"), size.cast("string"), F.lit(" Beds\n\n"), (size % 5 + 1).cast("string"), F.lit(" Baths\n\n"), F.format_number(key + 900, 0), F.lit(" Sq Ft\n\nStatus Active\n\nMLS# A"), key.cast("string"),
        F.lit("\n\nA "), F.col("p_type"), F.lit(" home.\n\nRead More\n\nBuilt in "), (1950 + size).cast("string"), F.lit("\n\n$"), (size + 100).cast("string"), F.lit(" / Sq Ft\n\n0."), (size + 10).cast("string"),
        F.lit(" acres lot\n\nCity\n\n"), F.col("p_brand"), F.lit("\n\nCounty Or Parish\n\n"), F.col("p_type"), F.lit("\n\nSchool District\n\n"), F.when(key % 10 == 0, "None").otherwise(F.concat(F.col("p_brand"), F.lit(" ISD"))),
        F.lit("\n\nProperty Type\n\nHouse\n\nProperty Sub Type\n\nDetached\n"),
    )
    return p.select(F.md5(key.cast("string")).alias("file_hash"), F.concat(key.cast("string"), F.lit(".html")).alias("source_file"), body.alias("content"))


_LISTINGS = f"""
SELECT md5(CAST(p_partkey AS VARCHAR)) AS file_hash, p_partkey || '.html' AS source_file, p_name || ' Lane, ' || st || ' 78701' AS title, '$' || (p_partkey * 7 + 1000) AS price, p_size AS beds, p_size % 5 + 1 AS baths,
CAST(p_partkey + 900 AS INTEGER) AS sqft, 'Active' AS status, 'A ' || p_type || ' home.' AS description, 1950 + p_size AS year_built, '$' || (p_size + 100) AS price_per_sqft, CAST('0.' || (p_size + 10) AS DOUBLE) AS lot_size_acres,
'House' AS property_type, 'Detached' AS property_sub_type, p_brand AS city, p_type AS county, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand || ' ISD' END AS school_district
FROM (SELECT *, ([{_STATE_LIST}])[p_partkey % 25 + 1] AS st FROM part)"""


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed once, as a run does: the stages after read a written table."""
    return shared.stage(E.parse_markdown(_listing_text(spark, sf)), "listings")


@register(_LISTINGS)
def parsed_listings(spark, sf):
    return _listings(spark, sf)


_SPECIAL = f"l AS ({_LISTINGS}), s(state, state_full) AS (VALUES {_STATES}), ls AS (SELECT *, regexp_extract(title, '\\b([A-Z]{{2}})\\s+\\d{{5}}', 1) AS state FROM l)"
_CITY = "SELECT city, c.state, state_full, property_count FROM (SELECT city, state, count(*) AS property_count FROM ls WHERE city IS NOT NULL AND state <> '' GROUP BY ALL) c LEFT JOIN s ON s.state = c.state"
_DISTRICT = "SELECT school_district, c.state, state_full, property_count FROM (SELECT school_district, state, count(*) AS property_count FROM ls WHERE school_district IS NOT NULL AND state <> '' AND lower(school_district) NOT IN ('call school board', 'none', 'n/a', '') GROUP BY ALL) c LEFT JOIN s ON s.state = c.state"


@register(f"WITH {_SPECIAL} {_CITY}")
def city_counts(spark, sf):
    return E.locations(_listings(spark, sf))[0]


@register(f"WITH {_SPECIAL} {_DISTRICT}")
def district_counts(spark, sf):
    return E.locations(_listings(spark, sf))[1]


# --- titles and pages --------------------------------------------------------------------------


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """Title lines "offset:page_id:title" made of cities with state names, codes and alone, and districts."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    name = F.element_at(F.array(*[F.lit(schema.STATES[s]) for s in list(schema.STATES)[:25]]), (F.col("p_partkey") % 25 + 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(s) for s in list(schema.STATES)[:25]]), (F.col("p_partkey") % 25 + 1).cast("int"))
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat("p_brand", F.lit(", "), name)).when(k == 1, F.concat("p_brand", F.lit(", "), code)).when(k == 2, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("_ISD")))
    return p.select(F.concat_ws(":", (F.col("p_partkey") * 10).cast("string"), F.concat(F.lit("p"), "p_partkey"), title).alias("value"))


_TITLES = f"""t AS (SELECT p_partkey * 10 AS "offset", 'p' || p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN p_brand || ', ' || nm WHEN 1 THEN p_brand || ', ' || st WHEN 2 THEN p_brand ELSE p_brand || '_ISD' END AS wiki_title
FROM (SELECT *, ([{_STATE_LIST}])[p_partkey % 25 + 1] AS st, ([{", ".join(f"'{schema.STATES[x]}'" for x in list(schema.STATES)[:25])}])[p_partkey % 25 + 1] AS nm FROM part))"""
_TERMS = f"""ci AS ({_CITY}), di AS ({_DISTRICT}),
tm AS (SELECT city || ', ' || state_full AS term, city AS entity_name, 'city' AS entity_type, state, state_full, property_count, 0 AS form FROM ci WHERE state_full IS NOT NULL
UNION ALL SELECT city || ', ' || state, city, 'city', state, state_full, property_count, 1 FROM ci UNION ALL SELECT city, city, 'city', state, state_full, property_count, 2 FROM ci
UNION ALL SELECT school_district, school_district, 'school_district', state, state_full, property_count, 3 FROM di),
one AS (SELECT * FROM (SELECT *, replace(trim(lower(term)), '_', ' ') AS nt, row_number() OVER (PARTITION BY replace(trim(lower(term)), '_', ' ') ORDER BY entity_type, property_count DESC, entity_name, state, form) AS turn FROM tm) WHERE turn = 1 AND nt <> ''),
found AS (SELECT "offset", page_id, wiki_title, entity_name, entity_type, state, state_full FROM t JOIN one ON replace(trim(lower(wiki_title)), '_', ' ') = nt)"""


def _found(spark, sf, listings: DataFrame | None = None):
    from siltstone.sources import readers

    listings = _listings(spark, sf) if listings is None else listings
    return shared.stage(E.find_pages(readers.parse_title_lines(_titles(spark, sf)), *E.locations(listings)), "found")


@register(f"WITH {_SPECIAL}, {_TITLES}, {_TERMS} SELECT * FROM found")
def found_pages(spark, sf):
    return _found(spark, sf)


_BEST = """SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(entity_name), state, entity_type ORDER BY coalesce(CAST(contains(wiki_title, state_full) AS INT), 0) DESC, coalesce(CAST(contains(wiki_title, ', ' || state) AS INT), 0) DESC, length(wiki_title), wiki_title, "offset") AS turn FROM found) WHERE turn = 1"""


@register(f"WITH {_SPECIAL}, {_TITLES}, {_TERMS} {_BEST}")
def best_pages(spark, sf):
    return E.best_pages(_found(spark, sf))


# --- articles ----------------------------------------------------------------------------------


def _dump(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of nations: N<k> redirects to R<k>, which redirects to A<k>, an infobox of facts; odd k hold
    a disambiguation page between."""
    n = table(spark, sf, "nation").crossJoin(F.broadcast(spark.createDataFrame([("N",), ("R",), ("A",)], "kind string")))
    key = F.col("n_nationkey").cast("string")
    box = F.concat(
        F.lit("{{Infobox settlement\n| name = "), "n_name", F.lit("\n| population_total = "), F.format_number(F.col("n_nationkey") * 1000 + 1234, 0), F.lit("<ref>census</ref>\n| area_total_km2 = "), (F.col("n_nationkey") + 0.5).cast("string"),
        F.lit(" sq&nbsp;km\n| elevation_ft = 12.\n| timezone = [[EST]]\n| founded = <!-- x --> 1"), F.lpad(key, 3, "0"), F.lit("\n}}\nA city in Texas, TX county seat. "), F.lpad(F.lit(""), 80, "z"),
    )
    several = F.concat(F.lit("Name may refer to:\n* [[B"), key, F.lit("|x]], in Ohio\n* [[A"), key, F.lit("#s]], a city in Texas\n"))
    text = F.when(F.col("kind") == "A", box).when(F.col("kind") == "N", F.concat(F.lit("#REDIRECT [[R"), key, F.lit("#top]]"))).when(F.col("n_nationkey") % 2 == 1, several).otherwise(F.concat(F.lit("#redirect [[A"), key, F.lit("]]")))
    return n.select(F.concat("kind", key).alias("page_id"), F.concat("kind", key).alias("wiki_title"), text.alias("text"))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("string")
    return n.select(F.col("n_nationkey").cast("long").alias("offset"), F.lit("x").alias("page_id"), F.concat(F.lit("N"), key).alias("wiki_title"), F.concat(F.lit("A"), key).alias("entity_name"), F.lit("city").alias("entity_type"), F.lit("TX").alias("state"), F.lit("Texas").alias("state_full"))


@register("""SELECT 'A' || n_nationkey AS wiki_title, 'N' || n_nationkey AS original_title, 'A' || n_nationkey AS page_id, CAST(n_nationkey AS BIGINT) AS "offset", CAST(1 AS DOUBLE) AS content_score, 2 AS redirects_followed,
'{"population":"' || (CASE WHEN n_nationkey * 1000 + 1234 >= 1000 THEN format('{:,}', n_nationkey * 1000 + 1234) END) || '","area_km2":"' || n_nationkey || '.5","elevation_ft":"12","timezone":"EST","founded":"1' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '"}' AS extracted_properties FROM nation""")
def resolved_articles(spark, sf):
    rows = E.resolve(_wanted(spark, sf), _dump(spark, sf))
    return rows.select("wiki_title", "original_title", "page_id", "offset", "content_score", "redirects_followed", "extracted_properties")


# --- matching ----------------------------------------------------------------------------------


def _sql_normal(c: str) -> str:
    out = f"trim(lower(coalesce({c}, '')))"
    steps = [out]
    for s in fuzzy.SUFFIXES:
        steps.append(f"CASE WHEN ends_with(x, '{s}') THEN trim(left(x, length(x) - {len(s)})) ELSE x END")
    for pattern, to in fuzzy.REPLACEMENTS:
        flag = ", 'g'"
        body = pattern.replace(r"(?U)[^\w\s]", r"[^\p{L}\p{N}_\s]")
        steps.append(f"regexp_replace(x, '{body}', '{to}'{flag})")
    steps.append("trim(x)")
    # One list, folded: each step sees the result of the one before.
    sql = steps[0]
    for s in steps[1:]:
        sql = f"(SELECT {s} FROM (SELECT {sql} AS x))"
    return sql


def _sql_score(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    shared = f"len(list_intersect({x}, {y}))"
    jac = f"({shared} / CAST(len({x}) + len({y}) - {shared} AS DOUBLE))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9 WHEN {shared} = len({x}) THEN greatest({jac}, 0.85) ELSE {jac} END"


_NAMES = "(SELECT p_partkey, p_brand, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Unified School District' WHEN 1 THEN ' ISD' WHEN 2 THEN ' 12' ELSE ' City Schools, TX' END AS nm FROM part)"


def _names(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 4
    tail = F.when(k == 0, " Unified School District").when(k == 1, " ISD").when(k == 2, " 12").otherwise(" City Schools, TX")
    return p.select("p_partkey", "p_brand", F.concat("p_name", tail).alias("nm"))


@register(f"SELECT p_partkey, {_sql_normal('nm')} AS normal FROM {_NAMES}")
def normalized_names(spark, sf):
    return _names(spark, sf).select("p_partkey", fuzzy.normalize(F.col("nm")).alias("normal"))


@register(f"""WITH n AS (SELECT p_partkey, p_brand, {_sql_normal('nm')} AS v FROM {_NAMES}), p AS (SELECT a.p_partkey AS left_key, b.p_partkey AS right_key, {_sql_score('a.v', 'b.v')} AS score FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY score DESC, right_key) AS turn FROM p WHERE score >= 0.3) SELECT left_key, right_key, round(score, 6) AS score FROM r WHERE turn = 1""")
def fuzzy_best(spark, sf):
    names = _names(spark, sf)
    # Written, so that a condition on normal forms is not evaluated for every row.
    forms = shared.stage(names.select("nm").distinct(), "names").withColumn("v", fuzzy.normalize(F.col("nm")))
    forms = shared.stage(forms, "forms")
    rows = names.join(forms, "nm").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("block"), F.col("v").alias("name"))
    return fuzzyjoin.best_others(shared.stage(rows, "rows"), 0.3).select("left_key", "right_key", F.round("score", 6).alias("score"))


def _mapping(spark, sf, listings: DataFrame | None = None):
    listings = _listings(spark, sf) if listings is None else listings
    pages = E.best_pages(_found(spark, sf, listings)).withColumns({"text_length": F.col("offset").cast("int"), "extracted_properties": F.lit('{"population":"12"}')})
    return E.map_properties(listings, pages, stamp=F.lit("2024-01-01").cast("timestamp"))


_MAPPED = f"""best AS ({_BEST}),
pg AS (SELECT *, {_sql_normal('entity_name')} AS b FROM best), nm AS (SELECT DISTINCT 'city' AS kind, state, city AS name FROM ls WHERE city <> '' UNION SELECT DISTINCT 'school_district', state, school_district FROM ls WHERE school_district <> ''),
na AS (SELECT *, {_sql_normal('name')} AS a FROM nm),
pr AS (SELECT kind, na.state, name, wiki_title, page_id, state_full, "offset", {_sql_score('a', 'b')} AS score FROM na JOIN pg ON na.state = pg.state AND kind = entity_type),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, state, name ORDER BY score DESC, wiki_title, page_id) AS turn FROM pr WHERE score >= 0.7) WHERE turn = 1),
mp AS (SELECT ls.file_hash AS property_id, ls.city, ls.school_district, ls.state, kind, wiki_title, page_id, "offset" AS len, score FROM ls JOIN bp ON ls.state = bp.state AND name = CASE kind WHEN 'city' THEN ls.city ELSE ls.school_district END)"""
_MAP_ALL = f"WITH {_SPECIAL}, {_TITLES}, {_TERMS}, {_MAPPED}"


@register(f"{_MAP_ALL} SELECT property_id, kind || '_fuzzy' AS match_type, wiki_title, page_id AS wiki_page_id, round(score, 6) AS match_score, CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS match_confidence FROM mp")
def property_mapping(spark, sf):
    return _mapping(spark, sf).select("property_id", "match_type", "wiki_title", "wiki_page_id", F.round("match_score", 6).alias("match_score"), "match_confidence")


@register(f"""{_MAP_ALL}, per AS (SELECT property_id, count(DISTINCT kind) AS kinds FROM mp GROUP BY property_id)
SELECT (SELECT count(*) FROM mp) AS records, (SELECT count(*) FROM per) AS matched, (SELECT count(*) FROM per WHERE kinds = 2) AS with_both, (SELECT count(*) FROM l) AS total, round((SELECT count(*) FROM per) * 100.0 / (SELECT count(*) FROM l), 2) AS coverage""")
def mapping_summary(spark, sf):
    listings = _listings(spark, sf)
    return E.mapping_summary(listings, _mapping(spark, sf, listings)).select("records", "matched", "with_both", "total", "coverage")


@register(f"""{_MAP_ALL} SELECT property_id, state || '/' || replace(replace(wiki_title, '/', '_'), ':', '_') || '.xml' AS wiki_page_path, kind AS match_type, CASE kind WHEN 'city' THEN city ELSE school_district END AS matched_based_on,
CASE kind WHEN 'city' THEN '12' END AS city_population FROM mp""")
def match_metadata(spark, sf):
    rows = E.match_metadata(_mapping(spark, sf))
    return rows.select("property_id", "wiki_page_path", "match_type", "matched_based_on", F.try_element_at("city", F.lit("population")).alias("city_population"))


@register(f"""{_MAP_ALL} SELECT school_district, state, count(DISTINCT property_id) AS property_count, count(DISTINCT page_id) AS wiki_page_count, array_to_string(list_sort(list(DISTINCT wiki_title)), '|') AS wiki_pages, round(avg(len), 2) AS avg_wiki_text_length,
round(count(DISTINCT property_id) / count(DISTINCT page_id), 2) AS avg_properties_per_wiki FROM mp WHERE kind = 'school_district' GROUP BY school_district, state""")
def district_statistics(spark, sf):
    return E.district_statistics(_mapping(spark, sf)).withColumn("wiki_pages", F.array_join("wiki_pages", "|"))


@register(f"""{_MAP_ALL} SELECT l.file_hash AS property_id, l.title, count(kind) AS n_matches, coalesce(string_agg(kind, '|' ORDER BY kind), '') AS kinds FROM l LEFT JOIN mp ON l.file_hash = mp.property_id GROUP BY ALL""")
def joined_properties(spark, sf):
    listings = _listings(spark, sf)
    rows = E.join_matches(listings, E.match_metadata(_mapping(spark, sf, listings)))
    return rows.select("property_id", "title", F.coalesce(F.size("wiki_data"), F.lit(0)).cast("long").alias("n_matches"), F.coalesce(F.array_join("wiki_data.match_type", "|"), F.lit("")).alias("kinds"))


@register(f"SELECT p_partkey, CASE WHEN contains(lower(t), 'texas') THEN 100 WHEN contains(lower(t), ', tx') THEN 50 ELSE 1 END AS quality FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ', Texas' WHEN 1 THEN ', TX' ELSE '' END AS t FROM part)")
def title_quality(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 3
    title = F.concat("p_name", F.when(k == 0, ", Texas").when(k == 1, ", TX").otherwise(""))
    return p.select("p_partkey", W.title_quality(title, F.lit("TX"), F.lit("Texas")).alias("quality"))
