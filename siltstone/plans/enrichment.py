"""The enrichment pipeline: listings -> places -> encyclopedia pages -> articles -> mapping -> exports.

Each stage maps DataFrames to a lazy DataFrame; nothing is collected between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import fuzzy, listing
from siltstone.functions import html as H
from siltstone.functions import wikitext as W
from siltstone.operators import fuzzyjoin
from siltstone.sources import shared

MIN_CONTENT = 0.3
MAX_HOPS = 5
THRESHOLD = 0.7


# --- 1 parse -----------------------------------------------------------------------------------


def parse_markdown(rows: DataFrame, content: str = "content") -> DataFrame:
    """The 17 columns of a listing from (file_hash, source_file, content); result pages are dropped."""
    kept = rows.where(F.col(content).isNotNull() & ~listing.is_listing_page(F.col(content)))
    found = kept.select("file_hash", "source_file", *listing.attributes(F.col(content)))
    return found.select(*[F.col(f.name).cast(f.dataType) for f in schema.PROPERTIES.fields])


def extract_listings(pages: DataFrame) -> DataFrame:
    """Listings from (file_hash, source_file, html)."""
    return parse_markdown(pages.withColumn("content", H.html_to_markdown(H.clean_html(F.col("html")))))


def field_counts(rows: DataFrame) -> DataFrame:
    """One row: the non-null values of each column."""
    return rows.agg(*[F.count(F.col(c)).alias(c) for c in rows.columns])


def sorted_field_counts(rows: DataFrame) -> DataFrame:
    """(field, n): the same as a row a field, most first."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in rows.columns])
    return field_counts(rows).select(F.explode(cells).alias("c")).select("c.*").orderBy(F.desc("n"), "field")


def extraction_records(pages: DataFrame) -> DataFrame:
    """(source_file, markdown, record): what the extraction log holds of each page; record is the listing as JSON, null for
    pages of search results."""
    rows = pages.select("file_hash", "source_file", H.html_to_markdown(H.clean_html(F.col("html"))).alias("content"))
    record = F.when(~listing.is_listing_page(F.col("content")), F.to_json(F.struct(*listing.attributes(F.col("content"))), {"ignoreNullFields": "false"}))
    return rows.select("source_file", F.col("content").alias("markdown"), record.alias("record"))


# --- 2 places ----------------------------------------------------------------------------------


def _counted(rows: DataFrame, name: str, states: DataFrame) -> DataFrame:
    counts = rows.groupBy(name, "state").agg(F.count("*").alias("property_count"))
    return counts.join(F.broadcast(states), "state", "left").select(name, "state", "state_full", "property_count").orderBy(F.desc("property_count"), name, "state")


def locations(properties: DataFrame, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cities and school districts with their states and numbers of listings, most first."""
    states = schema.states(properties.sparkSession) if states is None else states
    rows = properties.withColumn("state", listing.state_of_title(F.col("title"))).where("state <> ''")
    cities = _counted(rows.where("city is not null"), "city", states)
    bad = F.lower("school_district").isin(*listing.NO_DISTRICT, "")
    return cities, _counted(rows.where(F.col("school_district").isNotNull() & ~bad), "school_district", states)


# --- 3 titles ----------------------------------------------------------------------------------


def search_terms(cities: DataFrame, districts: DataFrame) -> DataFrame:
    """(term, entity_name, entity_type, state, state_full): each normalised title to look for, once. Of
    entities that ask for the same title, cities come first, then the larger, then by name and state."""
    full, code, bare = F.concat_ws(", ", "city", "state_full"), F.concat_ws(", ", "city", "state"), F.col("city")
    forms = F.array(F.when(F.col("state_full").isNotNull(), full), code, bare)
    city = cities.select(F.posexplode(forms).alias("form", "term"), F.col("city").alias("entity_name"), F.lit("city").alias("entity_type"), "state", "state_full", "property_count")
    district = districts.select(F.lit(3).alias("form"), F.col("school_district").alias("term"), F.col("school_district").alias("entity_name"), F.lit("school_district").alias("entity_type"), "state", "state_full", "property_count")
    rows = city.unionByName(district).withColumn("term", W.normalize_title(F.col("term"))).where("term <> ''")
    first = Window.partitionBy("term").orderBy(F.col("entity_type"), F.desc("property_count"), "entity_name", "state", "form")
    return rows.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").select("term", "entity_name", "entity_type", "state", "state_full")


def find_pages(titles: DataFrame, cities: DataFrame, districts: DataFrame) -> DataFrame:
    """The lines of a title index (offset, page_id, wiki_title) that some entity asks for. The terms are an
    aggregate of the listings; Spark broadcasts them only while its own size estimate allows it."""
    terms = search_terms(cities, districts)
    rows = titles.join(terms, W.normalize_title(titles.wiki_title) == terms.term)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.FOUND_PAGES.fields])


# --- 4 one page each ---------------------------------------------------------------------------


def best_pages(found: DataFrame) -> DataFrame:
    """One page of each entity: titles with the state's name first, then with its code, then short ones."""
    has = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    by = Window.partitionBy(F.lower("entity_name"), "state", "entity_type").orderBy(
        F.desc(has(F.col("wiki_title").contains(F.col("state_full")))),
        F.desc(has(F.col("wiki_title").contains(F.concat(F.lit(", "), F.col("state"))))),
        F.length("wiki_title"), "wiki_title", "offset",
    )
    return found.withColumn("_turn", F.row_number().over(by)).where("_turn = 1").drop("_turn")


# --- 5 articles --------------------------------------------------------------------------------


def resolve(pages: DataFrame, dump: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Articles of the wanted pages, with redirects and disambiguation pages followed by title.

    dump: (page_id, wiki_title, text[, xml]). Targets are looked up in the whole dump, of which a narrow table is made
    first: title, where a redirect leads, and the links of disambiguation pages. A hop joins the open
    requests with it and is written; texts are read once, for the titles that requests end on."""
    dump = dump.select(F.col("wiki_title").alias("at"), F.col("page_id").alias("dump_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.col("xml")] if "xml" in dump.columns else [F.lit(None).cast("string").alias("xml")]))
    redirect, several = W.is_redirect(F.col("text")), W.is_disambiguation(F.col("text"))
    narrow = dump.select("at", "dump_id", redirect.alias("redirect"), (~redirect & several).alias("several"), F.when(redirect, W.redirect_target(F.col("text"))).alias("target"), F.when(~redirect & several, W.disambiguation_links(F.col("text"))).alias("links"))
    narrow = shared.stage(narrow, "titles")
    open_ = pages.withColumns({"original_title": F.col("wiki_title"), "at": F.col("wiki_title")}).drop("page_id", "wiki_title")
    done = None
    for hop in range(max_hops):
        found = shared.stage(open_.join(narrow, "at"), "hop")
        ended = found.where("not redirect and not several").drop("redirect", "several", "target", "links").withColumn("redirects_followed", F.lit(hop))
        done = ended if done is None else done.unionByName(ended)
        target = F.when(F.col("redirect"), F.col("target")).otherwise(W.pick_link(F.col("links"), F.col("entity_name"), F.col("state"), F.col("state_full")))
        open_ = found.where("redirect or several").withColumn("at", target).where("at is not null").drop("dump_id", "redirect", "several", "target", "links")
        if hop + 1 < max_hops and open_.isEmpty():
            break
    texts = dump.select(F.col("at").alias("at2"), F.col("dump_id").alias("dump_id2"), "text", "xml")
    done = done.join(texts, (F.col("at") == F.col("at2")) & F.col("dump_id").eqNullSafe(F.col("dump_id2")))
    scored = done.withColumn("content_score", W.content_score(F.col("text"), F.col("state"), F.col("state_full"))).where(F.col("content_score") >= MIN_CONTENT)
    kinds = F.when(F.col("entity_type") == "city", F.to_json(W.city_properties(F.col("text")))).otherwise(F.to_json(W.district_properties(F.col("text"))))
    out = scored.withColumns({"wiki_title": F.col("at"), "page_id": F.col("dump_id"), "text_length": F.length("text"), "extracted_properties": kinds})
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema.ARTICLES.fields])


# --- 6 mapping ---------------------------------------------------------------------------------


def best_matches(left: DataFrame, name: str, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of ``left`` (property_id, state_abbr, <name>) the best page of its state, if any is
    similar enough. Normal forms are made once for each distinct name of a state and page, and only names that share a
    rare word or hold each other are compared (fuzzyjoin); ties go to the first title, then page.

    Names and pages are written: a condition on a normal form would be made for every listing, below the distinct names."""
    names = shared.stage(left.select("state_abbr", F.col(name).alias("prop_name")).where("prop_name is not null and prop_name <> ''").distinct(), "names")
    names = shared.stage(names.withColumn("a", fuzzy.normalize(F.col("prop_name"))), "names")
    pages = right.select("entity_name", "state", "state_full", "wiki_title", "page_id", "text_length", "extracted_properties")
    pages = shared.stage(pages.withColumn("b", fuzzy.normalize(F.col("entity_name"))), "pages")
    scored = fuzzyjoin.similar_pairs(names.select(F.col("state_abbr").alias("block"), "a"), pages.select(F.col("state").alias("block"), "b"), threshold)
    scored = scored.select(F.col("block").alias("s_state"), F.col("a").alias("s_a"), F.col("b").alias("s_b"), F.col("score").alias("match_score"))
    pairs = names.join(scored, (names.state_abbr == scored.s_state) & (names.a == scored.s_a)).join(pages, (F.col("s_state") == pages.state) & (F.col("s_b") == pages.b))
    order = Window.partitionBy("state_abbr", "prop_name").orderBy(F.desc("match_score"), "wiki_title", "page_id")
    best = pairs.withColumn("_turn", F.row_number().over(order)).where("_turn = 1")
    best = best.select("state_abbr", F.col("prop_name").alias(name), F.col("wiki_title"), F.col("page_id").alias("wiki_page_id"), F.col("state").alias("wiki_state"), F.col("state_full").alias("wiki_state_full"), F.col("text_length").cast("long").alias("wiki_text_length"), "extracted_properties", "match_score")
    return left.join(best, ["state_abbr", name])


def map_properties(properties: DataFrame, articles: DataFrame, threshold: float = THRESHOLD, stamp: Column | None = None) -> DataFrame:
    """Up to two rows a listing: its best school district page and its best city page."""
    rows = properties.withColumns({"property_id": F.col("file_hash"), "state_abbr": listing.state_of_title(F.col("title"))})
    out = None
    for kind, name in (("school_district", "school_district"), ("city", "city")):
        part = best_matches(rows, name, articles.where(F.col("entity_type") == kind), threshold).withColumn("match_type", F.lit(f"{kind}_fuzzy"))
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"match_confidence": fuzzy.confidence(F.col("match_score")), "mapping_timestamp": F.current_timestamp() if stamp is None else stamp})


def _kinds() -> dict[str, Column]:
    kind, sure = F.col("match_type"), F.col("match_confidence")
    return {"by_district": kind == "school_district_fuzzy", "by_city": kind == "city_fuzzy", "high": sure == "high", "medium": sure == "medium", "low": sure == "low"}


def mapping_summary(properties: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row of counts: records, by type and confidence, listings matched, with both, and coverage."""
    per = mapping.groupBy("property_id").agg(F.count_distinct("match_type").alias("kinds"), F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in _kinds().items()])
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in _kinds()], F.count("*").alias("matched"), F.count_if(F.col("kinds") == 2).alias("with_both"))
    total = properties.agg(F.count("*").alias("total"))
    return sums.crossJoin(total).withColumn("coverage", F.coalesce(F.round(F.try_divide(F.col("matched") * 100.0, F.col("total")), 2), F.lit(0.0)))


# --- 7 export ----------------------------------------------------------------------------------


def match_metadata(mapping: DataFrame) -> DataFrame:
    """Nested records by (property_id, match_type): the page's path and either city or district facts."""
    rows = mapping.where("wiki_page_id is not null")
    kind = F.regexp_replace("match_type", "_fuzzy", "")
    is_city = kind == "city"
    facts = F.coalesce(F.from_json("extracted_properties", "map<string,string>"), F.create_map().cast("map<string,string>"))
    path = F.concat(F.col("wiki_state"), F.lit("/"), W.file_name(F.col("wiki_title")), F.lit(".xml"))
    return rows.select(
        "property_id", path.alias("wiki_page_path"), kind.alias("match_type"), F.when(is_city, F.col("city")).otherwise(F.col("school_district")).alias("matched_based_on"),
        "match_score", "match_confidence", F.when(is_city, facts).alias("city"), F.when(~is_city, facts).alias("school_district"),
    ).orderBy("property_id", "match_type")


# --- 8 statistics ------------------------------------------------------------------------------


def district_statistics(mapping: DataFrame) -> DataFrame:
    rows = mapping.where(F.col("match_type").contains("school_district") & F.col("wiki_page_id").isNotNull())
    stats = rows.groupBy("school_district", F.col("state_abbr").alias("state")).agg(
        F.count_distinct("property_id").alias("property_count"), F.count_distinct("wiki_page_id").alias("wiki_page_count"),
        F.array_sort(F.collect_set("wiki_title")).alias("wiki_pages"), F.round(F.avg("wiki_text_length"), 2).alias("avg_wiki_text_length"),
    )
    per = F.round(F.try_divide(F.col("property_count"), F.col("wiki_page_count")), 2)
    return stats.withColumn("avg_properties_per_wiki", per).orderBy(F.desc("property_count"), "school_district", "state")


# --- join --------------------------------------------------------------------------------------


def join_matches(properties: DataFrame, matches: DataFrame) -> DataFrame:
    """Listings with ``wiki_data``, the array of their matches; null where there is none."""
    fields = [f.name for f in schema.MATCHES.fields if f.name != "property_id"]
    # Maps do not sort: the other fields order the entries.
    cell = F.struct(*fields)
    nested = matches.groupBy("property_id").agg(F.collect_list(cell).alias("items"))
    less = lambda a, b: F.when(F.struct(a["match_type"], a["wiki_page_path"]) < F.struct(b["match_type"], b["wiki_page_path"]), -1).when(F.struct(a["match_type"], a["wiki_page_path"]) > F.struct(b["match_type"], b["wiki_page_path"]), 1).otherwise(0)
    nested = nested.select("property_id", F.array_sort("items", less).alias("wiki_data"))
    return properties.withColumnRenamed("file_hash", "property_id").join(nested, "property_id", "left")
