"""Schemas of the tables that the engine reads and writes, and the state dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_ATOMS = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType}


def _split(spec: str) -> list[str]:
    """The parts between commas that stand outside of angle brackets."""
    out, depth = [""], 0
    for c in spec:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(spec: str) -> T.DataType:
    head, _, body = spec.strip().partition("<")
    body = body.removesuffix(">")
    if head == "array":
        return T.ArrayType(_type(body))
    if head == "map":
        return T.MapType(*map(_type, _split(body)))
    return _struct(body) if head == "struct" else _ATOMS[head]()


def _struct(spec: str) -> T.StructType:
    """Spark's own DDL parser needs a session, which there is none of at import."""
    pairs = [x.replace(":", " ", 1).split(None, 1) for x in _split(spec)]
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in pairs])


PROPERTIES = _struct("file_hash string, source_file string, title string, price string, beds int, baths int, sqft int, status string, description string, year_built int, price_per_sqft string, lot_size_acres double, property_type string, property_sub_type string, city string, county string, school_district string")
CRAWL_METADATA = _struct("url_hash string, url string, domain string, download_timestamp string, status_code int, content_length int, encoding string, html_file_path string, content_type string, response_time_ms double")
SEEDS = _struct("city string, state string, state_code string, city_slug string, place_key string, error string")
FOUND_PAGES = _struct("offset bigint, page_id string, wiki_title string, entity_name string, entity_type string, state string, state_full string")
ARTICLES = _struct("wiki_title string, original_title string, page_id string, text string, xml string, entity_name string, entity_type string, state string, state_full string, offset bigint, text_length int, content_score double, redirects_followed int, extracted_properties string")
MATCHES = _struct("property_id string, wiki_page_path string, match_type string, matched_based_on string, match_score double, match_confidence string, city map<string,string>, school_district map<string,string>")
JOINED = T.StructType([T.StructField("property_id", T.StringType()), *PROPERTIES.fields[1:], T.StructField("wiki_data", T.ArrayType(T.StructType(MATCHES.fields[1:])))])
DUMP_PAGE = _struct("title string, id string, revision struct<text: string>")
TAGGED_INDEX = _struct("type string, total_docs bigint, avg_doc_length double, term string, postings array<struct<doc_id: bigint, tf: bigint>>, doc_freq bigint, doc_id bigint, doc_length bigint, data string")

# Postal codes and names of the states.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas",
    "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}


def states(spark: SparkSession) -> DataFrame:
    """(state, state_full): 51 rows, safe to broadcast."""
    return spark.createDataFrame(list(STATES.items()), "state string, state_full string")
