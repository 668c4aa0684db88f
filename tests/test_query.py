"""The query language on a small corpus."""

import re

import pytest

from siltstone.operators import fielded
from siltstone.plans import query as Q

ROWS = [
    ("p1", "Luxury home with pool", "Modern luxury home, pool and garden", 500000, 3, "Dallas", "TX", 1200000),
    ("p2", "Apartment", "Downtown apartment with luxury finish", 300000, 2, "Austin", "TX", 900000),
    ("p3", "House", "Ranch style house near the pool", 750000, 4, "Dallas", "TX", 1200000),
    ("p4", "Houses", "Modern houses in The Dalles", 900000, None, "The Dalles", "OR", None),
    ("p5", None, None, None, 0, None, None, None),
]
FIELDS = {"property_id": "exact", "title": "text", "description": "text", "price": "number", "beds": "number", "city_exact": "exact", "state": "exact", "population": "number"}


@pytest.fixture(scope="module")
def idx(spark):
    docs = spark.createDataFrame(ROWS, "property_id string, title string, description string, price long, beds int, city_exact string, state string, population long")
    return fielded.build(docs, "property_id", FIELDS).cache()


def ids(idx, text):
    return {r.doc_id for r in Q.scores(idx, text).collect()}


@pytest.mark.parametrize(
    "text, want",
    [
        ("luxury pool", {"p1", "p2", "p3"}),
        ("luxury AND pool", {"p1"}),
        ("luxury && pool", {"p1"}),
        ("ranch OR downtown", {"p2", "p3"}),
        ("luxury NOT apartment", {"p1"}),
        ("luxury -apartment", {"p1"}),
        ("+pool luxury", {"p1", "p3"}),
        ("NOT luxury", set()),
        ('"luxury home"', {"p1"}),
        ('"home luxury"', set()),
        ('"luxury pool"~1', {"p1"}),
        ("dales~", {"p4"}),
        ("dalels~1", {"p4"}),
        ("house*", {"p3", "p4"}),
        ("*ouse", {"p3"}),
        ("h?use", {"p3"}),
        ("title:house", {"p3"}),
        ("title:(luxury OR apartment)", {"p1", "p2"}),
        ("city_exact:Dallas", {"p1", "p3"}),
        ('city_exact:"The Dalles"', {"p4"}),
        ("city_exact:dallas", set()),
        ("price:[500000 TO 800000]", {"p1", "p3"}),
        ("price:{500000 TO 800000}", {"p3"}),
        ("population:[1000000 TO *]", {"p1", "p3"}),
        ("beds:[* TO 2]", {"p2", "p5"}),
        ("beds:3", {"p1"}),
        ("city_exact:Dallas AND price:[* TO 600000]", {"p1"}),
        ("(luxury OR modern) AND pool AND price:[* TO 500000]", {"p1"}),
        ("luxury NOT price:[400000 TO *]", {"p2"}),
        ("ranch OR beds:2", {"p2", "p3"}),
        ("description:[ranch TO ranches]", {"p3"}),
        ("nothing", set()),
    ],
)
def test_matches(idx, text, want):
    assert ids(idx, text) == want


def test_boost_and_ranks(idx):
    plain = {r.doc_id: r.score for r in Q.scores(idx, "luxury").collect()}
    more = {r.doc_id: r.score for r in Q.scores(idx, "luxury^2").collect()}
    assert all(more[k] == pytest.approx(2 * v) for k, v in plain.items()) and plain
    rows = Q.search(idx, "luxury pool", 2).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0].doc_id == "p1"


@pytest.mark.parametrize("text", ["(a", "a)", "nofield:x", "price:abc", "AND a", "price:[a TO 3]", "a~5", 'x:"'])
def test_unknown_syntax_is_refused(idx, text):
    with pytest.raises(SyntaxError):
        Q.scores(idx, text)


def test_documents_from_listings(spark):
    row = ("h", "House, Austin, TX 78701", "d", "$1,250", 2, 1, 900, "Austin", "Travis", "Austin ISD", "House", [("Texas/A.xml", "city", "Austin", 1.0, "high", {"population": "12,345", "area_km2": "1.5", "elevation_ft": "x"}, None)])
    kind = "property_id string, title string, description string, price string, beds int, baths int, sqft int, city string, county string, school_district string, property_type string, wiki_data array<struct<wiki_page_path: string, match_type: string, matched_based_on: string, match_score: double, match_confidence: string, city: map<string,string>, school_district: map<string,string>>>"
    docs = fielded.documents(spark.createDataFrame([row, ("i", *[None] * 11)], kind))
    r = docs.where("property_id = 'h'").first()
    assert (r.price, r.state, r.population, r.area_km2, r.elevation_ft, r.students) == (1250, "TX", 12345, 1.5, None, None)
    assert docs.count() == 2
    assert fielded.documents(spark.createDataFrame([row, ("i", *[None] * 11)], kind), wiki_only=True).count() == 1


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text, test", [("dales~1", "dalles"), ("hous*", "RLIKE|StartsWith"), ("description:[ranch TO ranches]", "ranches")])
def test_only_postings_of_the_query_are_made(spark, text, test):
    """The condition on terms is below the aggregation that makes postings, and no distance is evaluated there."""
    rows = spark.createDataFrame(ROWS, "property_id string, title string, description string, price long, beds int, city_exact string, state string, population long")
    got = Q.scores(fielded.build(rows, "property_id", FIELDS), text)
    assert got.count()
    lines = _plan(got).splitlines()
    made = [i for i, line in enumerate(lines) if "Aggregate [field" in line and "doc_id" in line and "count(1)" in line]
    assert made and all(any(re.search(test, x) and "Filter" in x for x in lines[i + 1 : i + 4]) for i in made)
    assert not any("levenshtein" in x and "Filter" in x for x in lines)
