import pytest
from pyspark.sql import functions as F

from siltstone.functions import fuzzy as Z
from siltstone.functions import wikitext as W
from siltstone.plans import enrichment as E


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first().v


@pytest.mark.parametrize(
    "name, want",
    [
        ("Austin Independent School District", "austin"),
        ("11 - Conroe ISD", "conroe"),
        ("Cherry Creek 5", "cherry creek"),
        ("Weld County #80 Schools", "weld county"),
        ("Portland, OR", "portland"),
        ("Mason City Schools, TX", "mason city schools"),
        ("A-B  C.D", "a b c d"),
        (" ISD", "isd"),
        (None, ""),
    ],
)
def test_normalize(spark, name, want):
    assert one(spark, Z.normalize, name) == want


@pytest.mark.parametrize("a, b, want", [("Austin ISD", "austin", 1.0), ("San Antonio", "Antonio", 0.9), ("a1 b1 c1", "a1 b1 d1", 0.5), ("x1 y1", "y1 q1 x1", 0.85), ("", "x", 0.0), (None, None, 0.0)])
def test_score(spark, a, b, want):
    assert one(spark, Z.match_score, a, b) == pytest.approx(want)


BOX = "{{Infobox\n| population = <!-- 1 -->12,345<ref>x</ref>\n| pop = 9\n| area_km2 = {{convert|1}}\n| elevation_m =  \n| elevation_ft = 500. ft\n| timezone = [[EST]]\n}}"


def test_infobox(spark):
    assert one(spark, W.city_properties, BOX) == {"population": "12,345", "elevation_ft": "500", "timezone": "EST"}
    assert one(spark, W.city_properties, None) in ({}, None)
    assert one(spark, W.district_properties, "| students = about 1,200 kids\n| grades = K-12\n") == {"students": "1,200", "grades": "K-12"}


def test_redirect_and_disambiguation(spark):
    assert one(spark, W.redirect_target, "#redirect [[A b#s]] x") == "A b"
    assert one(spark, W.redirect_target, " #REDIRECT [[A]]") is None
    assert one(spark, W.is_redirect, " #Redirect [[A]]") is True
    page = "Portland may refer to:\n* [[Portland, Maine]], city in Maine\n* [[Portland, Texas]], a city, TX\n"
    assert one(spark, W.disambiguation_target, page, "Portland", "TX", "Texas") == "Portland, Texas"
    assert one(spark, W.disambiguation_target, page, "Portland", "TX", None) == "Portland, Texas"
    assert one(spark, W.disambiguation_target, page, "Salem", "TX", "Texas") is None
    assert one(spark, W.disambiguation_target, "no", "Portland", "TX", "Texas") is None


def test_content_score(spark):
    text = "{{Infobox}} a city in Texas, county, TX " + "x" * 100
    assert one(spark, W.content_score, text, "TX", "Texas") == pytest.approx(1.0)
    assert one(spark, W.content_score, "short Texas", "TX", "Texas") == 0.0
    assert one(spark, W.content_score, "y" * 200, "TX", None) == 0.0


def test_resolve_follows_hops_and_stops_at_cycles(spark):
    long = "A city in Texas, TX. " + "z" * 100
    dump = spark.createDataFrame([("1", "A", "#REDIRECT [[B#x]]"), ("2", "B", "#REDIRECT [[C]]"), ("3", "C", long), ("4", "X", "#REDIRECT [[Y]]"), ("5", "Y", "#REDIRECT [[X]]")], "page_id string, wiki_title string, text string")
    want = spark.createDataFrame([(1, "0", t, t, "city", "TX", "Texas") for t in ("A", "C", "X", "none")], "offset long, page_id string, wiki_title string, entity_name string, entity_type string, state string, state_full string")
    out = {r.original_title: (r.wiki_title, r.page_id, r.redirects_followed) for r in E.resolve(want, dump).collect()}
    assert out == {"A": ("C", "3", 2), "C": ("C", "3", 0)}


def test_no_match_keeps_the_schema(spark):
    props = spark.createDataFrame([("h", "T, TX 78701", "Austin", None)], "file_hash string, title string, city string, school_district string")
    arts = spark.createDataFrame([], "wiki_title string, page_id string, entity_name string, entity_type string, state string, state_full string, text_length int, extracted_properties string")
    mapping = E.map_properties(props, arts)
    assert {"match_type", "wiki_page_id", "mapping_timestamp"} <= set(mapping.columns)
    assert E.match_metadata(mapping).count() == 0
    assert E.mapping_summary(props, mapping).first().coverage == 0.0
