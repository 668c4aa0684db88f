"""Extractors on literal listings."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import listing as L
from siltstone.functions import text as X
from siltstone.plans import enrichment as E


def value(spark, f, content):
    return spark.createDataFrame([(content,)], "c string").select(f(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(
    "f, content, want",
    [
        (L.extract_title, "x\n#  A House \n# B", "A House"),
        (L.extract_price, "$1 / Sq Ft\nwas $5,000 now $4,500.00 ok\n$9", "$4,500.00"),
        (L.extract_price, "$3 per acre", None),
        (L.extract_beds, "3 Beds", 3),
        (L.extract_beds, "Bedrooms Total\n\n4", 4),
        (L.extract_baths, "2 Baths Full", 2),
        (L.extract_baths, "2 Bath Full", None),
        (L.extract_baths, "Bathroom Total \n 5", 5),
        (L.extract_sqft, "1,234 Sq Ft", 1234),
        (L.extract_sqft, "12 Sq Ft / x\nLiving Area\n2,000 SqFt", 2000),
        (L.extract_sqft, ", Sq Ft", None),
        (L.extract_status, "Status  Active now", "Active"),
        (L.extract_description, "MLS# A1\n\nNice.\n\nRead More", "Nice."),
        (L.extract_description, "MLS A1 \n\nNice.\n\n## Details", "Nice."),
        (L.extract_year_built, "Built in 2031\nYear Built\n1999", 1999),
        (L.extract_year_built, "built in 1999", None),
        (L.extract_price_per_sqft, "$1,250 /Sq Ft", "$1,250"),
        (L.extract_lot_size, "20000 acres lot\nLot Size Acres\n0.5", 0.5),
        (L.extract_lot_size, "1.2.3 acre lot\n7 Acres", 7.0),
        (L.extract_city, "City\n\nDallas \nx", "Dallas"),
        (L.extract_county, "county or parish\nTravis", "Travis"),
        (L.extract_school_district, "School District\nN/A\n\nx", None),
        (L.extract_school_district, "School District\nAustin ISD", "Austin ISD"),
        (L.extract_property_type, "Property Type\nHouse", "House"),
        (L.extract_property_sub_type, "Property Sub Type\nDetached", "Detached"),
        (L.state_of_title, "1 Main St, Austin, TX 78701", "TX"),
        (L.state_of_title, "12 NW MAIN ST MIAMI, FL 33131", "FL"),
        (L.state_of_title, "Austin", ""),
        (X.limit_words, None, "N/A"),
        (X.limit_words, "a  b", "a  b"),
        (X.limit_words, " ".join("abcdefghijklmnopqrstuvwxyz"), "a b c d e f g h i j k l m n o p q r s t..."),
        (X.tokenize, "The éclair eats_x 3rd House, house!", ["house", "house"]),
        (X.tokenize, None, []),
    ],
)
def test_extractor(spark, f, content, want):
    assert value(spark, f, content) == want


def test_null_content_is_null(spark):
    row = spark.createDataFrame([(None,)], "c string").select(*L.attributes(F.col("c"))).first()
    assert all(v is None for v in row)


def test_clean_html_modes(spark):
    html = "<STYLE>a\nb</STYLE><script src=x>1</script><svg><a/></svg><link rel=x/>t"
    assert value(spark, H.clean_html, html) == "t"
    assert value(spark, lambda c: H.clean_html(c, compat=True), html) == "1</script>t"


def test_links(spark):
    html = """<a href="/x"><a class=q HREF='//h/y'><a href="#f"><a href="javascript:0"><a href="http://o/z">"""
    assert value(spark, H.hrefs, html) == ["/x", "//h/y", "http://o/z"]
    assert [H.resolve("http://a/b/c", h) for h in ("/x", "//h/y", "d", None)] == ["http://a/x", "http://h/y", "http://a/b/d", None]


def test_markdown():
    assert H.markdown("<h1>A &amp; B</h1><p>x<br>y</p><ul><li>z</li></ul><script>n</script>") == "# A & B\n\nx\ny\n\n* z"
    assert H.markdown(None) is None


def test_listing_stage_drops_result_pages(spark):
    rows = [("a", "a.html", "<h1>House, Austin, TX 78701</h1><p>$5</p><p>3 Beds</p>"), ("b", "b.html", "<h2>1,234 results</h2>")]
    out = E.extract_listings(spark.createDataFrame(rows, "file_hash string, source_file string, html string")).collect()
    assert [(r.file_hash, r.title, r.price, r.beds) for r in out] == [("a", "House, Austin, TX 78701", "$5", 3)]


def test_token_report_counts_nulls_as_text(spark):
    out = {r.field: r.tokens for r in X.token_report(spark.createDataFrame([("a b", None), (None, "c")], "x string, y string")).collect()}
    assert out == {"x": 3, "y": 2, "TOTAL": 5, "AVERAGE": 2.5}
    empty = {r.field: r.tokens for r in X.token_report(spark.createDataFrame([], "x string")).collect()}
    assert empty == {"x": 0, "TOTAL": 0, "AVERAGE": 0}
