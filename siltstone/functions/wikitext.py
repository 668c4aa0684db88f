"""Functions over encyclopedia titles and wikitext, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements that clean a field's value, in this order.
CLEANING = (
    (r"<!--.*?-->", ""), (r"&lt;!--.*?--&gt;", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"<ref[^>]*/>", ""),
    (r"</ref>", ""), (r"(?s)&lt;ref[^&]*?&gt;.*?&lt;/ref&gt;", ""), (r"&lt;ref[^&]*?/&gt;", ""),
    (r"&lt;/ref&gt;", ""), (r"&amp;nbsp;", " "), (r"&nbsp;", " "), (r"&lt;br /&gt;", " "), (r"&lt;br&gt;", " "),
    (r"<br />", " "), (r"<br>", " "), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\{\{[^\}]+\}\}", ""), (r"\s+", " "),
)
# Field names in order of preference; True: keep the number only.
CITY_FIELDS = {
    "population": (("population_total", "population", "pop_est", "pop"), True),
    "area_km2": (("area_total_km2", "area_km2"), True),
    "elevation_m": (("elevation_m", "elevation_m2"), True),
    "elevation_ft": (("elevation_ft", "elevation_feet"), True),
    "timezone": (("timezone", "timezone1"), False),
    "founded": (("established_date", "founded", "established"), False),
}
DISTRICT_FIELDS = {
    "students": (("students", "enrollment", "num_students"), True),
    "schools": (("schools", "number_of_schools", "num_schools"), True),
    "grades": (("grades", "grade", "grade_levels"), False),
    "budget": (("budget", "revenue"), True),
    "superintendent": (("superintendent", "admin", "leader_name"), False),
    "established": (("established", "founded", "established_date"), False),
}
# Words of places, and the marks of pages that are no article.
KEYWORDS = ("city in", "town in", "located in", "county", "population", "municipality")
DISAMBIGUATION = ("may refer to:", "{{disambiguation")
REDIRECT = r"(?i)\A#REDIRECT\s*\[\[([^\]]+)\]\]"


def normalize_title(title: Column) -> Column:
    return F.replace(F.trim(F.lower(title)), F.lit("_"), F.lit(" "))


def title_quality(title: Column, state: Column, state_full: Column) -> Column:
    """100 for a title with the state's name, 50 with its code after a comma, else 1."""
    low = F.lower(title)
    full, code = F.lower(state_full), F.concat(F.lit(", "), F.lower(state))
    return F.when((full != "") & low.contains(full), 100).when((F.lower(state) != "") & low.contains(code), 50).otherwise(1)


def is_disambiguation(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 1000))
    return F.coalesce(reduce(lambda a, b: a | b, [head.contains(m) for m in DISAMBIGUATION]), F.lit(False))


def is_redirect(text: Column) -> Column:
    head = F.upper(F.regexp_replace(F.substring(text, 1, 100), r"^\s+", ""))
    return F.coalesce(head.startswith("#REDIRECT"), F.lit(False))


def redirect_target(text: Column) -> Column:
    """The title that a redirect at the very start of a text names, without its section; else null."""
    found = F.regexp_extract(text, REDIRECT, 1)
    return F.when(found != "", F.trim(F.substring_index(found, "#", 1)))


def disambiguation_links(text: Column) -> Column:
    """The links of a text in order, each with the rest of its line: array of (link, rest)."""
    line = r"\[\[([^\]]+)\]\]([^\n]*)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("link"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("rest"))


def pick_link(links: Column, name: Column, state: Column, state_full: Column) -> Column:
    """The first link that holds the name and after which its line mentions the state; else null."""
    code = F.concat(F.lit(r"(?i),\s*\Q"), state, F.lit(r"\E"))
    link = lambda c: F.substring_index(c["link"], "#", 1)
    fits = lambda c: (F.coalesce(F.lower(c["rest"]).contains(F.lower(state_full)), F.lit(False)) | F.coalesce(F.regexp_like(c["rest"], code), F.lit(False))) & F.lower(link(c)).contains(F.lower(name))
    return F.trim(F.substring_index(F.get(F.filter(links, fits), 0)["link"], "#", 1))


def disambiguation_target(text: Column, name: Column, state: Column, state_full: Column) -> Column:
    """Where a disambiguation page leads for a place (see pick_link); null for other texts."""
    return F.when(is_disambiguation(text), pick_link(disambiguation_links(text), name, state, state_full))


def content_score(text: Column, state: Column, state_full: Column) -> Column:
    """How well an article fits a place, 0 to 1; 0 below 100 characters."""
    head = F.lower(F.substring(text, 1, 5000))
    code = F.concat(F.lit(r"\b\Q"), state, F.lit(r"\E\b"))
    score = F.when((F.coalesce(state_full, F.lit("")) != "") & head.contains(F.lower(state_full)), 0.4).otherwise(0.0)
    score += F.when((F.coalesce(state, F.lit("")) != "") & F.regexp_like(text, code), 0.3).otherwise(0.0)
    for word in KEYWORDS:
        score += F.when(head.contains(word), 0.05).otherwise(0.0)
    score += F.when(head.contains("{{infobox") | head.contains("{{geobox"), 0.2).otherwise(0.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 100, 0.0).otherwise(F.least(F.lit(1.0), F.round(score, 6)))


def clean_value(value: Column) -> Column:
    return F.trim(reduce(lambda v, r: F.regexp_replace(v, *r), CLEANING, value))


def numeric_value(value: Column) -> Column:
    """The first number of a cleaned value, as text; null if there is none."""
    found = F.regexp_extract(clean_value(value), r"([\d,]+\.?\d*)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\.+$", ""))


def infobox_field(text: Column, names: tuple[str, ...]) -> Column:
    """The cleaned value of the first of the fields that matches at all, even if it is empty."""
    out = None
    for name in names:
        pattern = rf"(?dim)\|\s*{name}\s*=\s*([^\|\{{]+?)(?:\n\||$)"
        value = clean_value(F.regexp_extract(text, pattern, 1))
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def _properties(text: Column, fields: dict) -> Column:
    cells = []
    for key, (names, number) in fields.items():
        value = infobox_field(text, names)
        cells += [F.lit(key), numeric_value(value) if number else clean_value(value)]
    return F.map_filter(F.create_map(*cells), lambda _, v: v.isNotNull() & (v != ""))


def city_properties(text: Column) -> Column:
    return _properties(text, CITY_FIELDS)


def district_properties(text: Column) -> Column:
    return _properties(text, DISTRICT_FIELDS)


def file_name(title: Column) -> Column:
    return F.translate(title, "/:", "__")
