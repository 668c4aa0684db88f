"""Attributes of a listing page, from its Markdown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in order of preference, with one group each. (?d): only \n ends a line.
NS = r"[^\S\n]"
PATTERNS = {
    "title": (r"(?dm)^#\s+(.+)$",),
    "price": (rf"(?dim)^(?!.*(?:sq{NS}*ft|acres?)).*(\$[\d,]+(?:\.\d{{2}})?).*$",),
    "beds": (r"(?i)(\d+)\s+Beds?", r"(?i)Bedrooms?\s+Total\s*\n\s*(\d+)"),
    "baths": (r"(?i)(\d+)\s+Baths?(?!\s+(?:Full|Half|Three Quarter|Total))", r"(?i)Bathrooms?\s+Total\s*\n\s*(\d+)"),
    "sqft": (r"(?i)([\d,]+)\s+Sq\s+Ft(?!\s*/)", r"(?i)Living\s+Area\s*\n\s*([\d,]+)\s*SqFt"),
    "status": (r"(?iU)Status\s+(\w+)",),
    "description": (r"(?is)MLS#?\s*[A-Z0-9]+\s*\n\n(.+?)\n\nRead More", r"(?is)MLS#?\s*[A-Z0-9]+\s*\n\n(.+?)(?=\n\n(?:Read More|## Details))"),
    "year_built": (r"Built in (\d{4})", r"Year Built\s*\n\s*(\d{4})"),
    "price_per_sqft": (r"(?i)\$(\d+(?:,\d{3})*)\s*/\s*Sq\s*Ft",),
    "lot_size_acres": (r"(?im)([\d.]+)\s+acres?\s+lot", r"(?im)Lot\s+Size\s+Acres\s*\n\s*([\d.]+)", r"(?dim)^([\d.]+)\s+Acres$"),
    "city": (r"(?dm)^City\s*\n\s*(.+)$",),
    "county": (r"(?dim)County\s+(?:Or\s+)?Parish\s*\n\s*(.+)$",),
    "school_district": (r"(?dm)School District\s*\n\s*(.+)$", r"(?dm)School\s+District\s*\n\s*(.+?)(?=\n\n|\n[A-Z])"),
    "property_type": (r"(?dm)Property Type\s*\n\s*(.+)$",),
    "property_sub_type": (r"(?dm)Property Sub Type\s*\n\s*(.+)$",),
}
# The mark of result pages, names that are none, and bounds of sane years and lots.
LISTING_PAGE = r"(?i)##\s+[\d,]+\s+results"
NO_DISTRICT = ("call school board", "none", "n/a")
LATEST_YEAR = 2025
LARGEST_LOT = 10000


def _first(content: Column, pattern: str) -> Column:
    """The group of the first match; null where nothing (or nothing but '') matches."""
    # One element or none: the expression is read once, however often its value is used.
    return F.get(F.array_remove(F.array(F.regexp_extract(content, pattern, 1)), ""), 0)


def _any(content: Column, name: str) -> Column:
    return F.coalesce(*[_first(content, p) for p in PATTERNS[name]])


def _integer(text: Column) -> Column:
    """A whole number without its commas; null where it is none, so that one bad field keeps the rest."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("int")


def is_listing_page(content: Column) -> Column:
    """A page of search results, not of one listing."""
    return F.coalesce(content.rlike(LISTING_PAGE), F.lit(False))


def extract_title(content: Column) -> Column:
    return F.trim(_any(content, "title"))


def extract_price(content: Column) -> Column:
    """The last amount on the first line that has one and speaks of no area."""
    return _any(content, "price")


def extract_beds(content: Column) -> Column:
    return _integer(_any(content, "beds"))


def extract_baths(content: Column) -> Column:
    return _integer(_any(content, "baths"))


def extract_sqft(content: Column) -> Column:
    return _integer(_any(content, "sqft"))


def extract_status(content: Column) -> Column:
    return _any(content, "status")


def extract_description(content: Column) -> Column:
    return F.trim(_any(content, "description"))


def extract_year_built(content: Column) -> Column:
    years = [_first(content, p).try_cast("int") for p in PATTERNS["year_built"]]
    return F.coalesce(*[F.when(y.between(1, LATEST_YEAR), y) for y in years])


def extract_price_per_sqft(content: Column) -> Column:
    return F.concat(F.lit("$"), _any(content, "price_per_sqft"))


def extract_lot_size(content: Column) -> Column:
    sizes = [_first(content, p).try_cast("double") for p in PATTERNS["lot_size_acres"]]
    return F.coalesce(*[F.when((x > 0) & (x < LARGEST_LOT), x) for x in sizes])


def extract_city(content: Column) -> Column:
    return F.trim(_any(content, "city"))


def extract_county(content: Column) -> Column:
    return F.trim(_any(content, "county"))


def extract_school_district(content: Column) -> Column:
    names = [F.trim(_first(content, p)) for p in PATTERNS["school_district"]]
    return F.coalesce(*[F.when((n != "") & ~F.lower(n).isin(*NO_DISTRICT), n) for n in names])


def extract_property_type(content: Column) -> Column:
    return F.trim(_any(content, "property_type"))


def extract_property_sub_type(content: Column) -> Column:
    return F.trim(_any(content, "property_sub_type"))


EXTRACTORS = {
    "title": extract_title,
    "price": extract_price,
    "beds": extract_beds,
    "baths": extract_baths,
    "sqft": extract_sqft,
    "status": extract_status,
    "description": extract_description,
    "year_built": extract_year_built,
    "price_per_sqft": extract_price_per_sqft,
    "lot_size_acres": extract_lot_size,
    "property_type": extract_property_type,
    "property_sub_type": extract_property_sub_type,
    "city": extract_city,
    "county": extract_county,
    "school_district": extract_school_district,
}


def attributes(content: Column) -> list[Column]:
    return [f(content).alias(name) for name, f in EXTRACTORS.items()]


def state_of_title(title: Column) -> Column:
    """The two capitals before a five-digit code, else ''."""
    return F.coalesce(F.regexp_extract(title, r"\b([A-Z]{2})\s+\d{5}", 1), F.lit(""))
