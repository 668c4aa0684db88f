"""Fuzzy comparison of entity names, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that are cut in one pass, in this order, each if it stands at the end by then.
SUFFIXES = (
    " unified school district", " independent school district", " consolidated school district",
    " community school district", " school district", " public schools", " city schools", " county schools",
    " community schools", " area schools", " school system", " school corporation", " schools",
    " unified district", " unified", " independent", " isd", " usd", " district",
)
# Replacements after that, in this order.
REPLACEMENTS = (
    (r"^\d+\s*-\s*", ""), (r"\s+\d+$", ""), (r"#\d+", ""), (r"\s+\d+\s+", " "), (r",\s*[a-z]{2}$", ""),
    (r"\s+[a-z]{2}$", ""), (r"(?U)[^\w\s]", " "), (r"\s+", " "),
)
HIGH, MEDIUM = 0.95, 0.8


def normalize(name: Column) -> Column:
    """A name's core; null gives ''."""
    name = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    # A replacement reads its input once, so that the chain of expressions stays a chain.
    name = reduce(lambda n, s: F.regexp_replace(n, rf"\s*{s}$", ""), SUFFIXES, name)
    return F.trim(reduce(lambda n, r: F.regexp_replace(n, *r), REPLACEMENTS, name))


def score_normalized(a: Column, b: Column) -> Column:
    """Similarity of two normal forms: 1 if equal, 0.9 if one holds the other, else the Jaccard index of
    their words, at least 0.85 if all words of ``a`` are in ``b``; 0 if either is empty."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(x, y))
    jaccard = shared / F.size(F.array_union(x, y))
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0)
        .when(a == b, 1.0)
        .when(a.contains(b) | b.contains(a), 0.9)
        .when(shared == F.size(x), F.greatest(jaccard, F.lit(0.85)))
        .otherwise(jaccard)
    )


def match_score(a: Column, b: Column) -> Column:
    return score_normalized(normalize(a), normalize(b))


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
