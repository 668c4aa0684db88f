"""Text functions: analysers, word limits, token counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that the listing analyser drops.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for")

#: A lower-case ASCII word that no other letter, digit or underscore touches.
WORD = r"(?<![\p{L}\p{N}_])[a-z]+(?![\p{L}\p{N}_])"


def all_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def tokenize(text: Column) -> Column:
    """Tokens of the listing analyser, in order, stop words left out; null or empty: none."""
    return F.filter(all_words(text), lambda w: ~w.isin(*STOP_WORDS))


def analyze(text: Column) -> Column:
    """Tokens of the fielded analyser: runs of letters and digits in lower case; no stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(text: str) -> list[str]:
    """The listing analyser for a query string, on the driver."""
    import re

    found = re.findall(r"(?<!\w)[a-z]+(?!\w)", text.lower())
    return [w for w in found if w not in STOP_WORDS]


def limit_words(text: Column, most: int = 20) -> Column:
    """The first ``most`` words and "..."; shorter texts as they are; null or empty: "N/A"."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return (
        F.when(text.isNull() | (text == ""), F.lit("N/A"))
        .when(F.size(words) <= most, text)
        .otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("...")))
    )


def document_text(title: Column, description: Column) -> Column:
    """The indexed text; a missing part is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def token_counter(encoding: str | None = None):
    """A pandas UDF that counts BPE tokens. ``encoding``: a tokenizers file, a .tiktoken rank file, or an
    encoding name of an installed vocabulary; None counts words. Null is the text "null"."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(encoding)
        for s in batches:
            yield s.fillna("null").map(lambda t: len(encode(t))).astype("int64")

    return count


def _encoder(encoding: str | None):
    if encoding is None:
        return str.split
    if encoding.endswith(".json"):
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(encoding)
        return lambda t: tk.encode(t, add_special_tokens=False).ids
    import tiktoken

    if encoding.endswith(".tiktoken"):
        import base64

        with open(encoding, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return tiktoken.get_encoding(encoding).encode_ordinary


def token_report(rows: DataFrame, encoding: str | None = None) -> DataFrame:
    """(field, tokens) totals of every column, plus the rows "TOTAL" and "AVERAGE" (per record, 0 when
    there is none), by falling tokens. One pass over the rows."""
    count = token_counter(encoding)
    names = rows.columns
    each = rows.select(*[count(F.col(f"`{c}`").cast("string")).alias(f"f{i}") for i, c in enumerate(names)])
    sums = each.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"f{i}"), F.lit(0)).alias(f"f{i}") for i in range(len(names))])
    total = sum((F.col(f"f{i}") for i in range(len(names))), F.lit(0))
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"f{i}").cast("double").alias("tokens")) for i, c in enumerate(names)]
    cells += [F.struct(F.lit("TOTAL").alias("field"), total.cast("double").alias("tokens")), F.struct(F.lit("AVERAGE").alias("field"), F.coalesce(F.try_divide(total, F.col("n")), F.lit(0.0)).alias("tokens"))]
    return sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*").orderBy(F.desc("tokens"), "field")
