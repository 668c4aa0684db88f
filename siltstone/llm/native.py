"""Column helpers for operators that stay in the JVM.

Windows over the elements of an array are made by exploding their start index and reading the elements
by index in the same code-generated stage: the array is made once for each row and never copied, and no
interpreted lambda runs for each element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WHITE = " \t\n\x0b\f\r"


def words(text: Column, lower: bool = True) -> Column:
    """The words of a text (runs without ASCII white space), as an array; null or none: empty."""
    body = F.trim(F.coalesce(F.lower(text) if lower else text, F.lit("")), F.lit(WHITE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"))


def starts(array: Column, size: int) -> Column:
    """Indices at which windows of ``size`` start; an array that is shorter is one window, an empty none."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.greatest(F.size(array) - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def window(array: str, at: str, size: int) -> list[Column]:
    """Columns of one window; beyond the end they are null."""
    return [F.get(array, F.col(at) + j) for j in range(size)]


def row_key() -> list[Column]:
    """What identifies a row of documents: doc_id and a hash of the text."""
    return [F.col("doc_id"), F.xxhash64("text").alias("th")]


def same_row(left: DataFrame, right: DataFrame, doc_id: str = "k_id", th: str = "k_th") -> Column:
    return left["doc_id"].eqNullSafe(right[doc_id]) & (F.xxhash64(left["text"]) == right[th])


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs less the rows whose (doc_id, hash of text) is in ``keys`` (doc_id, th); the keys are
    broadcast only where their count is measured small."""
    keys = C.materialise(keys.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).distinct(), "keys")
    keys = C.small_or_plain(keys, 24)
    return docs.join(keys, same_row(docs, keys), "left_anti")
