"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines of a document are a window, known by two 64-bit hashes. Windows that occur
twice or more anywhere are found by one aggregation (partial on the map side, so that a window in a third
of all documents costs one row a task); the first occurrence by (doc_id, position) stays, the lines of
all later ones are covered, and covered positions are merged and removed.

Edge cases: windows without any character but white space are ignored; a text of fewer than three lines
has no window and stays; null text has no line and stays null; rows that repeat a doc_id are ordered by
the hash of their text and, if equal, are one document; null doc_ids come last; a text of any length is split
whole, and a row of its windows needs two hashes and a position; an empty table gives no
rows; extra columns are ignored by ``windows`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import native as N

LINES = 3


def windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """(doc_id, th, i, h1, h2) of every window with a visible character."""
    ls = F.split("text", "\n")
    spread = docs.where("text is not null").select(*N.row_key(), ls.alias("ls")).where(F.size("ls") >= size)
    spread = spread.select("doc_id", "th", "ls", F.explode(F.sequence(F.lit(0), F.size("ls") - size)).alias("i"))
    parts = N.window("ls", "i", size)
    seen = F.trim(F.concat(*parts), F.lit(N.WHITE)) != ""
    return spread.where(seen).select("doc_id", "th", "i", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *parts).alias("h2"))


def covered(docs: DataFrame, size: int = LINES) -> DataFrame:
    """(k_id, k_th, lines): the ascending distinct positions to remove, of each row that has any."""
    w = C.materialise(windows(docs, size), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "i")
    again = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    again = C.small_or_plain(C.materialise(again, "repeated"), 64)
    later = w.join(again, (w.h1 == again.g1) & (w.h2 == again.g2)).where(place != F.col("first"))
    lines = F.explode(F.array(*[F.col("i") + j for j in range(size)]))
    each = later.select("doc_id", "th", lines.alias("line"))
    return each.groupBy(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def deduplicate(docs: DataFrame, size: int = LINES, details: bool = False) -> DataFrame:
    """docs with the covered lines taken out of ``text``; with details also _n_lines, _n_removed, _n_spans."""
    names = docs.columns
    gone = covered(docs, size)
    both = docs.join(gone, N.same_row(docs, gone), "left")
    ls, cut = F.split("text", "\n"), F.coalesce("lines", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), cut)
    text = F.when(F.col("text").isNull() | (F.size(cut) == 0), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))
    more = [F.coalesce(F.size(ls), F.lit(0)).alias("_n_lines"), F.size(cut).alias("_n_removed"), (F.size(cut) - F.size(F.array_intersect(cut, F.transform(cut, lambda x: x + 1)))).alias("_n_spans")]
    return both.select(*[text.alias(c) if c == "text" else c for c in names], *(more if details else []))


def digest(docs: DataFrame) -> DataFrame:
    rows = deduplicate(docs.select("doc_id", "text"), details=True)
    longs = [F.col(f"_{c}").cast("long").alias(c) for c in ("n_lines", "n_removed", "n_spans")]
    return rows.select("doc_id", *longs, F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) > 2)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS turn FROM w WHERE regexp_matches(k, '[^\x20\x09-\x0D]')) WHERE turn > 1),
cut AS (SELECT DISTINCT doc_id, i + j AS line FROM later, (SELECT unnest([0, 1, 2]) AS j)),
runs AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN before IS NULL OR before < line - 1 THEN 1 ELSE 0 END) AS n_spans FROM (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM cut) GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(e.l, chr(10) ORDER BY e.line) AS body FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS line FROM d) e LEFT JOIN cut c ON e.doc_id = c.doc_id AND e.line = c.line WHERE c.line IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 CAST(length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(body, '') END) AS BIGINT) AS kept_chars, md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(body, '') END) AS kept_md5
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
