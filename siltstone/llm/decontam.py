"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is the set Q of its distinct 5-word shingles. Items are partitioned by powers of two of |Q|. In
a partition whose largest size is u, an item's sketch is its k = u - ceil(t * u) + 1 smallest shingle
hashes (all, if it has fewer). A document with at least t * |Q| of the item's shingles lacks at most
|Q| - ceil(t * |Q|) < k of them, so at least one sketch hash is in the document, however long it is:
the search has no false negatives, where fixed signatures of the long side would miss short items.
Documents probe the sketch index with every shingle of their whole text; hits are candidates, and only
these are verified, by counting the item's distinct shingles in them as strings.

The sketch index and the items' shingles are broadcast where their measured size is small, else joined
by a shuffle. Documents are not shuffled: only candidates' keys and counts are.

Edge cases: null or empty texts have no shingles and match nothing; a text of 1 to 4 words is one
shingle; repeated item_ids are one item, the union of their shingles; repeated rows of documents give
one row for each doc_id and item, of which a null doc_id is one; a text of any length is searched whole; empty tables give no rows; extra columns are ignored by ``search``
and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import native as N

WORDS = 5
THRESHOLD = 0.8


def shingles(rows: DataFrame, key: list[str], size: int = WORDS) -> DataFrame:
    """(key, hash, w0..) of every shingle of every row; repeats included."""
    spread = rows.select(*key, N.words(F.col("text")).alias("ws")).select(*key, "ws", F.explode(N.starts(F.col("ws"), size)).alias("i"))
    parts = N.window("ws", "i", size)
    return spread.select(*key, F.xxhash64(*parts).alias("h"), F.concat_ws(" ", *parts).alias("shingle"))


def item_shingles(items: DataFrame, size: int = WORDS) -> DataFrame:
    """(item, n, h, shingle): distinct shingles and their number."""
    each = shingles(items.where("item_id is not null").select(F.col("item_id").alias("item"), "text"), ["item"], size).distinct()
    return each.withColumn("n", F.count("*").over(Window.partitionBy("item")))


def sketches(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(h, item) of the sketch hashes of each size partition."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    k = upper - F.ceil(upper * F.lit(threshold) - 1e-9) + 1
    order = F.row_number().over(Window.partitionBy("item").orderBy("h"))
    return sets.select("item", "h", k.alias("k"), order.alias("turn")).where("turn <= k").select(F.col("h").alias("sh"), "item")


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """(doc_id, th, item_id, n_shingles, n_found) of each document row that holds at least ``threshold``
    of an item's distinct shingles."""
    sets = C.materialise(item_shingles(items, size), "items")
    index = C.small_or_plain(C.materialise(sketches(sets, threshold), "sketches"), 24)
    keyed = docs.select(*N.row_key(), "text")
    probe = shingles(keyed, ["doc_id", "th"], size).select("doc_id", "th", "h")
    found = probe.join(index, probe.h == index.sh).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), F.col("item").alias("k_item")).distinct()
    found = C.materialise(found, "candidates")
    which = C.small_or_plain(C.materialise(found.select("k_id", "k_th").distinct(), "which"), 24)
    some = keyed.join(which, keyed.doc_id.eqNullSafe(which.k_id) & (keyed.th == which.k_th), "left_semi")
    exact = C.small_or_plain(sets.select("item", "n", F.col("shingle").alias("sh2")), 120)
    seen = shingles(some, ["doc_id", "th"], size)
    hits = seen.join(exact, seen.shingle == exact.sh2).groupBy("doc_id", "th", "item", "n", "shingle").agg(F.lit(1).alias("one"))
    counts = hits.groupBy("doc_id", "th", "item", "n").agg(F.count("*").alias("n_found")).where(F.col("n_found") >= F.col("n") * F.lit(threshold) - 1e-9)
    pairs = counts.join(found, counts.doc_id.eqNullSafe(found.k_id) & (counts.th == found.k_th) & (counts.item == found.k_item), "left_semi")
    return pairs.select("doc_id", "th", F.col("item").alias("item_id"), F.col("n").alias("n_shingles"), "n_found")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items).groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_found").alias("n_found"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item."""
    return N.without(docs, search(docs, items, threshold).select("doc_id", "th"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(ws[i + 1 : i + 5], ' ') AS s FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM b WHERE len(ws) > 0)),
bn AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found FROM hits JOIN bn USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""
