"""Fuzzy join of names within a block, without comparing all pairs.

A score of ``threshold`` or more (see functions.fuzzy) needs one of: a word of the left name's rarest ones in
common, or one name inside the other. The former meet on words: of a left name with n words, each n - ceil(t n) + 1
rarest words of it are looked up among all words of the right names (a Jaccard index of t, or all words in common,
leaves no other way). The latter meet on grams of three characters: the first gram of the shorter name is
one of the longer name's. Only pairs that meet are scored, with the same function as ever."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fuzzy
from siltstone.sources import shared


def _grams(name: Column) -> Column:
    """All grams of one, two and three characters: a short name is its own first gram."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(n)))
    return F.array_distinct(F.concat(at(1), at(2), at(3)))


def _words(name: Column) -> Column:
    return F.array_distinct(F.split(name, " "))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(block, a, b, score) of the normal forms (block, a) of left and (block, b) of right that score threshold or more.

    Empty names match nothing; threshold is above 0."""
    left = left.select("block", "a").where("a <> ''").distinct()
    right = right.select(F.col("block").alias("block2"), "b").where("b <> ''").distinct()
    words = left.select("block", "a", F.size(_words(F.col("a"))).alias("n"), F.explode(_words(F.col("a"))).alias("w"))
    theirs = right.select("block2", "b", F.explode(_words(F.col("b"))).alias("w2"))
    rare = theirs.groupBy(F.col("block2").alias("block3"), F.col("w2").alias("w3")).agg(F.count("*").alias("df"))
    known = words.join(rare, (words.block == rare.block3) & (words.w == rare.w3), "left").withColumn("df", F.coalesce("df", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("block", "a").orderBy("df", "w"))
    first = known.withColumn("turn", turn).where(F.col("turn") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    by_word = first.join(theirs, (first.block == theirs.block2) & (first.w == theirs.w2)).select("block", "a", "b")
    head = lambda c: F.substring(c, 1, 3)
    mine = left.select("block", "a", F.explode(_grams(F.col("a"))).alias("g"))
    within = mine.join(right, (mine.block == right.block2) & (mine.g == head("b"))).where(F.col("a").contains(F.col("b"))).select("block", "a", "b")
    others = right.select("block2", "b", F.explode(_grams(F.col("b"))).alias("g"))
    around = left.join(others, (left.block == others.block2) & (others.g == head("a"))).where(F.col("b").contains(F.col("a"))).select("block", "a", "b")
    pairs = by_word.unionByName(within).unionByName(around).distinct()
    return pairs.withColumn("score", fuzzy.score_normalized(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)


def best_others(rows: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key, score): for each key of rows (key, block, name) the best other key of its block, by score and
    then key, if one scores threshold or more. name is a normal form.

    Only distinct names are compared. The two least keys stand for all of a name: one of them is not the key that asks. Of
    the keys of all names that are similar to one, the best two are kept, for the same reason."""
    rows = rows.where("block is not null and name <> ''")
    least = Window.partitionBy("block", "name").orderBy("key")
    keys = rows.withColumn("turn", F.dense_rank().over(least)).where("turn <= 2").select("block", F.col("name").alias("b"), "key").distinct()
    names = shared.stage(keys, "keys")
    pairs = similar_pairs(names.select("block", F.col("b").alias("a")), names, threshold)
    known = pairs.join(names, ["block", "b"]).groupBy("block", "a", "key").agg(F.max("score").alias("score"))
    first = Window.partitionBy("block", "a").orderBy(F.desc("score"), "key")
    best = known.withColumn("turn", F.row_number().over(first)).where("turn <= 2")
    best = best.groupBy("block", F.col("a").alias("name")).agg(F.array_sort(F.collect_list(F.struct("turn", "key", "score"))).alias("best"))
    found = rows.join(best, ["block", "name"]).select(F.col("key").alias("left_key"), F.get(F.filter("best", lambda x: x["key"] != F.col("key")), 0).alias("found"))
    # A key may stand with several names.
    one = found.where("found is not null").groupBy("left_key").agg(F.min(F.struct((-F.col("found.score")).alias("less"), F.col("found.key").alias("right_key"))).alias("x"))
    return one.select("left_key", "x.right_key", (-F.col("x.less")).alias("score"))
