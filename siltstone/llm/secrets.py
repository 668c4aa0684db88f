"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match satisfies
(``trigram_query``). The index holds all trigrams of all texts, and knows no rule: it is written once
(``build_index``), opened again (``open_index``) and serves any rule later. A posting is (trigram, block, mask): 64
neighbouring texts of a scan are a block, and a bit of the mask says that its text has the trigram. So the postings of
a block are merged before they are shuffled, and a query is evaluated by bitwise AND and OR of the masks of
its posting lists, block by block. Only candidates are scanned with the expression itself. A rule whose expression
has no mandatory trigram scans every text. Trigrams are taken from lower-cased texts, so that rules in either
case share them; they are known by 64-bit hashes, of which a collision adds a candidate at worst.

All matching is done by the JVM's regular expressions in whole texts: the pieces between matches and the
matches alternate, so that running sums of their lengths in code points give every position.

Edge cases: null or empty text has no spans; texts of fewer than three characters have no trigram; very long texts are cut
into overlapping pieces of ``CHUNK`` characters for the index, not for the matching; rows that repeat have equal results;
the lists of a row grow with its own matches only; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _parser as sre

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import native as N


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length; matches below it are dropped.
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: Kinds in the order that breaks ties of position. The first three are the base. The runs of "access"
#: and "hex" are written with their least length, which matches the same: a shorter run has no longer part.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
#: Alternatives that an exact set of strings may hold before it is turned into a query.
EXACT_LIMIT = 64

# --- queries: True, ("tri", t), ("and", q...), ("or", q...) -------------------------------------


def all_of(*parts):
    flat = []
    for p in parts:
        if p is not True and p not in flat:
            flat += [x for x in p[1:] if x not in flat] if p[0] == "and" else [p]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def any_of(*parts):
    if any(p is True for p in parts):
        return True
    flat = list(dict.fromkeys(parts))
    return flat[0] if len(flat) == 1 else ("or", *flat)


def of_strings(strings: set[str]):
    """What any text that holds one of the strings satisfies."""
    return any_of(*[all_of(*[("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, object]:
    """(the exact set of matches if it is small, else None; the query)."""
    run: set[str] | None = {""}
    exact, query = True, True
    for op, arg in items:
        name = str(op)
        one: set[str] | None = None
        inner: object = True
        if name == "LITERAL":
            one = {chr(arg).lower()}
        elif name == "IN":
            chars: set[str] | None = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            one = chars if chars and len(chars) <= 6 else None
        elif name == "SUBPATTERN":
            one, inner = _walk(arg[-1])
        elif name == "BRANCH":
            found = [_walk(x) for x in arg[1]]
            if all(x[0] is not None for x in found):
                one = set().union(*[x[0] for x in found])
            else:
                inner = any_of(*[x[1] if x[0] is None else all_of(x[1], of_strings(x[0])) for x in found])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            s, q = _walk(body)
            if s is not None and high == 1:
                one = s | {""} if low == 0 else s
            elif s is not None and low == high and len(s) ** low <= EXACT_LIMIT:
                one = reduce(lambda a, _: {x + y for x in a for y in s}, range(low), {""})
            elif low >= 1:
                inner = q if s is None else of_strings(s)
        elif name == "AT":
            one = {""}
        if one is not None and len(run) * len(one) <= EXACT_LIMIT:
            run = {x + y for x in run for y in one}
        else:
            exact = False
            query = all_of(query, of_strings(run), inner, True if one is None else of_strings(one))
            run = {""} if one is None else set(one) if len(one) <= EXACT_LIMIT else {""}
            continue
        query = all_of(query, inner)
    return (run, query) if exact else (None, all_of(query, of_strings(run)))


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; True where nothing is mandatory."""
    exact, query = _walk(sre.parse(pattern))
    return all_of(query, of_strings(exact)) if exact is not None else query


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1:]))


# --- the index ---------------------------------------------------------------------------------


#: Characters of a text that are taken apart at once.
CHUNK = 1 << 18
ALL = "tri long, block long, mask long, th long"


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the index of all texts: postings (tri, block, mask), and a row for each text without a trigram, whose
    ``block`` is the text's number, 64 to a block, and ``th`` the hash of the text. The rows of both kinds come from one pass, so that
    they agree on the numbers whatever was computed again."""
    rows = docs.where("text is not null").select(F.monotonically_increasing_id().alias("id"), F.xxhash64("text").alias("th"), F.lower("text").alias("low"))
    pieces = F.sequence(F.lit(0), F.greatest(F.floor((F.length("low") - 3) / CHUNK), F.lit(0)).cast("int"))
    rows = rows.select("id", "th", "low", F.explode(pieces).alias("k"))
    rows = rows.select("id", "th", "k", F.split(F.substr("low", F.col("k") * CHUNK + 1, F.lit(CHUNK + 2)), "").alias("cs"))
    # Start -1 stands for the text itself.
    start = F.sequence(F.when(F.col("k") == 0, -1).otherwise(0), F.greatest(F.size("cs") - 3, F.when(F.col("k") == 0, -1).otherwise(0)))
    each = rows.select("id", "th", "cs", F.explode(start).alias("at"))
    own = F.col("at") < 0
    tri = F.when(~own, F.xxhash64(*N.window("cs", "at", 3)))
    each = each.select(tri.alias("tri"), F.when(own, F.col("id")).otherwise(F.shiftright("id", 6)).alias("block"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"), F.when(own, F.col("th")).alias("th"))
    index = each.groupBy("tri", "block").agg(F.bit_or("bit").alias("mask"), F.max("th").alias("th"))
    path = path or C.fresh_path(docs.sparkSession, "trigrams")
    # Sorted, so that a query reads the pages of its trigrams only.
    index.sortWithinPartitions("tri", "block").write.parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALL).parquet(path)


def key_of(tri: str) -> Column:
    return F.xxhash64(*[F.lit(c) for c in tri])


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(th, hit_<kind>...) of the texts that satisfy some query: posting lists, intersected as masks of 64 texts."""
    terms = sorted(set().union(*map(trigrams, queries.values())))
    known = index.sparkSession.range(1).select(*[key_of(t) for t in terms]).first()
    key = dict(zip(terms, known))
    lists = index.where(F.col("tri").isin(list(key.values())))
    masks = lists.groupBy("block").agg(*[F.coalesce(F.bit_or(F.when(F.col("tri") == key[t], F.col("mask"))), F.lit(0).cast("long")).alias(f"m{i}") for i, t in enumerate(terms)])
    place = {t: i for i, t in enumerate(terms)}

    def test(q) -> Column:
        if q[0] == "tri":
            return F.col(f"m{place[q[1]]}")
        return reduce(lambda a, b: a.bitwiseAND(b) if q[0] == "and" else a.bitwiseOR(b), [test(x) for x in q[1:]])

    hits = masks.select("block", *[test(q).alias(f"hit_{k}") for k, q in queries.items()])
    some = reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"hit_{k}") for k in queries])
    hits = hits.withColumn("any", some).where(F.col("any") != 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    on = lambda c: F.expr(f"shiftright({c}, bit) & 1L") == 1
    hits = hits.where(on("any")).select((F.col("block") * 64 + F.col("bit")).alias("id"), *[on(f"hit_{k}").alias(f"hit_{k}") for k in queries])
    texts = index.where("tri is null").select(F.col("block").alias("id2"), "th")
    return hits.join(texts, F.col("id") == F.col("id2")).groupBy("th").agg(*[F.max(f"hit_{k}").alias(f"hit_{k}") for k in queries])


# --- verification ------------------------------------------------------------------------------


def matches(rule: Rule, order: int) -> Column:
    """The rule's matches in ``text``: its order, and for each match (gap, n, ok), the code points since the match before and
    of the match, and whether it is long enough."""
    lens = lambda a: F.transform(a, lambda x: F.length(x))
    between, found = lens(F.split("text", rule.regex, -1)), lens(F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0)))
    ok = F.transform(F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)), lambda x: F.length(x) >= rule.least) if rule.least else F.transform(found, lambda x: F.lit(True))
    cells = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("n"), ok.alias("ok"))
    # Most texts match nothing: these end with one test.
    return F.when(F.col("text").rlike(rule.regex), F.struct(F.lit(order).alias("k"), cells.alias("cells")))


def _placed(rows: DataFrame, found: list[Column]) -> DataFrame:
    """(doc_id, th, x): a span (s, k, e) for each match that is long enough."""
    each = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "th", F.explode(F.array_compact(F.array(*found))).alias("m"))
    each = each.select("row", "doc_id", "th", "m.k", F.posexplode("m.cells").alias("i", "x"))
    upto = Window.partitionBy("row", "doc_id", "th", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("e", F.sum(F.col("x.gap") + F.col("x.n")).over(upto).cast("int")).where("x.ok")
    return ends.select("doc_id", "th", F.struct((F.col("e") - F.col("x.n")).alias("s"), "k", "e").alias("x"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, th, spans) of the rows of docs that have any span; spans are sorted by start and kind. ``index`` is that of these
    documents, or of more; without one it is built."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    narrow = [(i, r) for i, r in enumerate(rules) if asked[r.kind] is not True]
    wide = [(i, r) for i, r in enumerate(rules) if asked[r.kind] is True]
    keyed = docs.where("text is not null").select(*N.row_key(), "text")
    parts = []
    if wide:
        parts.append(_placed(keyed, [matches(r, i) for i, r in wide]))
    if narrow:
        index = build_index(docs) if index is None else index
        some = C.materialise(candidates(index, {r.kind: asked[r.kind] for _, r in narrow}), "candidates")
        some = C.small_or_plain(some.withColumnRenamed("th", "k_th"), 32)
        parts.append(_placed(keyed.join(some, keyed.th == some.k_th), [F.when(F.col(f"hit_{r.kind}"), matches(r, i)) for i, r in narrow]))
    # A row that repeats gives its spans again: sets merge them.
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("x")).alias("spans"))


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    found = scan(docs, rules).withColumnsRenamed({"doc_id": "k_id", "th": "k_th"})
    keys = docs.select(*N.row_key())
    rows = keys.join(found, keys.doc_id.eqNullSafe(found.k_id) & keys.th.eqNullSafe(found.k_th), "left")
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans_ = F.coalesce("spans", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    base = [i for i, r in enumerate(rules) if r.kind in BASE]
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter(spans_, lambda x: x["k"] == [r.kind for r in rules].index(k))).cast("long")
    in_base = F.filter(spans_, lambda x: x["k"].isin(base))
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(told(in_base).cast("binary"), 256).alias("base_sha256"), told(spans_).alias("spans"))
