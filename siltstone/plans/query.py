"""The query language: lexer, parser, and compiler to one DataFrame plan.

    luxury pool        "luxury home"        "luxury home"~2      house*   *house   h?use   dalles~  dalles~1
    a AND b   a OR b   NOT c   a && b   a || b   !c   +a -b      (a OR b) AND c     title:pool   title:(a b)
    city_exact:Dallas  price:[500000 TO 1000000]  population:[1000000 TO *]  price:{1 TO 5}  beds:3  pool^2

Clauses without an operator are optional. AND makes the clauses on both of its sides required, NOT and -
forbid one, + requires one. A query of forbidden clauses only finds nothing. Numeric and exact clauses obey
the operators like any others. Anything else is a SyntaxError."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.fielded import FieldedIndex
from siltstone.sources import shared

K1, B = 1.2, 0.75
MAX_EXPANSIONS = 50
LEXER = re.compile(
    r"""\s*(?:(?P<op>&&|\|\||AND\b|OR\b|NOT\b|!)|(?P<range>[\[{]\s*(?:"[^"]*"|\S+?)\s+TO\s+(?:"[^"]*"|\S+?)\s*[\]}])"""
    r"""|(?P<punct>[()+-])|"(?P<phrase>(?:\\.|[^"\\])*)"|(?P<field>(?:\\.|[^\s:()\[\]{}"+\-!~^\\])(?:\\.|[^\s:()\[\]{}"~^\\])*):"""
    r"""|(?P<fuzzy>~\d*(?:\.\d+)?)|(?P<boost>\^\d+(?:\.\d+)?)|(?P<word>(?:\\.|[^\s:()\[\]{}"~^\\])+))"""
)


@dataclass
class Leaf:
    kind: str  # term phrase fuzzy wildcard range exact number
    field: str
    value: object
    boost: float = 1.0
    slop: int = 0
    n: int = -1


@dataclass
class Group:
    clauses: list[tuple[str, object]] = field(default_factory=list)  # (must | should | not, node)
    boost: float = 1.0


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEXER.match(text, at)
        if not m or m.end() == at:
            raise SyntaxError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


class Parser:
    def __init__(self, text: str, fields: dict[str, str], default: str):
        self.t, self.i, self.fields, self.default = tokens(text), 0, fields, default

    def peek(self) -> tuple[str, str]:
        return self.t[self.i] if self.i < len(self.t) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.i += 1
        return self.t[self.i - 1]

    def parse(self) -> Group:
        out = self.group(self.default)
        if self.peek()[0] != "end":
            raise SyntaxError(f"unexpected {self.peek()[1]!r}")
        return out

    def group(self, at: str) -> Group:
        out = Group()
        while self.peek()[0] != "end" and self.peek() != ("punct", ")"):
            both, occur = False, "should"
            if self.peek()[0] == "op" and self.peek()[1] in ("AND", "&&", "OR", "||"):
                both = self.take()[1] in ("AND", "&&")
                if not out.clauses:
                    raise SyntaxError("an operator needs a clause before it")
            if self.peek() in (("op", "NOT"), ("op", "!"), ("punct", "-")):
                self.take()
                occur = "not"
            elif self.peek() == ("punct", "+"):
                self.take()
                occur = "must"
            node = self.clause(at)
            if both:
                if out.clauses[-1][0] == "should":
                    out.clauses[-1] = ("must", out.clauses[-1][1])
                occur = "must" if occur == "should" else occur
            if node is not None:
                out.clauses.append((occur, node))
        return out

    def clause(self, at: str):
        kind, value = self.take() if self.i < len(self.t) else ("end", "")
        if kind == "field":
            at = _plain(value)
            if at not in self.fields:
                raise SyntaxError(f"no field {at!r}")
            kind, value = self.take() if self.i < len(self.t) else ("end", "")
        if (kind, value) == ("punct", "("):
            node = self.group(at)
            if self.peek() != ("punct", ")"):
                raise SyntaxError("a bracket is not closed")
            self.take()
        elif kind == "phrase":
            node = self.leaf(at, _plain(value), True)
        elif kind == "range":
            node = self.range(at, value)
        elif kind in ("word", "punct") and value not in "()":
            negative = kind == "punct"
            if negative:
                kind, rest = self.take() if self.i < len(self.t) else ("end", "")
                value += rest
            node = self.leaf(at, value, False)
        else:
            raise SyntaxError(f"unexpected {value or 'end'!r}")
        while self.peek()[0] in ("fuzzy", "boost"):
            kind, value = self.take()
            if kind == "boost":
                if node is not None:
                    node.boost *= float(value[1:])
            elif isinstance(node, Leaf) and node.kind == "phrase":
                node.slop = int(float(value[1:] or 0))
            elif isinstance(node, Leaf) and node.kind == "term":
                edits = float(value[1:] or 2)
                node.kind, node.slop = "fuzzy", int(edits if edits >= 1 else (1 - edits) * len(str(node.value)))
                if node.slop > 2:
                    raise SyntaxError("at most two edits")
            elif node is not None:
                raise SyntaxError("~ needs a term or a phrase")
        return node

    def range(self, at: str, text: str) -> Leaf:
        m = re.fullmatch(r'([\[{])\s*("[^"]*"|\S+?)\s+TO\s+("[^"]*"|\S+?)\s*([\]}])', text)
        low, high = (None if x == "*" else x.strip('"') for x in (m[2], m[3]))
        if self.fields[at] == "number":
            try:
                low, high = (None if x is None else float(x) for x in (low, high))
            except ValueError:
                raise SyntaxError(f"{at} is a number") from None
        return Leaf("range", at, (low, m[1] == "[", high, m[4] == "]"))

    def leaf(self, at: str, text: str, quoted: bool):
        kind = self.fields[at]
        if kind == "number":
            try:
                return Leaf("number", at, float(_plain(text)))
            except ValueError:
                raise SyntaxError(f"{at} is a number") from None
        bare = re.sub(r"\\.", "", text)
        if not quoted and ("*" in bare or "?" in bare):
            return Leaf("wildcard", at, text if kind == "exact" else text.lower())
        if kind == "exact":
            return Leaf("exact", at, _plain(text))
        words = [w for w in re.split(r"[^\w]|_", _plain(text).lower()) if w]
        if not words:
            return None
        return Leaf("term", at, words[0]) if len(words) == 1 else Leaf("phrase", at, words)


def parse(text: str, fields: dict[str, str], default: str) -> Group:
    return Parser(text, fields, default).parse()


def leaves(node) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for _, c in node.clauses for x in leaves(c)]


def wildcard_regex(text: str) -> str:
    parts = re.findall(r"\\.|[*?]|[^*?\\]", text)
    return "^" + "".join(".*" if p == "*" else "." if p == "?" else re.escape(p[-1]) for p in parts) + "$"


def _expansions(index: FieldedIndex, x: Leaf) -> list[str]:
    """The at most MAX_EXPANSIONS stored terms nearest to a fuzzy leaf's word. Words of about its length are written first:
    the distance is a condition on the term, and would else be evaluated for every token of the texts."""
    q = x.value
    near = (F.col("field") == x.field) & F.length("term").between(len(q) - x.slop, len(q) + x.slop)
    words = shared.stage(index.terms.where(near).select("term").distinct(), "words")
    found = words.withColumn("d", _distance(F.col("term"), q, x.slop)).where(F.col("d").between(0, x.slop))
    return [r.term for r in found.orderBy("d", "term").limit(MAX_EXPANSIONS).collect()]


def _term_test(x: Leaf, expansions: dict[int, list[str]]) -> Column:
    """Whether a term of an index is one of the leaf's."""
    term, test = F.col("term"), F.col("field") == x.field
    if x.kind == "wildcard":
        test &= term.rlike(wildcard_regex(x.value))
    elif x.kind == "range":
        low, has_low, high, has_high = x.value
        if low is not None:
            test &= term >= low.lower() if has_low else term > low.lower()
        if high is not None:
            test &= term <= high.lower() if has_high else term < high.lower()
    else:
        test &= term.isin(expansions[x.n] if x.kind == "fuzzy" else x.value if x.kind == "phrase" else [x.value])
    return test


def _matching_terms(index: FieldedIndex, text_leaves: list[Leaf], expansions: dict[int, list[str]]) -> DataFrame:
    """(leaf, field, term, df, at, weight): the stored terms of each leaf; weight is 0 where a term only
    makes a document match, with a constant score."""
    out = None
    for x in text_leaves:
        rows = index.terms.where(_term_test(x, expansions))
        if x.kind in ("wildcard", "range"):
            rows = rows.withColumns({"at": F.lit(0), "weight": F.lit(0.0)})
        elif x.kind == "fuzzy":
            q = x.value
            weight = F.lit(1.0) - _distance(F.col("term"), q, x.slop) / F.least(F.length("term"), F.lit(len(q)))
            rows = rows.withColumns({"at": F.lit(0), "weight": F.greatest(weight, F.lit(0.0))})
        else:
            words = x.value if x.kind == "phrase" else [x.value]
            # A word may stand at several places of a phrase.
            places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("at")) for i, w in enumerate(words)])
            rows = rows.select("*", F.explode(F.filter(places, lambda p: p["w"] == F.col("term"))["at"]).alias("at")).withColumn("weight", F.lit(1.0))
        rows = rows.select(F.lit(x.n).alias("leaf"), "field", "term", "df", F.col("at").cast("int").alias("at"), F.col("weight").cast("double").alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _distance(term: Column, q: str, most: int) -> Column:
    """Edit distance in which one swap of neighbours counts as one edit, where that alone makes them equal."""
    swaps = [q[:i] + q[i + 1] + q[i] + q[i + 2 :] for i in range(len(q) - 1) if q[i] != q[i + 1]]
    plain = F.levenshtein(term, F.lit(q), most)
    if not swaps:
        return plain
    best = F.array_min(F.filter(F.array(*[F.levenshtein(term, F.lit(s), most - 1) for s in swaps]), lambda d: d >= 0)) + 1
    return F.when(plain < 0, F.coalesce(best, F.lit(-1))).otherwise(F.least(plain, F.coalesce(best, F.lit(99))))


def _shift(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda v: v - by)


def _phrase_count(n_words: int, slop: int) -> Column:
    """How often the words stand in order in ``p`` (map: place in the phrase -> positions)."""
    first = F.col("p")[0]
    if slop == 0:
        shifted = [_shift(F.col("p")[i], i) for i in range(1, n_words)]
        return F.size(reduce(F.array_intersect, shifted, first))
    # Sloppy: the offsets of the words, each less its place, spread over at most ``slop``.
    near = lambda v: [F.exists(_shift(F.col("p")[i], i), lambda u: F.abs(u - v) <= slop) for i in range(1, n_words)]
    spread = F.filter(first, lambda v: reduce(lambda a, b: a & b, near(v)))
    return F.size(spread)


def _text_hits(index: FieldedIndex, text_leaves: list[Leaf]) -> DataFrame:
    """(doc_id, m<leaf>, s<leaf>...): one scan of the postings of all leaves, one aggregation by document. Postings that are
    of no leaf are left out in the scan, or before they are made of the texts."""
    expansions = {x.n: _expansions(index, x) for x in text_leaves if x.kind == "fuzzy"}
    fields = sorted({x.field for x in text_leaves})
    terms = _matching_terms(index, text_leaves, expansions).join(F.broadcast(index.stats.where(F.col("field").isin(fields))), "field")
    posts = index.postings.where(reduce(lambda a, b: a | b, [_term_test(x, expansions) for x in text_leaves]))
    # Words and the at most MAX_EXPANSIONS terms of a fuzzy clause are few; a wildcard or a range may ask for the whole
    # vocabulary, and is left to the sizes that Spark measures.
    few = all(x.kind in ("term", "phrase", "fuzzy") for x in text_leaves)
    hits = posts.join(F.broadcast(terms) if few else terms, ["field", "term"])
    phrases = [x.n for x in text_leaves if x.kind == "phrase"]
    places = F.map_from_entries(F.collect_list(F.when(F.col("leaf").isin(phrases), F.struct("at", "positions")))) if phrases else F.lit(None)
    per = hits.groupBy("doc_id", "leaf").agg(
        places.alias("p"),
        F.sum(F.col("weight") * _idf()).alias("idf"),
        F.sum(F.col("weight") * _idf() * _saturation(F.col("tf"))).alias("bm25"),
        F.first("dl").alias("dl"),
        F.first("avgdl").alias("avgdl"),
        F.max("weight").alias("weight"),
        F.count("*").alias("n_terms"),
    )
    match, score = F.lit(True), F.when(F.col("weight") > 0, F.col("bm25")).otherwise(1.0)
    for x in text_leaves:
        if x.kind == "phrase":
            here = F.col("leaf") == x.n
            count = F.when(here & (F.col("n_terms") == len(x.value)), _phrase_count(len(x.value), x.slop)).otherwise(0)
            match = F.when(here, count > 0).otherwise(match)
            score = F.when(here, F.col("idf") * _saturation(count)).otherwise(score)
    good = per.where(match).select("doc_id", "leaf", score.alias("score"))
    return good.groupBy("doc_id").agg(*[F.max(F.when(F.col("leaf") == x.n, F.col("score") * x.boost)).alias(f"s{x.n}") for x in text_leaves])


def _idf() -> Column:
    return F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _saturation(tf: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _column_test(x: Leaf) -> Column:
    c = F.col(f"`{x.field}`")
    if x.kind in ("exact", "number"):
        test = c == F.lit(x.value)
    elif x.kind == "wildcard":
        test = c.rlike(wildcard_regex(x.value))
    else:
        low, has_low, high, has_high = x.value
        test = c.isNotNull()
        if low is not None:
            test &= (c >= F.lit(low)) if has_low else (c > F.lit(low))
        if high is not None:
            test &= (c <= F.lit(high)) if has_high else (c < F.lit(high))
    return F.coalesce(test, F.lit(False))


def scores(index: FieldedIndex, text: str) -> DataFrame:
    """(doc_id, score) of every document that the query matches."""
    tree = parse(text, index.fields, index.default)
    every = leaves(tree)
    for n, x in enumerate(every):
        x.n = n
    text_leaves = [x for x in every if index.fields[x.field] == "text"]
    columns = sorted({x.field for x in every if index.fields[x.field] != "text"})
    rows = index.docs.select("doc_id", *[f"`{c}`" for c in columns])
    if text_leaves:
        hits = _text_hits(index, text_leaves)
        # Where a text clause is required, documents without any hit cannot match.
        needed = any(o == "must" and leaves(c) and all(index.fields[x.field] == "text" for x in leaves(c)) for o, c in tree.clauses) or len(text_leaves) == len(every)
        rows = rows.join(hits, "doc_id", "inner" if needed else "left")
    matched = {x.n: F.col(f"s{x.n}").isNotNull() if x in text_leaves else _column_test(x) for x in every}
    scored = {x.n: F.col(f"s{x.n}") if x in text_leaves else F.lit(x.boost) for x in every}

    def compile_(node) -> tuple[Column, Column]:
        if isinstance(node, Leaf):
            return matched[node.n], F.when(matched[node.n], scored[node.n]).otherwise(0.0)
        parts = [(o, *compile_(c)) for o, c in node.clauses]
        must, should, not_ = ([m for o, m, _ in parts if o == k] for k in ("must", "should", "not"))
        if not must and not should:
            return F.lit(False), F.lit(0.0)
        ok = reduce(lambda a, b: a & b, must) if must else reduce(lambda a, b: a | b, should)
        for m in not_:
            ok = ok & ~m
        total = sum((s for o, _, s in parts if o != "not"), F.lit(0.0)) * node.boost
        return ok, F.when(ok, total).otherwise(0.0)

    ok, total = compile_(tree)
    return rows.where(ok).select("doc_id", total.alias("score"))


def search(index: FieldedIndex, text: str, k: int = 10) -> DataFrame:
    """The k best documents with all their fields and ``rank``; ties by doc_id."""
    best = scores(index, text).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    rows = best.join(index.docs, "doc_id")
    # At most k rows are ranked, so that one task is enough.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
