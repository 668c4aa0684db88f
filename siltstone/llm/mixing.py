"""Mixing to target weights with soft membership.

Domains come from the labelled table: ``toxic`` (toxic = 1), else ``low`` (quality = 0), else ``high``.

**Classifier.** The definition is a chain of yes-or-no steps, and so is the classifier: toxic or not, then low
or not among the others. The features of a text are its distinct runs of letters and digits, in lower case, and two
shapes in eighths: the share of its characters that are neither small letters, digits nor white space, and
the share of its runs that are distinct. In each step the rarer side is looked for: a feature that at least ``MIN_DOCS``
of its labelled documents have, ``Z`` standard errors and a factor e**MIN_RATIO above chance, speaks for it with its
naive Bayes weight. The evidence of a text is its strongest feature, not the sum: features depend on each other (a
language, a group of near copies), and in sum hundreds of weak ones would drown the few that tell. Its
weight, in steps of ``WIDTH``, gives the text's bin. What a bin means is not derived but measured: features are chosen on
all ``FOLDS`` parts of the labels but one and that part's documents are counted by bin, for each part (smoothed by one
document at the odds of the weight, and made monotone). So posteriors are honest, and there are at most
BINS**2 different ones.

**Rates.** With n the document's words (its runs of letters and digits) and p its posteriors, nonnegative rates r are fitted so that the expected
totals sum(n * p_k * r) meet the targets T_k. Many rates do; those are wanted that stay near one, so that least squares
has two parts: sum_k gap_k**2 / B_k + slack * sum(n * (r - 1)**2), B_k = sum(n * p_k), gap_k = sum(n * p_k * r) - T_k. At its
only minimum r = max(0, 1 - sum_k p_k * m_k), a gradient step from one, projected, whose multipliers are
m_k = gap_k / (slack * B_k). Each round projects, takes the K totals and the K-by-K Gram matrix of the documents
not at zero, and moves the multipliers down the gradient scaled by that matrix, by the best of a few lengths.
Documents of equal posteriors have equal rates, so words are first summed by posterior; a round is one aggregation of
these sums, and only its K-by-K sums reach the driver. Rounds end at the minimum. Targets that it misses by
more than the tolerance are out of reach: the report says so and a warning is logged.

Edge cases: null or empty text has n = 0 and the posteriors of its shape; labels that repeat a doc_id are merged (toxic
if any says so, high if all do); rows that repeat a labelled doc_id are learned as one document; without labels
posteriors are equal and all rates one; a domain without labelled documents has posterior 0; rows that repeat are rows of their own;
an empty table gives none; other columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import native as N

#: The chain of definitions, backwards.
DOMAINS = ("high", "low", "toxic")
STEPS = ("toxic", "low")
TARGETS = {"high": 0.9, "low": 0.1, "toxic": 0.0}
#: The expected number of labelled documents that are learned from, chosen by a hash of their ids.
TRAIN_ROWS = 20_000
MIN_DOCS = 3
#: Parts of the labelled documents, each judged by what the others teach.
FOLDS = 4
Z = 4.0
MIN_RATIO = math.log(3)
WIDTH = 0.75
BINS = 14
ROUNDS = 60
TOLERANCE = 0.01
#: Rounds end when the gradient is this share of a domain's total.
EXACT = 1e-7
#: Lengths of the scaled step that a round tries.
LENGTHS = (1.0, 0.5, 0.25, 0.125, 1 / 32, 1 / 128)
LOG = logging.getLogger(__name__)


# --- the classifier ----------------------------------------------------------------------------


def featured(rows: DataFrame, *kept: Column) -> DataFrame:
    """``kept``, the number ``n`` of runs of letters and digits, and, for each feature of ``text``, a row with it as ``w``: distinct runs of letters and digits, the two
    shapes, which begin with a space, and null for the row itself. What is used twice is a column of its own first."""
    body = F.coalesce(F.col("text"), F.lit(""))
    runs = F.array_remove(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), "")
    rows = rows.select(*kept, runs.alias("_runs"), F.regexp_count(body, F.lit(r"[^\p{Ll}\p{N}\s]")).alias("_loud"), F.length(body).alias("_size"))
    own = [c for c in rows.columns if c[0] != "_"]
    rows = rows.select(*own, "_loud", "_size", F.size("_runs").cast("long").alias("n"), F.array_distinct("_runs").alias("_ds"))
    eighths = lambda a, b: F.floor(8 * a / F.greatest(b, F.lit(1))).cast("string")
    loud, fresh = F.concat(F.lit(" loud "), eighths(F.col("_loud"), F.col("_size"))), F.concat(F.lit(" fresh "), eighths(F.size("_ds"), F.col("n")))
    return rows.select(*own, "n", F.explode(F.concat("_ds", F.array(loud, fresh, F.lit(None).cast("string")))).alias("w"))


def sample(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(k_id, domain, fold) of the labelled documents to learn from: all, or ``rows`` in expectation."""
    merged = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("k_id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("t"), F.min(F.coalesce("quality", F.lit(0))).alias("q"))
    merged = C.materialise(merged, "labels")
    share = min(1.0, rows / max(1, merged.count()))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "high").otherwise("low").alias("domain")
    some = merged.where(F.pmod(F.xxhash64(F.lit("sample"), "k_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return C.materialise(some.select("k_id", domain, F.pmod(F.xxhash64(F.lit("fold"), "k_id"), F.lit(FOLDS)).cast("int").alias("fold")), "sample")


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """The model (wh, w_<step>: weights of a feature's hash) and what is known of it: for each step the side looked
    for and the probability of the step's domain by bin; the labelled documents and the accuracy on the parts not learned from."""
    few = sample(labels)
    joined = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("k_id"))
    seen = featured(joined, F.col("k_id"), F.col("domain"), F.col("fold")).where("w is not null")
    seen = C.materialise(seen.select("k_id", "domain", "fold", F.xxhash64("w").alias("wh")).distinct(), "features")
    sizes = {(r.domain, r.fold): r.n for r in seen.select("k_id", "domain", "fold").distinct().groupBy("domain", "fold").agg(F.count("*").alias("n")).collect()}
    has = [F.count_if((F.col("domain") == k) & (F.col("fold") == f)).alias(f"{k}{f}") for k in DOMAINS for f in range(FOLDS)]
    counts = seen.groupBy("wh").agg(*has)
    weights, side = [], {}
    rest = list(DOMAINS)
    for step in STEPS:
        rest.remove(step)
        # Variant v learns from the folds other than v; the last one from all.
        for v in range(FOLDS + 1):
            folds = [f for f in range(FOLDS) if f != v]
            a, b = sum((F.col(f"{step}{f}") for f in folds), F.lit(0)), sum((F.col(f"{k}{f}") for k in rest for f in folds), F.lit(0))
            n, m = sum(sizes.get((step, f), 0) for f in folds), sum(sizes.get((k, f), 0) for k in rest for f in folds)
            sign = 1 if n <= m else -1
            if sign < 0:
                a, b, n, m = b, a, m, n
            share = n / (n + m) if n + m else 0.0
            z = (a - (a + b) * share) / F.sqrt(F.greatest((a + b) * share * (1 - share), F.lit(1e-9)))
            w = F.ln((a + 0.5) / (n + 1.0)) - F.ln((b + 0.5) / (m + 1.0))
            speaks = (a >= MIN_DOCS) & (z >= Z) & (w >= MIN_RATIO) if n else F.lit(False)
            weights.append(F.when(speaks, w).otherwise(0.0).alias(f"w{v}_{step}"))
            side[step, v] = sign
    names = [f"w{v}_{step}" for step in STEPS for v in range(FOLDS + 1)]
    table = counts.select("wh", *weights).where(sum((F.col(x) for x in names), F.lit(0.0)) > 0)
    table = C.materialise(table, "weights")
    # Bins of the labelled documents by the weights that their own part had no say in.
    own = seen.join(C.small_or_plain(table.withColumnRenamed("wh", "h2"), 128), F.col("wh") == F.col("h2"), "left")
    score = [F.max(F.coalesce(F.get(F.array(*[F.col(f"w{v}_{step}") for v in range(FOLDS)]), F.col("fold")), F.lit(0.0))).alias(step) for step in STEPS]
    cells = own.groupBy("k_id", "domain").agg(*score).groupBy("domain", *[_bin(F.col(step)).alias(step) for step in STEPS]).count().collect()
    known: dict = {"documents": sum(sizes.values()), "by": {}, "sign": {step: side[step, FOLDS] for step in STEPS}}
    rest = list(DOMAINS)
    for step in STEPS:
        rest.remove(step)
        sums = [[0, 0] for _ in range(BINS)]
        for r in cells:
            if r.domain == step or r.domain in rest:
                sums[r[step]][r.domain == step] += r["count"]
        known["by"][step] = calibrated(sums, known["sign"][step])
    right = 0
    for r in cells:
        p = chain({step: known["by"][step][r[step]] for step in STEPS})
        right += r["count"] * (max(DOMAINS, key=lambda k: p[k]) == r.domain)
    known["accuracy"] = right / known["documents"] if known["documents"] else math.nan
    return table.select("wh", *[F.col(f"w{FOLDS}_{step}").alias(f"w_{step}") for step in STEPS]), known


def _bin(weight: Column) -> Column:
    return F.least(F.floor(weight / WIDTH), F.lit(BINS - 1)).cast("int")


def calibrated(sums: list[list[int]], sign: int) -> list[float]:
    """P(domain | bin) of counts [others, domain] by bin: smoothed by one document at the odds that naive Bayes gives the bin,
    then pooled until the side looked for (the domain if sign > 0) rises with the bin."""
    others, domain = (sum(x) for x in zip(*sums))
    if not domain or not others:
        return [1.0 if domain else 0.0 if others else math.nan] * len(sums)
    pools: list[list[float]] = []
    for i, (b, a) in enumerate(sums):
        guess = 1 / (1 + math.exp(-(math.log(domain / others) + sign * (i + 0.5) * WIDTH * (i > 0))))
        pools.append([a + guess, a + b + 1.0, 1])
        while len(pools) > 1 and sign * (pools[-2][0] / pools[-2][1] - pools[-1][0] / pools[-1][1]) > 0:
            x = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], x)]
    return [a / n for a, n, size in pools for _ in range(int(size))]


def chain(yes: dict) -> dict:
    """Posteriors of the domains from the probabilities of the steps; numbers or columns."""
    out, left = {}, 1.0
    for step in STEPS:
        out[step] = yes[step] * left
        left = (1.0 - yes[step]) * left
    return out | {DOMAINS[0]: left}


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, th, n, p_high, p_low, p_toxic) of every row of docs."""
    return classify(docs, *train(docs, labels))


def classify(docs: DataFrame, model: DataFrame, known: dict) -> DataFrame:
    # The null feature stands for the row itself, so that one without known features stays.
    self_row = docs.sparkSession.createDataFrame([(None, *[0.0 for _ in STEPS])], model.schema)
    # A row of the model is 24 bytes; beyond the bound of a broadcast the join shuffles.
    model = C.small_or_plain(C.materialise(model.unionByName(self_row), "model"), 64)
    each = featured(docs, *N.row_key())
    each = each.select("doc_id", "th", "n", F.when(F.col("w").isNotNull(), F.xxhash64("w")).alias("h"))
    hit = each.join(model, each.h.eqNullSafe(model.wh))
    copies = F.count_if(F.col("h").isNull())
    sums = hit.groupBy("doc_id", "th", "n").agg(*[_bin(F.max(f"w_{step}")).alias(f"b_{step}") for step in STEPS], copies.alias("copies"))
    if known["documents"]:
        p = chain({step: F.element_at(F.array(*[F.lit(0.0 if math.isnan(x) else x) for x in known["by"][step]]), F.col(f"b_{step}") + 1) for step in STEPS})
    else:
        p = {k: F.lit(1 / len(DOMAINS)) for k in DOMAINS}
    return sums.select("doc_id", "th", "n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_c"), *[p[k].alias(f"p_{k}") for k in DOMAINS]).drop("_c")


# --- the fit -----------------------------------------------------------------------------------

P = [f"p_{k}" for k in DOMAINS]


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivots, for K unknowns."""
    a = [[*row, b] for row, b in zip(matrix, right)]
    size = len(a)
    for i in range(size):
        top = max(range(i, size), key=lambda j: abs(a[j][i]))
        a[i], a[top] = a[top], a[i]
        if not a[i][i]:
            continue
        for j in range(size):
            if j != i:
                f = a[j][i] / a[i][i]
                a[j] = [x - f * y for x, y in zip(a[j], a[i])]
    return [row[-1] / row[i] if row[i] else 0.0 for i, row in enumerate(a)]


def fit(rows: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS, keep: dict[str, float] | None = None, slack: float | None = None) -> tuple[Column, dict]:
    """The rate as a column over p_*, and a report: totals before, targets and fitted totals by domain, rounds, and
    ``met``: whether the targets were reached. If not, a warning gives the totals.

    ``targets`` are weights; ``budget`` is the sum of the targets in words, by default the most that the weights
    allow without rates far above one: the least of total_k / weight_k. Instead, ``keep`` gives each target as a
    share of the domain's own total. Targets are met when the gaps sum to at most ``tolerance`` times the sum of targets
    and each is at most ``tolerance`` times its domain's own total: a small domain's target is not met by being
    small. ``slack``, a tenth of the tolerance unless given, is what staying near one weighs."""
    size = len(DOMAINS)
    slack = tolerance / 10 if slack is None else slack
    cells = C.materialise(rows.groupBy(*P).agg(F.sum("n").cast("double").alias("n")), "cells")
    n, p = F.col("n"), [F.col(x) for x in P]
    pairs = [(j, k) for j in range(size) for k in range(j, size)]
    rate_of = lambda m: F.greatest(F.lit(0.0), F.lit(1.0) - sum((p[k] * m[k] for k in range(size)), F.lit(0.0)))
    summed = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)

    def look(tried: list[list[float]]) -> list[dict]:
        """Totals, Gram matrix and the sum of n * r**2 at each of several multipliers, in one aggregation."""
        out = []
        for i, m in enumerate(tried):
            r = rate_of(m)
            out += [summed(n * p[k] * r, f"t{i}_{k}") for k in range(size)] + [summed(n * r * r, f"q{i}")]
            out += [summed(F.when(r > 0, n * p[j] * p[k]), f"g{i}_{j}{k}") for j, k in pairs]
        x = cells.agg(*out).first()
        return [{"m": m, "totals": [x[f"t{i}_{k}"] for k in range(size)], "gram": [[x[f"g{i}_{min(j, k)}{max(j, k)}"] for k in range(size)] for j in range(size)], "square": x[f"q{i}"]} for i, m in enumerate(tried)]

    here = look([[0.0] * size])[0]
    before = here["totals"]
    if keep is not None:
        want = [keep.get(k, 0.0) * b for k, b in zip(DOMAINS, before)]
    else:
        targets = targets or TARGETS
        weight = [targets.get(k, 0.0) / (sum(targets.values()) or 1.0) for k in DOMAINS]
        if budget is None:
            budget = min([b / w for b, w in zip(before, weight) if w > 0 and b > 0] or [0.0])
        want = [w * budget for w in weight]
    # The multipliers minimise a convex function, whose gradient is nought where m = gap / (slack * B).
    level = lambda x: sum(slack * b * m * m / 2 + t * m for b, m, t in zip(before, x["m"], want)) + x["square"] / 2
    rest = lambda x: [slack * b * m - (y - t) for b, m, y, t in zip(before, x["m"], x["totals"], want)]
    done = 0
    while done < rounds and any(abs(f) > EXACT * b for f, b in zip(rest(here), before)):
        done += 1
        matrix = [[here["gram"][j][k] + (j == k) * slack * before[k] for k in range(size)] for j in range(size)]
        step = _solve(matrix, rest(here))
        best = min(look([[m - a * s for m, s in zip(here["m"], step)] for a in LENGTHS]), key=level)
        if level(best) >= level(here):
            break
        here = best
    C.discard(cells)
    gaps = [abs(x - t) for x, t in zip(here["totals"], want)]
    met = sum(gaps) <= tolerance * max(sum(want), 1.0) and all(g <= tolerance * b for g, b in zip(gaps, before) if b > 0)
    named = lambda x: dict(zip(DOMAINS, x))
    report = {"before": named(before), "target": named(want), "fitted": named(here["totals"]), "rounds": done, "met": met}
    if not met:
        LOG.warning("mixing: the targets %s are out of reach; fitted totals %s after %d rounds", report["target"], report["fitted"], done)
    return rate_of(here["m"]), report


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, tolerance: float = TOLERANCE, keep: dict[str, float] | None = None, slack: float | None = None) -> tuple[DataFrame, dict]:
    """(doc_id, th, n, p_*, rate) of every row of docs, and the report of the fit with the classifier's accuracy."""
    model, known = train(docs, labels)
    rows = C.materialise(classify(docs, model, known), "posteriors")
    rate, report = fit(rows, targets, budget, tolerance, keep=keep, slack=slack)
    if not known["documents"]:
        # Nothing is known of any document: no rate is better than one.
        rate, report = F.lit(1.0), report | {"fitted": report["before"], "met": False}
    return rows.withColumn("rate", rate), report | {"accuracy": known["accuracy"], "labelled": known["documents"]}


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document; ``targets_met`` tells whether the fit reached its targets."""
    rows, report = mix(docs, labels)
    return rows.select("doc_id", F.col("n").alias("n_tokens"), *[F.round(p, 6).alias(p) for p in P], F.round("rate", 6).alias("rate"), F.lit(report["met"]).alias("targets_met"))


def chance() -> Column:
    """A fixed uniform number of a row's own, made from its key (doc_id, th)."""
    return F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "th"), F.lit(1 << 30)) / float(1 << 30)


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, tolerance: float = TOLERANCE, keep: dict[str, float] | None = None, slack: float | None = None) -> DataFrame:
    """The rows of docs that the rates keep: a row stays if its ``chance`` is below its rate. No row is repeated, so a
    rate above one keeps the row once."""
    rows, _ = mix(docs, labels, targets, budget, tolerance, keep, slack)
    return N.without(docs, rows.where(chance() >= F.col("rate")).select("doc_id", "th"))
