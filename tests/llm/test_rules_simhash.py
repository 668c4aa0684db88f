import collections
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from siltstone.llm import common, rules, simhash

WORD = r"[^\x20\x09-\x0D]+"


def measures(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def key(row):
    return str(row)


def test_rules_equal_brute_force(docs, rows):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.digest(docs).collect()]
    assert sorted(got, key=key) == sorted([(i, *measures(t)) for i, t in rows], key=key)


def test_keep_equals_the_ledger(docs):
    book = rules.apply_policy(rules.ledger(docs)).collect()
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted(key(r.doc_id) for r in book if r.kept)
    assert all(not r.kept for r in book if r.n_words < 20)


def test_ablations(docs):
    book = rules.ledger(docs).collect()
    mask = rules.policy_mask("v2")
    for r in rules.ablations(rules.ledger(docs), "v2").collect():
        bit = 1 << list(rules.RULES).index(r.rule)
        assert r.failed == sum(bool(x.failed & bit) for x in book)
        assert r.kept_without == sum(x.failed & mask & ~bit == 0 for x in book)


def test_empty_tables(empty):
    assert rules.digest(empty).collect() == [] and rules.keep(empty).collect() == []
    assert simhash.digest(empty).collect() == [] and simhash.deduplicate(empty).collect() == []


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, radius=4):
    names = list(range(len(values)))

    def top(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                names[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_simhash_equals_brute_force(docs, rows):
    prints = [fingerprint(t) for _, t in rows]
    group = linked(prints)
    low = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    want = [(i, f"{p:016x}", low.get(g)) for (i, _), p, g in zip(rows, prints, group)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = [r.doc_id for r in simhash.deduplicate(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(low.values())) and kept.count(None) == 2


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20, unique=True), st.data())
def test_tree_search_finds_all(base, data):
    near = [b ^ sum(1 << x for x in data.draw(st.sets(st.integers(0, 63), max_size=4))) for b in base]
    values = np.unique(np.array(base + near, np.uint64))
    forest = simhash.Forest(values, np.zeros(len(values), np.int64))
    got = {(int(q), int(n)) for a, b in forest.search(values, np.zeros(len(values), np.int64), 4) for q, n in zip(a, b)}
    assert got == {(i, j) for i in range(len(values)) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 4}


@pytest.mark.parametrize("limit", [2, 7])
def test_hot_shards_lose_no_link(spark, limit):
    values = [(x ^ (1 << b)) - (1 << 63) for x in (0, 0xFFFF << 20) for b in range(0, 60, 3)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in common.components(simhash.links(df, shard_limit=limit)).collect()}
    groups = linked([v % (1 << 64) for v in values])
    for i, v in enumerate(values):
        assert (got.get(v, v) == got.get(values[0], values[0])) == (groups[i] == groups[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (200, 200), (101, 100), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
