"""Elias-Fano, token shards, language model, suffix arrays, chaining."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import chaining, elias, ngram_lm, queries, suffix, tokenstore


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 60))
def test_elias_fano(values, shift):
    v = np.sort(np.array(values, np.uint64) >> np.uint64(shift))
    e = elias.EliasFano(np.frombuffer(elias.encode(v), np.uint8))
    assert e.decode().tolist() == v.tolist()
    assert e.select(np.arange(len(v))).tolist() == v.tolist()
    for a in range(0, len(v), 7):
        assert e.decode(a, min(a + 5, len(v))).tolist() == v[a : a + 5].tolist()
    probe = np.concatenate([v, v[:5] + np.uint64(1)])
    if len(probe):
        assert e.successor(probe)[0].tolist() == np.searchsorted(v, probe).tolist()


@pytest.mark.parametrize("n, step", [(1, 5), (5, 0), (3000, 1), (70_000, 3), (70_000, 2**40)])
def test_elias_fano_walks_and_searches_alike(n, step):
    rng = np.random.default_rng(n)
    v = np.cumsum(rng.integers(0, step + 1, n)).astype(np.uint64)
    e = elias.EliasFano(np.frombuffer(elias.encode(v), np.uint8))
    for m in (1, 200, 20_000):
        x = np.append(np.sort(rng.integers(0, int(v[-1]) + 3, m, dtype=np.uint64)), np.uint64(2**64 - 1))
        want = np.searchsorted(v, x)
        at, value = e.successor(x)
        assert (at == want).all() and (value == np.where(want < n, v[np.minimum(want, n - 1)], 0)).all()
        assert (e._search(x) == want).all()
        i = np.sort(rng.integers(0, n, m))
        assert (e.take(i) == v[i]).all()


def test_elias_fano_is_small_and_refuses_disorder():
    v = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000)).astype(np.uint64)
    # 2 + ceil(log2(u / n)) bits each, and 64 bits of directory for each 512.
    assert len(elias.encode(v)) * 8 < 100_000 * (2 + math.ceil(math.log2(1000))) * 1.04
    with pytest.raises(ValueError):
        elias.encode(np.array([2, 1], np.uint64))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t


@given(text=st.text(alphabet=st.sampled_from("ab'sé 𝒳1,.\n\t  <|endoftext|>"), max_size=60))
def test_encoder_equals_the_library(text):
    e = tokenstore.encoder(queries.tokenizer_path())
    assert np.frombuffer(e.encode(text), np.uint16).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_remembers_a_bounded_number_of_pieces(monkeypatch):
    """Two generations, whatever a text holds; frequent words outlive them, and ids stay those of the library."""
    from siltstone.llm import queries

    monkeypatch.setattr(tokenstore, "CACHE_WORDS", 50)
    enc = tokenstore.Encoder(queries.tokenizer_path())
    for i in range(40):
        text = "\n".join(f"the wörd{chr(97 + i % 26)}{chr(97 + j)}, x{i}{j}. end the" for j in range(10)) + "  \n the"[: 4 * (i % 3)]
        assert enc.encode(text) == enc._pack(enc.tokenizer.encode(text, add_special_tokens=False).ids)
        assert len(enc.known) + len(enc.older) <= 250
    held = enc.known | enc.older
    assert "the" in held


@pytest.mark.parametrize("limit", [tokenstore.SHARD_IDS, 500])
def test_token_shards_round_trip(spark, docs, rows, tokenizer, limit):
    out, told = tokenstore.write(docs, queries.tokenizer_path(), shard_ids=limit)
    got = tokenstore.read(spark, out).orderBy("start").collect()
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    first = told.orderBy("shard").first()
    shard = tokenstore.Shard(first.uri)
    assert len(shard.document(0)) == got[0].n_tokens and len(shard) == first.documents
    assert (told.count() > 4) == (limit == 500)


def test_manifest_starts_are_sums_over_blocks_of_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenstore, "PART_BLOCK", 2)
    wide = docs.where("doc_id is not null").repartition(12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, told = tokenstore.write(wide, queries.tokenizer_path(), shard_ids=300)
        rows = told.orderBy("part", "start").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.shard for r in rows] == list(range(len(rows))) and len({r.part for r in rows}) > 2
    assert [r.start for r in rows] == [0, *np.cumsum([r.tokens for r in rows])[:-1].tolist()]


@given(parts=st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "ab", " cd", "é,", "12"]), max_size=12))
def test_encoder_equals_an_untouched_library(parts):
    from tokenizers import Tokenizer

    text = "".join(parts)
    plain = Tokenizer.from_file(queries.tokenizer_path())
    assert np.frombuffer(tokenstore.encoder(queries.tokenizer_path()).encode(text), np.uint16).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_shards_hold_added_tokens(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["foo <|endoftext|> bar", "foo bar", "<|endoftext|>"]
    got = tokenstore.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer_path()).orderBy("doc_id").collect()
    ids = [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]
    assert [r.start for r in got] == [0, *np.cumsum([len(x) for x in ids])[:-1].tolist()]


def test_token_shards_of_nothing(spark, empty):
    assert tokenstore.digest(empty, queries.tokenizer_path()).collect() == []


def test_runs_of_counts_pack_and_unpack():
    key = np.sort(np.random.default_rng(3).integers(0, 2**64 - 1, 500, dtype=np.uint64))
    count = np.where(np.arange(500) % 7, 3, 2**40 + np.arange(500))
    extra = (np.arange(500) % 256).astype(np.uint8)
    got = ngram_lm.unpack_run(ngram_lm.pack_run(key, count, extra))
    assert all((a == b).all() for a, b in zip(got, (key, count, extra)))


def test_storing_all_ngrams_scores_training_texts_higher(docs):
    totals = []
    for least in (2, 1):
        model, ids = ngram_lm.train(docs, min_count=least)
        totals.append(ngram_lm.score(model, ids).where("not held_out").agg(F.sum("score")).first()[0])
    assert totals[1] > totals[0]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [0]


@pytest.mark.parametrize("shard", [ngram_lm.SHARD, 37])
def test_language_model_equals_brute_force(docs, rows, monkeypatch, shard):
    monkeypatch.setattr(ngram_lm, "SHARD", shard)
    model, ids = ngram_lm.train(docs)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    train = [tokens(t) for i, t in rows if not held(i)]
    c1 = collections.Counter(w for v in train for w in v)
    c2 = {k: c for k, c in collections.Counter(p for v in train for p in zip(v, v[1:])).items() if c > 1}
    c3 = {k: c for k, c in collections.Counter(p for v in train for p in zip(v, v[1:], v[2:])).items() if c > 1}
    total, kinds, cut = sum(c1.values()), len(c1), ngram_lm.DISCOUNT
    s2, s3 = collections.Counter(), collections.Counter()
    for k, c in c2.items():
        s2[k[0]] += c - cut
    for k, c in c3.items():
        s3[k[:2]] += c - cut
    p1 = lambda w: (c1[w] + 0.1) / (total + 0.1 * (kinds + 1))

    def p2(u, w):
        return p1(w) if not c1[u] else max(c2.get((u, w), cut) - cut, 0) / c1[u] + (1 - s2[u] / c1[u]) * p1(w)

    def p3(t, u, w):
        n = c2.get((t, u))
        return p2(u, w) if not n else max(c3.get((t, u, w), cut) - cut, 0) / n + (1 - s3[t, u] / n) * p2(u, w)

    want = []
    for i, t in rows:
        v = tokens(t)
        logs = [math.log10(p1(w) if k == 0 else p2(v[k - 1], w) if k == 1 else p3(v[k - 2], v[k - 1], w)) for k, w in enumerate(v)]
        want.append((str(i), held(i), len(v), sum(c1[w] > 0 for w in v), total, sum(math.log10(p1(w)) for w in v), sum(logs)))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score(model, ids).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
        assert abs(a[6] - b[6]) <= 0.03 * b[2]
    # Each distribution sums to one over the vocabulary and one unknown word.
    u = max(s2, key=s2.get)
    assert sum(p2(u, w) for w in [*c1, "?"]) == pytest.approx(1)


def test_language_model_beats_its_base_on_held_out_texts(spark, sf):
    out = ngram_lm.digest(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > out.b


def test_language_model_of_nothing(spark, empty):
    assert ngram_lm.digest(empty).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = ngram_lm.digest(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3)


def test_suffix_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        length, letters = rng.choice([4, 8, 12]), [0, 255, 97][: rng.choice([1, 2, 3])]
        contexts = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 6))]
        weights = [rng.choice([1, 1, 2]) for _ in contexts]
        count = collections.Counter()
        for c, w in zip(contexts, weights):
            for i in range(len(c) - length + 1):
                count[c[i : i + length]] += w
        owner, start = suffix.repeated_starts(contexts, np.array(weights, float), length)
        assert set(zip(owner.tolist(), start.tolist())) == {(k, i) for k, c in enumerate(contexts) for i in range(len(c) - length + 1) if count[c[i : i + length]] > 1}
        least = length // 2
        last = [rng.randint(0, len(c) - least) for c in contexts]
        few = collections.Counter()
        for size in (least, length):
            for c, w, z in zip(contexts, weights, last):
                for i in range(min(z, len(c) - size) + 1):
                    few[c[i : i + size]] += w
        owner, start, long = suffix.repeated_starts(contexts, np.array(weights, float), length, np.array(last), least)
        got = {(k, i): x for k, i, x in zip(owner.tolist(), start.tolist(), long.tolist())}
        places = [(k, i) for k, z in enumerate(last) for i in range(z + 1)]
        assert set(got) == {(k, i) for k, i in places if few[contexts[k][i : i + least]] > 1}
        assert {p for p, x in got.items() if x} == {(k, i) for k, i in places if len(contexts[k][i : i + length]) == length and few[contexts[k][i : i + length]] > 1}


@pytest.mark.parametrize("group_bytes", [suffix.GROUP_BYTES, 1500])
def test_suffix_dedup_equals_brute_force(docs, rows, group_bytes, monkeypatch):
    monkeypatch.setattr(suffix.repeated, "__defaults__", (suffix.LENGTH, group_bytes))
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    weak = collections.Counter(t[i : i + 256] for _, t in texts for i in range(len(t) - 255))
    want = []
    for i, t in texts:
        cut, told = set(), set()
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                cut.update(range(k, k + 400))
        for k in range(len(t) - 255):
            if weak[t[k : k + 256]] > 1:
                told.update(range(k, k + 256))
        want.append((str(i), len(t), len(cut), sum(k - 1 not in cut for k in cut), len(told), hashlib.sha256(bytes(b for k, b in enumerate(t) if k not in cut)).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.n_repeated, r.kept_sha256) for r in suffix.digest(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 1000


def test_suffix_dedup_of_nothing(empty):
    assert suffix.digest(empty).collect() == []


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=25, unique=True))
def test_best_chain_equals_quadratic_search(points):
    points.sort(key=lambda p: (p[0], -p[1]))
    cost, k = chaining.GAP_COST, chaining.K
    best = []
    for i, (x, y) in enumerate(points):
        # The predecessor is chosen by score and gap; its step then adds the words that are new.
        options = [(best[j] + cost * sum(points[j]), j) for j in range(i) if points[j][0] < x and points[j][1] < y]
        top = max(options, default=(-1e18, -1))
        gain = top[0] - cost * (x + y)
        best.append(gain + min(k, x - points[top[1]][0], y - points[top[1]][1]) if gain > 0 else float(k))
    found = chaining.chains([p[0] for p in points], [p[1] for p in points])
    assert found[0][0] == pytest.approx(max(best))
    assert all(x0 <= x1 and y0 <= y1 for _, x0, x1, y0, y1 in found)


@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    assert chaining.common_words(a, b) == row[-1]


def test_passages(spark, docs, rows):
    out = {r.doc_id: r for r in chaining.find(docs).collect()}
    for i in range(40, 44):
        a, b = map(int, out[i].spans.split(":"))
        assert a <= 25 and b >= 115 and b - a < 100
    assert len({out[i].class_id for i in range(40, 44)}) == 1
    assert out[30].class_id == out[31].class_id == out[3].class_id == 3
    assert {0, 1, 2, 60, 61, 62, 63, 66}.isdisjoint(out)
    assert chaining.find(docs.limit(0)).collect() == []


def test_fuzzy_passage_with_edits(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    p = words(80)
    q = [w if k % 27 else "edit" for k, w in enumerate(p)]
    del q[40]
    df = spark.createDataFrame([(0, " ".join(words(50) + p + words(50))), (1, " ".join(words(9) + q)), (2, " ".join(words(300)))], "doc_id long, text string")
    out = {r.doc_id: r for r in chaining.find(df).collect()}
    assert set(out) == {0, 1} and out[0].dup_words >= 75 and out[0].n_links == 1


def spans_of(row):
    return [tuple(map(int, x.split(":"))) for x in row.spans.split(",")]


def test_every_shared_run_is_found(spark):
    """Against brute force: each run of 40 or more equal words of two texts is covered on both sides, and the two are
    of one class. Frequent phrases and lines of 12 to 30 words give hubs that share a run and no passage."""
    rng = random.Random(17)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    lines = [words(rng.randint(12, 30)) for _ in range(4)]
    texts = []
    for i in range(60):
        texts.append(words(20) + lines[i % 4] + words(15) + lines[(i + 1) % 4] + words(10))
    for n in (40, 41, 45, 50, 60, 80, 120, 200):
        for copies in (2, 3):
            passage = words(n // 2) + rng.choice(lines)[: n // 4]
            passage += words(n - len(passage))
            texts += [words(rng.randint(0, 30)) + passage + words(rng.randint(0, 30)) for _ in range(copies)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in chaining.find(df).collect()}
    where = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for k in range(len(t) - 39):
            where[tuple(t[k : k + 40])].append((i, k))
    some = [x for x in where.values() if len({i for i, _ in x}) > 1]
    assert len(some) > 500
    for x in some:
        assert all(any(a <= k and k + 40 <= b for a, b in spans_of(got[i])) for i, k in x)
        assert len({got[i].class_id for i, _ in x}) == 1
    assert set(got) == {i for x in some for i, _ in x}


def test_edited_passages_are_found(spark):
    """Passages whose K-word shingles are 0.8 alike, with hubs that share a line of them only: recall by length."""
    rng = random.Random(23)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line, pairs, texts = words(14), [], [words(30) for _ in range(40)]
    texts = [t[:10] + line + t[10:] for t in texts]
    for n in (40, 60, 100, 200):
        for _ in range(10):
            p = words(n)
            at = rng.randrange(n - 14)
            p[at : at + 14] = line
            q, spared = list(p), range(at, at + 14)
            shingles = lambda v: {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
            while True:
                r = list(q)
                k = rng.choice([x for x in range(5, n - 5) if x not in spared])
                r[k] = f"e{rng.randrange(10**6)}"
                if len(shingles(r) & shingles(p)) < 0.8 * len(shingles(p)):
                    break
                q = r
            pairs.append((len(texts), len(texts) + 1, n))
            texts += [words(25) + p + words(25), words(7) + q + words(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in chaining.find(df).collect()}
    for a, b, n in pairs:
        assert got[a].class_id == got[b].class_id == a
        # An end that is cut off by edits and has no seed of its own may be missing.
        assert all(sum(z - y for y, z in spans_of(got[i])) >= 40 for i in (a, b))
    share = [sum(z - y for y, z in spans_of(got[i])) / n for a, b, n in pairs for i in (a, b)]
    assert np.mean(share) > 0.9
    assert set(range(40)).isdisjoint(got)


def test_select_reads_words_and_not_all_octets_of_a_block():
    rng = np.random.default_rng(3)
    for n, top in ((40000, 1 << 40), (40000, 60000), (3, 9)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        own = elias.EliasFano(np.frombuffer(elias.encode(values), np.uint8))
        at = np.sort(rng.integers(0, n, 1 << 14))
        tracemalloc.start()
        got = own.select(at)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got == values[at]).all()
        # Before, 64 counts of 8 bytes for each value.
        assert peak < (1 << 14) * 64 * 8
        ask = np.sort(rng.integers(0, top + 5, 5000).astype(np.uint64))
        assert (own._search(ask) == np.searchsorted(values, ask)).all()


def test_open_pairs_deal_a_row_an_occurrence_and_join_hot_runs_alike(spark, monkeypatch):
    rng = random.Random(31)
    word = lambda n: [f"w{rng.randrange(50)}" for _ in range(n)]
    line, passage = [f"l{i}" for i in range(chaining.RUN)], word(70)
    texts, rest = [], []
    for t in range(24):
        head = word(rng.randrange(30, 60)) + (passage if t % 3 == 0 else word(70))
        if t % 4 == 0:
            head = ["again", "and"] * 20 + head
        texts.append((t - 12, " ".join(head + line + word(40))))
        rest.append((7 + t // 20, t - 12, len(head), t // 9 - 12, t % 5 == 0))
    docs = spark.createDataFrame(texts, "t long, text string")
    rest = spark.createDataFrame(rest, "key long, t long, pos int, root long, done boolean")
    # Before, each occurrence was shuffled as some 270 rows of a shingle.
    assert chaining._near_lists(docs, rest).count() == rest.count()
    want = sorted(map(tuple, chaining._pairs(chaining._rare(chaining._near_rows(chaining._near_lists(docs, rest)))).collect()))
    assert len(want) > 20
    for group in (2048, 10, 0):
        monkeypatch.setattr(chaining, "GROUP", group)
        for joined in (1 << 21, 5):
            monkeypatch.setattr(chaining, "JOINED", joined)
            assert sorted(map(tuple, chaining._open_pairs(docs, rest).collect())) == want


def test_join_of_a_run_holds_each_pair_once(monkeypatch):
    """512 unlike texts with much in common around a run: each of their 130,816 pairs meets at some 130 tokens."""
    rng = np.random.default_rng(5)
    own = rng.integers(0, 1 << 63, 270).astype(np.uint64)
    near = [np.sort(np.where(rng.random(270) < 0.3, rng.integers(0, 1 << 63, 270).astype(np.uint64), own)).tobytes() for _ in range(512)]
    t = np.arange(512)
    tracemalloc.start()
    i, j = chaining.near_pairs(t, t, np.zeros(512, bool), near)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(zip(i.tolist(), j.tolist()))) == len(i) == 512 * 511 // 2 and (i > j).all()
    assert peak < 48 << 20
    few = near[:40] + [np.sort(rng.integers(0, 1 << 63, 270).astype(np.uint64)).tobytes() for _ in range(10)]
    t, root, done = rng.integers(-30, 30, 50), rng.integers(0, 3, 50), rng.random(50) < 0.5
    found = []
    for often in (0, 32, 1 << 30):
        monkeypatch.setattr(chaining, "OFTEN", often)
        found.append(sorted(zip(*(x.tolist() for x in chaining.near_pairs(t, root, done, few)))))
    assert found[0] == found[1] == found[2] and 100 < len(found[0]) < 50 * 49 // 2


def test_pairs_among_many_unlike_texts_with_the_same_line(spark):
    """Passages all of whose runs of 20 words are those of a line of 30 that 300 unlike texts share, so that hubs are texts
    unlike them; and texts that other passages cover already, whose two classes only such a passage joins."""
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = words(30)
    texts = [words(30) + line + words(30) for _ in range(300)]
    pairs, bridges = [], []
    for _ in range(8):
        own = words(14)
        pairs.append(len(texts))
        texts += [words(25) + line + words(1) + own + words(25) for _ in range(2)]
    for _ in range(8):
        u, v, own = words(15), words(15), words(10)
        bridges.append(len(texts))
        texts += [words(30) + u + line + words(30), words(30) + u + line + words(1) + own + words(30)]
        texts += [words(30) + v + line + words(1) + own + words(30), words(30) + v + line + words(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in chaining.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].class_id for i in got} == {i + j: i for x, n in ((pairs, 2), (bridges, 4)) for i in x for j in range(n)}
    assert all(spans_of(got[i + j]) == [(25, 70)] and got[i + j].n_links == 1 for i in pairs for j in range(2))
    assert all(spans_of(got[i + j]) == [(30, 86)] and got[i + j].n_links == 2 for i in bridges for j in (1, 2))


def test_stretches_without_room_for_a_passage_are_not_chained(monkeypatch):
    """Words that texts repeat over and over match everywhere; where no range of 40 words can be a passage, no chain is made.
    Against the alignment without that bound, on texts that repeat few words, all passages are the same."""
    code = lambda text: np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    few, many = code("a" * 40 + "b" * 37 + "c" * 40), code("d" * 40 + "b" * 60 + "e" * 40)
    twice = code("f" * 20 + "b" * 20 + "g" * 20 + "h" * 20 + "i" * 20 + "b" * 20)
    with monkeypatch.context() as patch:
        patch.setattr(chaining, "members", lambda *args, **kind: pytest.fail("a chain is made"))
        for a, b in ((few, many), (many, few), (twice, many), (few, twice)):
            assert chaining.dense(a, b, range(-200, 200)) == []
    rng = random.Random(41)
    hits = 0
    for small in (chaining.SMALL, 0):
        monkeypatch.setattr(chaining, "SMALL", small)
        for _ in range(150):
            runs = [(rng.choice("abcde"), rng.randint(1, 30)) for _ in range(rng.randint(3, 9))]
            a = "".join(w * n for w, n in runs)
            b = "".join(w * max(1, n + rng.choice((-6, -1, 0, 0, 0, 3))) + rng.choice(("", "", "x", "yyyyyyyyy")) for w, n in runs)
            a, b = code(a + "k" * rng.randint(0, 50)), code("l" * rng.randint(0, 50) + b)
            slant = range(-60, rng.randint(-20, 60))
            got = chaining.dense(a, b, slant)
            with monkeypatch.context() as patch:
                patch.setattr(chaining, "roomy", lambda *_: True)
                assert chaining.dense(a, b, slant) == got
            hits += len(got) > 0
    assert hits > 50


def test_rows_that_repeat_and_null_ids_take_part_once(spark):
    rng = random.Random(29)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    p = words(50)
    a, b = " ".join(words(9) + p), " ".join(p + words(9))
    rows = [(4, a), (4, a), (4, a), (7, b), (None, b), (None, a), (9, " ".join(words(60)))]
    out = chaining.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in out) == sorted([("4", 4, 1)] * 3 + [("7", 4, 1), ("None", 4, 1), ("None", 4, 1)])
    only = chaining.find(spark.createDataFrame([(None, a), (None, b)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.class_id, r.n_links) for r in only] == [(None, None, 1)] * 2


def test_two_passages_around_different_bodies(spark):
    """Both bodies are too long for one passage, and short enough for one chain."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    head, foot = words(60), words(60)
    df = spark.createDataFrame([(i, " ".join(head + words(110) + foot)) for i in range(3)], "doc_id long, text string")
    out = chaining.find(df).collect()
    assert {(r.doc_id, r.class_id, r.n_passages, r.spans) for r in out} == {(i, 0, 2, "0:60,170:230") for i in range(3)}


def test_a_chain_is_cut_into_its_similar_ranges():
    rng = np.random.default_rng(2)
    head, mid, foot = (rng.integers(1, 1 << 60, n).astype(np.uint64) for n in (50, 50, 70))
    noise = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    a, b = (np.concatenate([head, noise(100), mid, noise(100), foot]) for _ in range(2))
    xs = [3, 20, 40, 155, 190, 301, 350]
    assert chaining.similar(a, b, xs, xs) == [(0, 50, 0, 50, 50), (150, 200, 150, 200, 50), (300, 370, 300, 370, 70)]
    # Matches on other diagonals that overlap make runs that do not.
    c = np.array([7, 7, 7, 8, 7, 7, 7, 7, 8], np.uint64)
    for x, y, n in (found := chaining.runs(c, c[1:], [1, 4], [0, 4])):
        assert (c[x : x + n] == c[1:][y : y + n]).all()
    assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(found, found[1:]))
