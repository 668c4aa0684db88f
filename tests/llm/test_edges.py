"""Very long texts through every operator, odd rows through every stage of the pipeline."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import chaining, decontam, linededup, mixing, ngram_lm, queries, rules, secrets, simhash, suffix, tokenstore

from . import brute
from .conftest import CLASH


@pytest.fixture(scope="module")
def long(spark):
    """A text of 5 MiB with all that is looked for at its very end, its copy, and short texts that hold the same."""
    rng = random.Random(41)
    words = [f"{rng.choice('abcdefghij')}{rng.randrange(60_000)}" for _ in range(60_000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item, lines = text(90), text(30), "\n".join(text(5) for _ in range(3))
    body = text(800_000)
    tail = f" {passage} {text(50)} {item} {text(50)} token=abcdefgh {text(9)}\n{lines}\n{text(9)}"
    rows = [(1, body + tail), (2, f"{text(40)} {passage} {text(40)}"), (3, f"{text(9)}\n{lines}\n{text(9)}"), (4, text(60)), (5, body + tail)]
    assert len(rows[0][1].encode()) > 5 << 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    return {"docs": docs, "rows": dict(rows), "passage": passage, "item": item, "lines": lines, "body": body}


def test_long_text_ngram_scores(long):
    out = {r.doc_id: r for r in ngram_lm.digest(long["docs"]).collect()}
    for i, t in long["rows"].items():
        assert out[i].n_tokens == len(t.split()) + 1 and np.isfinite(out[i].score)
    assert out[1].score == out[5].score


def test_long_text_decontamination(spark, long):
    items = spark.createDataFrame([(9, long["item"])], "item_id long, text string")
    assert {r.doc_id for r in decontam.digest(long["docs"], items).collect()} == {1, 5}


def test_long_text_lines(long):
    out = {r.doc_id: r.text for r in linededup.deduplicate(long["docs"]).collect()}
    # The first occurrence is in the long text; its copy and the short text lose theirs.
    assert out[1] == long["rows"][1] and long["lines"] not in out[3] and long["lines"] not in out[5]


def test_long_text_mixing(spark, long):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in mixing.digest(long["docs"], labels).collect()}
    for i, t in long["rows"].items():
        assert out[i].n_tokens == len(brute.runs(t)) and out[i].p_high + out[i].p_low + out[i].p_toxic == pytest.approx(1, abs=1e-5)


def test_long_text_passages(long):
    out = {r.doc_id: r for r in chaining.find(long["docs"]).collect()}
    assert set(out) == {1, 2, 5} and {r.class_id for r in out.values()} == {1}
    a, b = map(int, out[2].spans.split(":"))
    assert a <= 40 and b >= 130 and b - a < 95
    assert out[1].spans == f"0:{len(long['rows'][1].split())}" == out[5].spans


def test_long_text_quality(long):
    out = {r.doc_id: r for r in rules.digest(long["docs"]).collect()}
    for i, t in long["rows"].items():
        assert (out[i].n_words, out[i].word_chars, out[i].n_symbols) == (len(t.split()), sum(map(len, t.split())), sum(c in "#*$%&|<>" for c in t))
        assert out[i].kept == brute.quality(t)


def test_long_text_fingerprints(long):
    out = {r.doc_id: r for r in simhash.digest(long["docs"]).collect()}
    w = long["rows"][1].encode().lower().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert out[1].fingerprint == out[5].fingerprint == f"{want:016x}" and out[5].component_id == 1


def test_long_text_secrets(long):
    out = {r.doc_id: r for r in secrets.digest(long["docs"]).collect()}
    at = long["rows"][1].index("token=abcdefgh")
    assert out[1].spans == out[5].spans == f"assign:{at}:{at + 14}" and not out[2].spans


def test_long_text_substrings(long):
    out = {r.doc_id: r for r in suffix.digest(long["docs"]).collect()}
    n = len(long["passage"].encode())
    assert n >= 400
    assert out[1].n_removed == out[1].n_bytes == len(long["rows"][1].encode()) and out[5].n_removed == out[5].n_bytes
    assert n <= out[2].n_removed <= n + 8 and out[2].n_spans == 1 and out[4].n_removed == out[4].n_repeated == 0


def test_long_text_tokens(long):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    out = {r.doc_id: r for r in tokenstore.digest(long["docs"], queries.tokenizer_path()).collect()}
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in long["rows"].items()}
    assert all((out[i].n_tokens, out[i].ids_crc32) == (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items())
    assert out[5].start == sum(len(ids[i]) for i in (1, 2, 3, 4))


# --- the pipeline ------------------------------------------------------------------------------


def fresh(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and long texts, repeated rows, ties and clashing columns."""
    rng = random.Random(43)
    item = fresh(rng, 30)
    texts = [(i, fresh(rng, 60)) for i in [*range(20), *range(100, 160)]]
    toxic = [(i, f"{fresh(rng, 40)} scum {fresh(rng, 5)} idiot {fresh(rng, 15)}") for i in range(20, 30)]
    rows = [*texts, *toxic, (30, None), (31, ""), (32, " \n "), (None, fresh(rng, 60)), (None, None), texts[0], texts[0], (33, texts[1][1]), (34, f"{fresh(rng, 30)} {item} {fresh(rng, 30)}"), (35, fresh(rng, 120_000)), (36, "short one")]
    wide = [(i, t, None if (i or 0) % 2 else "en", "s", None, *["x", 1, 2, 3, True, "y", "z", "w", "k"]) for i, t in rows]
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item, "x"), (2, None, "x"), (None, fresh(rng, 30), "x"), (3, "", "x")], "item_id long, text string, th string").write.parquet(f"{path}/benchmark.parquet")
    marks = [(i, 1, 0) for i, _ in texts] + [(i, 1, 1) for i in range(20, 30)] + [(None, 1, 1), (35, None, None), (0, 1, 0)]
    spark.createDataFrame([(*m, "x", 1) for m in marks], "doc_id long, quality int, toxic int, text string, n int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_odd_rows_through_the_stages(spark, odd, tmp_path):
    path, rows = odd
    docs = queries.table(spark, path, "documents")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns, name
            kept[k] = sorted(str(r.doc_id) for r in docs.collect())
    good = [str(i) for i, t in rows if t and len(t.split()) >= 20]
    assert kept[0] == sorted(good)
    assert kept[1] == sorted(set(good) - {"33"})
    assert kept[2] == sorted(set(kept[1]) - {"34"})
    assert set(kept[3]) >= {str(i) for i in [*range(20), *range(100, 160), 35, None]} and not set(kept[3]) & {str(i) for i in range(20, 30)}
    last = docs.orderBy("start").collect()
    assert [str(r.doc_id) for r in last] == sorted(kept[3], key=lambda i: (i != "None", int(i) if i != "None" else 0))
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=str) == sorted(map(tuple, last), key=str)


def test_stages_of_empty_tables(spark, odd, tmp_path):
    path, _ = odd
    for name in ("documents", "benchmark", "labels"):
        queries.table(spark, path, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    # Documents against an empty benchmark and without labels: both stages keep all.
    docs = queries.table(spark, path, "documents")
    for k in (2, 3):
        kept = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        assert kept.count() == docs.count() and kept.columns == docs.columns
    assert docs.where("text is null or text = ''").count() == 3
    none = corpus_pipeline.STAGES[4][1](spark, docs.where(F.col("text").isNull() | (F.col("text") == "")), str(tmp_path))
    assert [r.n_tokens for r in none.collect()] == [1, 1, 1]
