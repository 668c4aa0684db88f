import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import mixing, queries

REPO = Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = queries.table(spark, sf, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_each_stage_keeps_columns_and_removes_its_own(spark, sf, stages):
    docs = queries.table(spark, sf, "documents")
    before = {r.doc_id for r in docs.collect()}
    for name, kept in stages[:-1]:
        assert kept.columns == docs.columns, name
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
    assert {r.doc_id for r in stages[-1][1].collect()} == before


def test_clean_documents_stay(spark, sf, stages):
    labels = {r.doc_id: (r.quality, r.toxic) for r in queries.table(spark, sf, "labels").collect()}
    before = {r.doc_id for r in stages[2][1].collect()}
    after = {r.doc_id for r in stages[3][1].collect()}
    clean = [i for i in before if labels.get(i) == (1, 0)]
    assert sum(i in after for i in clean) >= 0.9 * len(clean)
    insults = {"idiot", "moron", "scum", "trash", "stupid", "loser", "clown", "worthless", "pathetic", "disgusting"}
    texts = {r.doc_id: r.text for r in stages[2][1].collect()}
    toxic = [i for i, t in texts.items() if len(insults & set(re.findall("[a-z]+", t.lower()))) >= 2]
    assert toxic and sum(i in after for i in toxic) <= 0.2 * len(toxic)


def test_stages_equal_brute_force(spark, sf, stages):
    from tokenizers import Tokenizer

    from . import brute

    tk = Tokenizer.from_file(queries.tokenizer_path())
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    items = [r.text for r in queries.table(spark, sf, "benchmark").collect()]
    labels = queries.table(spark, sf, "labels")

    def mixture(d):
        few = {r.k_id: r for r in mixing.sample(labels).collect()}
        post = brute.posteriors(d, {i: r.domain for i, r in few.items()}, {i: r.fold for i, r in few.items()})
        ids, n = sorted(d), [len(brute.runs(d[i])) for i in sorted(d)]
        p = np.array([post[i] for i in ids])
        before = (np.array(n)[:, None] * p).sum(axis=0)
        keep = [corpus_pipeline.MIX[k] for k in mixing.DOMAINS]
        r = brute.rates(n, p, keep * before, corpus_pipeline.MIX_SLACK)
        rows = spark.createDataFrame(list(d.items()), "doc_id long, text string").withColumn("th", F.xxhash64("text"))
        chance = {x.doc_id: x.c for x in rows.select("doc_id", mixing.chance().alias("c")).collect()}
        return {i: d[i] for i, x in zip(ids, r) if chance[i] < x}

    steps = [lambda d: {i: t for i, t in d.items() if brute.quality(t)}, brute.near_duplicates, lambda d: brute.decontaminate(d, items), mixture]
    for (name, kept), step in zip(stages[:-1], steps):
        docs = step(docs)
        assert {r.doc_id: r.text for r in kept.collect()} == docs, name
    want = brute.tokens(docs, lambda t: tk.encode(t, add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages[-1][1].collect()) == want


def test_run_equals_the_stages(spark, sf, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == sorted(map(tuple, stages[-1][1].collect()))


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "siltstone"):
        os.symlink(REPO / name, tmp_path / name) if name.endswith(".py") else subprocess.run(["cp", "-r", REPO / name, tmp_path / name], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "siltstone" / "llm"], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    subprocess.run(["cp", REPO / "__spark_entry__.py", tmp_path], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-1] == "False"
