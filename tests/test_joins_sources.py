"""Fuzzy joins against all pairs, the HTTP source, stored fielded indexes, files by title, shipping."""

import http.server
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

import siltstone
from siltstone import catalog, cli, roundtrips
from siltstone.functions import fuzzy
from siltstone.operators import fielded, fuzzyjoin, rank
from siltstone.plans import enrichment as E
from siltstone.plans import query as Q
from siltstone.sources import http as H
from siltstone.sources import shared


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7, 0.85, 0.95])
def test_fuzzy_join_equals_all_pairs(spark, threshold):
    words = ["north", "south", "park", "art", "dart", "mouth", "dartmouth", "a", "st", "lake city"]
    names = lambda shift: [(f"b{i % 2}", " ".join(words[(i * k + shift) % len(words)] for k in range(1, 2 + i % 4))) for i in range(60)]
    left = spark.createDataFrame([*names(0), ("b0", ""), ("b0", None)], "block string, a string")
    right = spark.createDataFrame([*names(3), ("b1", ""), (None, "north")], "block string, b string")
    got = {tuple(r) for r in fuzzyjoin.similar_pairs(left, right, threshold).collect()}
    every = left.distinct().join(right.withColumnRenamed("block", "c").distinct(), F.col("block") == F.col("c"))
    want = {tuple(r) for r in every.select("block", "a", "b", fuzzy.score_normalized(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= threshold).collect()}
    assert got == want and len(want) > (20 if threshold < 0.9 else 0)


class Pages(http.server.BaseHTTPRequestHandler):
    asked: dict = {}

    def do_GET(self):
        self.asked[self.path] = self.asked.get(self.path, 0) + 1
        if self.path == "/gone":
            self.send_error(404)
            return
        robot = self.path == "/check" and self.asked[self.path] < 3
        body = ("<p>Are you a robot?</p>" if robot else f"<p>é {self.path}</p>").encode()
        self.send_response(200)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_over_http(spark, site, tmp_path):
    spark.dataSource.register(H.HttpPages)
    (tmp_path / "urls.txt").write_text("\n".join(f"{site}{p}" for p in ("/a", "/b", "/check")) + "\n\n")
    rows = spark.read.format("siltstone_pages").option("urls", str(tmp_path / "urls.txt")).option("delay", "0.01").option("partitions", "2").load()
    assert {(r.url, r.html, r.status_code) for r in rows.collect()} == {(f"{site}{p}", f"<p>é {p}</p>", 200) for p in ("/a", "/b", "/check")}
    (tmp_path / "bad.txt").write_text(f"{site}/gone")
    with pytest.raises(Exception, match="404"):
        spark.read.format("siltstone_pages").option("urls", str(tmp_path / "bad.txt")).load().collect()


def test_fielded_index_is_kept_and_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"pool {'house' if i % 2 else 'lodge'}", i * 10) for i in range(20)], "id long, body string, price long")
    built = fielded.build(docs, "id", {"body": "text", "price": "number"}, "body")
    path = str(tmp_path / "f")
    fielded.build(docs.limit(3), "id", {"body": "text"}, "body").save(path)
    built.save(path)
    again = fielded.load(spark, path)
    for text in ("pool house", '"pool house" AND price:[* TO 90]', "hou*", "lodge~1"):
        assert sorted(map(tuple, Q.scores(again, text).collect())) == sorted(map(tuple, Q.scores(built, text).collect()))


def test_query_command_keeps_its_index(spark, sf, tmp_path, capsys):
    rows = roundtrips._joined(spark, sf)
    rows.write.json(str(tmp_path / "joined"))
    out = []
    for _ in range(2):
        cli.main(["query", str(tmp_path / "joined"), "promo AND price:[* TO 5000]", "--index", str(tmp_path / "i")])
        out.append(capsys.readouterr().out)
    assert out[0] == out[1] and "rank" in out[0]
    assert fielded.load(spark, str(tmp_path / "i")).docs.count() == rows.count()


def test_searcher_without_documents(spark, sf):
    from siltstone.operators import index

    found = rank.Searcher(index.build(spark.read.parquet(f"{sf}/documents.parquet").limit(0)))
    assert found.top_k("that this").collect() == []
    found.close()


def test_package_is_shipped_whole(spark):
    path = siltstone.ship(spark)
    names = set(zipfile.ZipFile(path).namelist())
    assert {"siltstone/__init__.py", "siltstone/catalog.py", "siltstone/operators/rank.py"} <= names


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Far:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Far()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.folder(Session())


def test_listings_are_parsed_once_by_several_tasks(spark, sf, monkeypatch):
    parsed = []
    monkeypatch.setattr(catalog.E, "parse_markdown", lambda rows, *a, run=catalog.E.parse_markdown: parsed.append(run(rows, *a)) or parsed[-1])
    assert roundtrips._joined(spark, sf).count() and len(parsed) == 1
    assert parsed[0].rdd.getNumPartitions() > 1


def test_normal_forms_are_made_of_distinct_names_only(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(E.shared, "stage", lambda rows, name, run=shared.stage: asked.append((name, run(rows, name))) or asked[-1][1])
    left = spark.createDataFrame([("TX", "Austin", i) for i in range(50)], "state_abbr string, city string, i int")
    right = spark.createDataFrame([("Austin", "TX", "Texas", "Austin, Texas", "p1", 1, "{}")], "entity_name string, state string, state_full string, wiki_title string, page_id string, text_length int, extracted_properties string")
    best = E.best_matches(left, "city", right)
    assert best.count() == 50 and {r.match_score for r in best.collect()} == {1.0}
    assert [rows.count() for name, rows in asked if name == "names"] == [1, 1]


def test_best_others_equals_all_pairs(spark):
    words = ["red", "blue", "ring", "bolt", "red ring", "ring red", "old", ""]
    rows = spark.createDataFrame([(i // 2 if i < 6 else i, f"b{i % 3}", " ".join(words[(i * k) % 8] for k in range(1, 2 + i % 3)).strip()) for i in range(80)], "key int, block string, name string")
    a, b = rows.select(F.col("key").alias("left_key"), "block", F.col("name").alias("a")), rows.select(F.col("key").alias("right_key"), "block", F.col("name").alias("b"))
    pairs = a.join(b, "block").where("left_key <> right_key").withColumn("score", fuzzy.score_normalized(F.col("a"), F.col("b"))).where("score >= 0.3")
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (-r.score, r.right_key)):
        want.setdefault(r.left_key, (r.right_key, r.score))
    got = fuzzyjoin.best_others(rows, 0.3).collect()
    assert {r.left_key: (r.right_key, r.score) for r in got} == want and len(got) == len(want) > 50


def test_equal_names_are_not_compared_pair_by_pair(spark, sf, monkeypatch, tmp_path):
    seen = []
    monkeypatch.setattr(fuzzyjoin, "similar_pairs", lambda a, b, t, run=fuzzyjoin.similar_pairs: seen.append(run(a, b, t)) or seen[-1])
    part = spark.read.parquet(f"{sf}/part.parquet")
    part.union(part.withColumn("p_partkey", F.col("p_partkey") + 1000)).write.parquet(str(tmp_path / "part.parquet"))
    assert catalog.QUERIES["fuzzy_best"](spark, str(tmp_path)).count() == 2 * part.count()
    once = catalog.QUERIES["fuzzy_best"](spark, sf).count()
    assert once and seen[0].count() == seen[1].count()


def test_searcher_shuffles_its_postings_once(spark, tmp_path):
    from siltstone.operators import index

    docs = spark.createDataFrame([(i, "pool house " + "garden " * (i % 3) + ("lodge" if i == 7 else "")) for i in range(40)], "doc_id long, text string")
    index.build(docs).save(str(tmp_path / "i"))
    stored = index.load(spark, str(tmp_path / "i"))
    found = rank.Searcher(stored)
    assert found.postings._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert found.postings._jdf.queryExecution().logical().toString().count("Join") == 0
    for text in ("garden lodge", "pool pool nothing", "garden", "nothing"):
        for method in ("bm25", "tfidf"):
            assert list(map(tuple, found.top_k(text, method).collect())) == list(map(tuple, rank.top_k(stored, text, method).collect()))
    assert found.known["garden"] == 26 and found.known["lodge"] == 1 and found.known["nothing"] == 0
    found.close()
