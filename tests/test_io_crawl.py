import bz2
import hashlib
import json

from pyspark.sql import functions as F

from siltstone import catalog, cli, schema
from siltstone.operators import crawl, index, rank
from siltstone.sources import readers, writers
from siltstone.streaming import arrivals


def test_breadth_first_takes_the_least_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    out = {r.url: r.depth for r in crawl.breadth_first(spark.createDataFrame([("a",), (None,)], "url string"), edges, 2).collect()}
    assert out == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_seeds_and_root_urls(spark):
    seeds = spark.createDataFrame([("New York", "New York", "ny", "new-york", "k1", None), ("X", "X", "x", "x", "", None), ("Y", "Y", "y", "y", "k", "bad")], schema.SEEDS)
    rows = crawl.root_urls(crawl.valid_seeds(seeds, 10), "https://example.org/sale/", 2).orderBy("page").collect()
    assert [r.page for r in rows] == [1, 2]
    assert rows[0].url.startswith("https://example.org/sale/ny/new-york/city/k1?searchQuery=%7B%22place%22%3A%20%7B%22city%22%3A%20%22new%20york%22%2C%20")
    assert rows[1].url.endswith("%22pageNumber%22%3A%202%7D")


def test_html_directory_and_named_jsonl(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "abc.html").write_text("<p>x</p>")
    (tmp_path / "p" / "skip.txt").write_text("no")
    rows = readers.html_directory(spark, str(tmp_path / "p")).collect()
    assert [(r.file_hash, r.source_file, r.html) for r in rows] == [("abc", "abc.html", "<p>x</p>")]
    writers.named_jsonl(spark.createDataFrame([(1, None), (2, "b")], "a int, b string"), str(tmp_path / "out.jsonl"))
    assert [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()] == [{"a": 1}, {"a": 2, "b": "b"}]


def test_html_directory_of_many_files(spark, tmp_path):
    """Whatever their number, files take a few tasks a core, and folders, endings and bytes are as Spark's reader has them."""
    (tmp_path / "in").mkdir()
    for i in range(900):
        (tmp_path / f"{'in/' if i % 9 == 0 else ''}p{i}.html").write_bytes(b"\xef\xbb\xbf" * (i == 1) + f"é {i}\r\n".encode() * (i != 2))
    for name in ("_a.html", ".b.html", "c.htm", "in/_d.html"):
        (tmp_path / name).write_text("no")
    for recursive in (False, True):
        rows = readers.html_directory(spark, str(tmp_path), recursive)
        plain = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", recursive).text(str(tmp_path), wholetext=True)
        # Spark leaves out empty files; a page without text is a page.
        want = sorted([*map(tuple, plain.select("_metadata.file_name", "value").collect()), ("p2.html", "")])
        assert sorted((r.source_file, r.html) for r in rows.collect()) == want and len(want) == (900 if recursive else 800)
        assert rows.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism < plain.rdd.getNumPartitions()
    assert readers.html_directory(spark, f"{tmp_path}/p1*.html").count() > 50


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"title": "a"}\n\n{bad\n{"title": "b"}\n')
    rows = readers.jsonl_lenient(spark, str(tmp_path / "x.jsonl")).cache()
    assert rows.where("_corrupt_record is not null").count() == 1
    assert {r.title for r in readers.good_lines(rows).collect()} == {"a", "b"}
    writers.jsonl(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).first().value == '{"x":"a","y":null}'


def test_csv_append(spark, tmp_path):
    pages = spark.createDataFrame([("http://h:1/x", "<p>é</p>")], "url string, html string")
    for _ in range(2):
        writers.csv_append(crawl.metadata(pages, F.lit("t")), str(tmp_path / "m"))
    out = readers.crawl_metadata(spark, str(tmp_path / "m")).collect()
    assert [(r.domain, r.content_length, r.response_time_ms) for r in out] == [("h:1", 8, None)] * 2


PAGES = [(1, "http://h/x", "<p>a</p>"), (2, "http://h/x", "<p>b</p>"), (3, "http://h/x", "<p>b</p>"), (4, "http://h/y", "<p>c</p>")]


def test_metadata_of_pages_with_one_address(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r.page_id for r in catalog.QUERIES["crawl_metadata"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_files_of_pages_with_one_address(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for _ in range(2):
        writers.page_files(pages, str(tmp_path / "p"))
    rows = readers.html_directory(spark, str(tmp_path / "p"), recursive=True).collect()
    names = {u: hashlib.md5(u.encode()).hexdigest() for _, u, _ in PAGES}
    assert sorted(map(tuple, rows)) == sorted((names[u], f"{names[u]}.html", h) for _, u, h in PAGES)
    assert len(readers.html_directory(spark, str(tmp_path / "p")).collect()) == 2


def test_title_index_and_dump(spark, tmp_path):
    (tmp_path / "t.bz2").write_bytes(bz2.compress(b"10:1:A:b\nbad\nx:2:C\n") + bz2.compress(b"20:3:D\n"))
    out = {tuple(r) for r in readers.title_index(spark, str(tmp_path / "t.bz2"), 2).collect()}
    assert out == {(10, "1", "A:b"), (20, "3", "D")}
    xml = "<mediawiki><page><title>A</title><id>1</id><revision><id>9</id><text>hello</text></revision></page></mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    row = readers.article_dump(spark, str(tmp_path / "d.xml.bz2")).first()
    assert (row.page_id, row.wiki_title, row.text) == ("1", "A", "hello") and "<title>A</title>" in row.xml


DOCS = [(0, "Pool house", "luxury pool"), (1, "House", None), (2, None, None), (3, "Lodge", "pool")]


def test_index_round_trips_and_invariants(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, description string")
    docs = docs.withColumn("text", F.concat_ws(" ", "title", "description"))
    idx = index.build(docs, keep=("title", "description"))
    assert idx.stats.first().asDict() == {"n": 4, "avgdl": 7 / 4}
    tf = {r.doc_id: r.s for r in idx.postings.groupBy("doc_id").agg(F.sum("tf").alias("s")).collect()}
    assert tf == {r.doc_id: r.dl for r in idx.docs.collect() if r.dl}
    full = rank.scores(idx, "pool house pool").orderBy(F.desc("score"), "doc_id").collect()
    assert [r.doc_id for r in rank.top_k(idx, "pool house pool", k=2).collect()] == [r.doc_id for r in full[:2]]
    idx.save(str(tmp_path / "i"))
    index.save_tagged(idx, str(tmp_path / "j"))
    for again in (index.load(spark, str(tmp_path / "i")), index.load_tagged(spark, str(tmp_path / "j"))):
        assert [tuple(r) for r in rank.scores(again, "pool house pool").orderBy(F.desc("score"), "doc_id").collect()] == [tuple(r) for r in full]
    searcher = rank.Searcher(idx)
    for method in ("bm25", "tfidf"):
        assert searcher.top_k("pool house pool", method).collect() == rank.top_k(idx, "pool house pool", method).collect()
    assert searcher.top_k("absent").collect() == []
    searcher.close()
    row = rank.search(idx, "pool absent", "tfidf", 1).first()
    assert row.doc_id == 0 and row.method == "tfidf"
    assert row.term_metrics["absent"].present is False and row.term_metrics["absent"].tf_normalized is None
    assert row.term_metrics["pool"].tf == 2 and row.term_metrics["pool"].df == 2
    assert rank.scores(idx, "the").count() == 0
    empty = index.build(docs.limit(0))
    assert empty.stats.first().asDict() == {"n": 0, "avgdl": 0.0} and rank.scores(empty, "pool").count() == 0


def test_number_lines(spark):
    rows = spark.range(0, 1000, numPartitions=7).select(F.format_string("%05d", "id").alias("file_hash"))
    out = index.number_lines(rows, ["file_hash"]).collect()
    assert {int(r.file_hash): r.doc_id for r in out} == {i: i for i in range(1000)}


def test_stream_equals_batch(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    arrivals.index_sink(arrivals.page_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = index.build(pages.withColumnRenamed("html", "text"), key="page_id").postings
    want = want.drop("dl")
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    q = arrivals.listing_stream(arrivals.page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("l").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("l").count() == pages.count()


def test_full_command(spark, tmp_path, capsys):
    pages = tmp_path / "pages"
    pages.mkdir()
    body = "<h1>1 Main St, Austin, TX 78701</h1><p>$500,000</p><p>3 Beds</p><p>MLS# A1</p><p>Luxury pool home.</p><p>Read More</p><p>City</p><p>Austin</p><p>School District</p><p>Austin ISD</p>"
    (pages / "h1.html").write_text(body)
    text = "{{Infobox\n| population_total = 1,000\n}}\nAustin is a city in Texas, TX county. " + "z" * 100
    (tmp_path / "t.bz2").write_bytes(bz2.compress(b"5:7:Austin, Texas\n6:8:Austin ISD\n"))
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(f"<m><page><title>Austin, Texas</title><id>7</id><revision><text>{text}</text></revision></page></m>".encode()))
    cli.main(["full", str(pages), str(tmp_path / "t.bz2"), str(tmp_path / "d.xml.bz2"), str(tmp_path / "out")])
    row = json.loads((tmp_path / "out" / "properties_with_wiki.jsonl").read_text())
    assert row["property_id"] == "h1" and row["wiki_data"][0]["city"] == {"population": "1,000"}
    cli.main(["query", str(tmp_path / "out" / "properties_with_wiki.jsonl"), "pool AND price:[* TO 600000]"])
    cli.main(["index", str(tmp_path / "out" / "parsed" / "json"), str(tmp_path / "idx")])
    cli.main(["search", str(tmp_path / "idx"), "luxury pool"])
    cli.main(["tokens", str(tmp_path / "out" / "parsed" / "json")])
    assert "Austin" in capsys.readouterr().out
